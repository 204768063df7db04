"""Summary tables by region, state, year, hazard, coverage and exposure.

Actions are first counted per meeting (combined before the shuffle, so one
meeting with very many actions stays cheap), then joined to meetings, then
grouped. ``meetings`` and ``exposure`` have one row per canonical_id, as linking
and enrichment produce them, so meetings are counted and not told apart.
Jurisdictions are told apart by grouping on them first: what is shuffled is one
row per group and jurisdiction, not several copies of every meeting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.functions.regions import division, region
from townhall_spark.schemas import ADAPTATION_CATEGORIES, CLIMATE_CATEGORIES

# Hazards whose risk is compared with actions, and how many
# counties a correlation needs.
ALIGNED_HAZARDS = ("flood", "heat", "wildfire", "drought")
MIN_PAIRS = 5

ACTION_MEETING_COLUMNS = ("state", "meeting_date", "source", "jurisdiction_name",
                          "jurisdiction_fips")


def with_region_year(df: DataFrame) -> DataFrame:
    """Adds ``region`` and ``year``."""
    return (df.withColumn("region", region(F.col("state")))
            .withColumn("year", F.year("meeting_date")))


def region_rollup(meetings: DataFrame) -> DataFrame:
    """Meetings per Census region."""
    return meetings.groupBy(region(F.col("state")).alias("region")).agg(
        F.count(F.lit(1)).alias("meetings"))


def division_rollup(meetings: DataFrame) -> DataFrame:
    """Meetings per Census division."""
    return meetings.groupBy(division(F.col("state")).alias("division")).agg(
        F.count(F.lit(1)).alias("meetings"))


def actions_enriched(meetings: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions with their meeting's place, date, source, region and year.

    An action without a meeting keeps nulls and region ``Unknown``.
    """
    place = meetings.select("canonical_id", *ACTION_MEETING_COLUMNS)
    return with_region_year(actions.join(place, "canonical_id", "left"))


def _count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def category_counts(actions: DataFrame) -> DataFrame:
    """Actions per category."""
    return actions.groupBy("action_category").agg(F.count(F.lit(1)).alias("actions"))


def category_pivot(enriched: DataFrame, key: str,
                   categories: Sequence[str] = CLIMATE_CATEGORIES) -> DataFrame:
    """One row per key with a count column per category, 0 when there are none."""
    return enriched.groupBy(key).agg(*[
        _count_if(F.col("action_category") == c).alias(c) for c in categories])


def meeting_counts(meetings: DataFrame, actions: DataFrame,
                   categories: Sequence[str] = CLIMATE_CATEGORIES) -> DataFrame:
    """Per meeting its place, region, year and actions per category (null: none).

    What the tables by region, state and year are grouped from; compute it once.
    """
    counts = category_pivot(actions, "canonical_id", categories)
    base = with_region_year(meetings.select(
        "canonical_id", "jurisdiction_fips", "state", "meeting_date"))
    return base.drop("meeting_date").join(counts, "canonical_id", "left")


def _intensity(rows: DataFrame, keys: Sequence[str], categories: Sequence[str],
               jurisdictions: bool) -> DataFrame:
    zero = F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(c), zero).alias(c) for c in categories]
    if jurisdictions:
        places = rows.groupBy(*keys, "jurisdiction_fips").agg(
            F.count(F.lit(1)).alias("meetings"), *sums)
        table = places.groupBy(*keys).agg(
            F.sum("meetings").alias("meetings"),
            F.count("jurisdiction_fips").alias("jurisdictions"),
            *[F.sum(c).alias(c) for c in categories])
    else:
        table = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("meetings"), *sums)
    climate = F.expr(" + ".join(f"`{c}`" for c in CLIMATE_CATEGORIES))
    return (table.withColumn("climate_actions", climate)
            .withColumn("actions_per_meeting", F.bround(
                F.try_divide(F.col("climate_actions").cast("double"), "meetings"), 3)))


def by_region(counts: DataFrame, categories: Sequence[str] = CLIMATE_CATEGORIES) -> DataFrame:
    """Meetings, jurisdictions and climate actions per region, of ``meeting_counts``."""
    return _intensity(counts, ["region"], categories, True)


def by_state(counts: DataFrame, categories: Sequence[str] = CLIMATE_CATEGORIES) -> DataFrame:
    """Meetings and climate actions per state; a state has one region."""
    return _intensity(counts, ["state", "region"], categories, False)


def by_time(counts: DataFrame, categories: Sequence[str] = CLIMATE_CATEGORIES) -> DataFrame:
    """Meetings and climate actions per year; meetings without a date are left out."""
    return _intensity(counts.dropna(subset=["year"]), ["year"], categories, False)


def _adaptation(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action_category").isin(*ADAPTATION_CATEGORIES))


def by_hazard(actions: DataFrame) -> DataFrame:
    """Adaptation actions per hazard, most frequent first."""
    return (_adaptation(actions).where(F.col("hazard_type").isNotNull())
            .groupBy("hazard_type").agg(F.count(F.lit(1)).alias("actions"))
            .orderBy(F.desc("actions"), "hazard_type"))


def hazard_by_region(meetings: DataFrame, actions: DataFrame) -> DataFrame:
    """Adaptation actions per region and hazard."""
    counts = (_adaptation(actions).where(F.col("hazard_type").isNotNull())
              .groupBy("canonical_id", "hazard_type").agg(F.count(F.lit(1)).alias("n")))
    place = meetings.select("canonical_id", region(F.col("state")).alias("region"))
    return (counts.join(place, "canonical_id", "left")
            .groupBy(F.coalesce("region", F.lit("Unknown")).alias("region"), "hazard_type")
            .agg(F.sum("n").alias("actions"))
            .orderBy("region", F.desc("actions"), "hazard_type"))


def coverage(meetings: DataFrame) -> DataFrame:
    """Meetings, jurisdictions and share with a transcript per region and source."""
    places = meetings.groupBy(
        region(F.col("state")).alias("region"), "source", "jurisdiction_fips").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_transcript").alias("with_text"))
    share = F.sum("with_text").cast("double") / F.sum("n").cast("double")
    return places.groupBy("region", "source").agg(
        F.sum("n").alias("meetings"), F.count("jurisdiction_fips").alias("jurisdictions"),
        F.bround(F.lit(100.0) * share, 1).alias("pct_with_transcript"))


def coverage_pivot(coverage_table: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """Meetings per region with one column per source, 0 when there are none.

    The columns are the sources that occur, which takes a pass to list them, or the
    given ones.
    """
    return (coverage_table.groupBy("region").pivot("source", list(sources) if sources else None)
            .agg(F.sum("meetings")).na.fill(0))


def overview(meetings: DataFrame) -> DataFrame:
    """Headline counts of a meetings table."""
    places = meetings.groupBy("jurisdiction_fips", "state", "source").agg(
        F.count(F.lit(1)).alias("n"))
    return places.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("meetings"),
        F.count_distinct("jurisdiction_fips").alias("jurisdictions"),
        F.count_distinct("state").alias("states"),
        F.count_distinct("source").alias("sources"))


def source_jurisdiction_counts(records: DataFrame) -> DataFrame:
    """Records per source and jurisdiction name."""
    return records.groupBy("source", "jurisdiction_name").agg(F.count(F.lit(1)).alias("n"))


def exposure_jurisdictions(actions: DataFrame, exposure: DataFrame) -> DataFrame:
    """Per county: meetings, risks, and matching adaptation actions per hazard."""
    counts = _adaptation(actions).groupBy("canonical_id").agg(*[
        _count_if(F.col("hazard_type") == h).alias(f"act_{h}") for h in ALIGNED_HAZARDS])
    located = (exposure.where(F.col("county_fips").isNotNull())
               .join(counts, "canonical_id", "left"))
    # Name and risks are constant within a county.
    return located.groupBy("county_fips").agg(
        F.max("county_name").alias("county_name"),
        F.count(F.lit(1)).alias("meetings"),
        *[F.max(f"risk_{h}").alias(f"risk_{h}") for h in ALIGNED_HAZARDS],
        *[F.coalesce(F.sum(f"act_{h}"), F.lit(0).cast("long")).alias(f"act_{h}")
          for h in ALIGNED_HAZARDS])


def exposure_alignment(jurisdictions: DataFrame) -> DataFrame:
    """Per hazard: counties with a risk score, actions, correlation of the two.

    The correlation is null below five pairs or when either side is constant
    (``corr`` itself would fail on a constant side).
    """
    pairs = F.array(*[
        F.struct(F.lit(h).alias("hazard"), F.col(f"risk_{h}").alias("risk"),
                 F.col(f"act_{h}").cast("double").alias("act"))
        for h in ALIGNED_HAZARDS])
    rows = jurisdictions.select(F.explode(pairs).alias("p")).select("p.*")
    act = F.when(F.col("risk").isNotNull(), F.col("act"))
    spread = F.stddev_samp("risk") * F.stddev_samp(act)
    r = F.try_divide(F.covar_samp("risk", act), spread)
    return rows.groupBy("hazard").agg(
        F.count("risk").alias("n_jurisdictions"),
        F.coalesce(F.sum("act"), F.lit(0.0)).cast("long").alias("total_actions"),
        F.when((F.count("risk") >= MIN_PAIRS) & (spread > 0), F.bround(r, 3))
        .alias("pearson_r_risk_vs_action"))


def alignment_display(alignment: DataFrame) -> DataFrame:
    """Hazards with a correlation."""
    return alignment.dropna(subset=["pearson_r_risk_vs_action"])


def build_all(meetings: DataFrame, actions: DataFrame, exposure: DataFrame | None = None,
              counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six summary tables, and the two exposure tables when exposure is given.

    ``counts`` are the stored ``meeting_counts``, where an earlier job wrote them.
    """
    counts = meeting_counts(meetings, actions) if counts is None else counts
    tables = {
        "by_region": by_region(counts),
        "by_state": by_state(counts),
        "by_time": by_time(counts),
        "by_hazard": by_hazard(actions),
        "hazard_by_region": hazard_by_region(meetings, actions),
        "coverage": coverage(meetings),
    }
    if exposure is not None:
        counties = exposure_jurisdictions(actions, exposure)
        tables["exposure_jurisdictions"] = counties
        tables["exposure_alignment"] = exposure_alignment(counties)
    return tables
