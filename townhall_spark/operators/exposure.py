"""County resolution and hazard-risk enrichment.

Lookups are left joins without hints: Spark broadcasts a lookup table only when
its size, from files or at run time, is under ``autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.functions.regions import lookup
from townhall_spark.functions.text import SPACE_CLASS, ustrip, zfill
from townhall_spark.schemas import COUNTY_RISK, HAZARD_RISK_COLUMNS, ROW_ORDER

# Place or county code -> county code of the segment source's cities.
CITY_COUNTY = {
    "5363000": "53033",
    "53033": "53033",
    "0820000": "08031",
    "2507000": "25025",
    "0643000": "06037",
    "0600562": "06001",
}

# Fixed pattern: names that denote a county.
COUNTY_SUFFIX = rf"(?i){SPACE_CLASS}+(county|parish|borough)$"

COUNTY_COLUMNS = tuple(COUNTY_RISK.names)


def slim_counties(wide: DataFrame) -> DataFrame:
    """The eleven used columns of the wide county file, county code padded to 5."""
    return (wide.select(*COUNTY_COLUMNS)
            .withColumn("STCOFIPS", zfill(F.col("STCOFIPS").cast("string"), 5)))


def county_key(county: Column, state: Column) -> Column:
    """Upper-case ``COUNTY|STATE`` join key."""
    return F.concat(ustrip(F.upper(county)), F.lit("|"), F.upper(state))


def county_name_key(name: Column, state: Column) -> Column:
    """Key of a jurisdiction whose name ends in county, parish or borough, else null."""
    return F.when(name.rlike(COUNTY_SUFFIX),
                  county_key(F.regexp_replace(name, COUNTY_SUFFIX, ""), state))


def _order(rows: DataFrame) -> Column:
    """Where a row stands in its files, or in the frame when it comes from none."""
    return F.col(ROW_ORDER) if ROW_ORDER in rows.columns else F.monotonically_increasing_id()


def last_county_of_place(place_to_county: DataFrame) -> DataFrame:
    """Last entry per place wins."""
    seq = _order(place_to_county)
    return (place_to_county.select(ustrip(F.col("place_fips")).alias("_place"),
                                   zfill(F.col("county_fips"), 5).alias("_place_county"),
                                   seq.alias("_seq"))
            .where(F.col("_place").isNotNull())
            .groupBy("_place").agg(F.max_by("_place_county", "_seq").alias("_place_county")))


def first_county_of_name(counties: DataFrame) -> DataFrame:
    """First county per ``COUNTY|STATE`` key wins."""
    return (counties.select(county_key(F.col("COUNTY"), F.col("STATEABBRV")).alias("_name_key"),
                            zfill(F.col("STCOFIPS"), 5).alias("_name_county"),
                            _order(counties).alias("_seq"))
            .where(F.col("_name_key").isNotNull())
            .groupBy("_name_key").agg(F.min_by("_name_county", "_seq").alias("_name_county")))


def resolve_county(meetings: DataFrame, counties: DataFrame,
                   place_to_county: DataFrame | None = None,
                   fixed: Mapping[str, str] = CITY_COUNTY) -> DataFrame:
    """Adds ``county_fips``: fixed table, then place table, then county name and state."""
    fips = ustrip(F.col("jurisdiction_fips"))
    out = meetings.withColumn("_place", fips)
    tiers = [lookup(dict(fixed), fips, None)]
    if place_to_county is not None:
        out = out.join(last_county_of_place(place_to_county), "_place", "left")
        tiers.append(F.col("_place_county"))
    # Most names are no counties. Their null keys would all meet in one task if
    # this join ever shuffled, so each gets a key of its own that matches nothing.
    no_match = F.concat(F.lit("\x00"), F.col("canonical_id"))
    out = out.withColumn("_name_key", F.coalesce(
        county_name_key(F.col("jurisdiction_name"), F.col("state")), no_match))
    out = out.join(first_county_of_name(counties), "_name_key", "left")
    tiers.append(F.col("_name_county"))
    return (out.withColumn("county_fips", F.coalesce(*tiers))
            .drop("_place", "_place_county", "_name_key", "_name_county"))


def attach_risk(resolved: DataFrame, counties: DataFrame) -> DataFrame:
    """(canonical_id, county_fips, county_name, overall_risk, risk_<hazard>...)."""
    risk = (counties.select(
        zfill(F.col("STCOFIPS"), 5).alias("county_fips"),
        F.struct(_order(counties).alias("seq"),
                 F.col("COUNTY").alias("county_name"),
                 F.col("RISK_SCORE").alias("overall_risk"),
                 *[F.col(c).alias(f"risk_{h}") for h, c in HAZARD_RISK_COLUMNS.items()])
        .alias("r"))
        .groupBy("county_fips").agg(F.min("r").alias("r")))
    return (resolved.select("canonical_id", "county_fips")
            .join(risk, "county_fips", "left")
            .select("canonical_id", "county_fips", "r.county_name", "r.overall_risk",
                    *[f"r.risk_{h}" for h in HAZARD_RISK_COLUMNS]))


def enrich(meetings: DataFrame, counties: DataFrame,
           place_to_county: DataFrame | None = None,
           fixed: Mapping[str, str] = CITY_COUNTY) -> DataFrame:
    """Exposure row of every meeting; unresolved ones carry nulls."""
    return attach_risk(resolve_county(meetings, counties, place_to_county, fixed), counties)


def exposure_coverage(exposure: DataFrame) -> DataFrame:
    """How many meetings resolved to a county."""
    return exposure.agg(F.count("county_fips").alias("resolved"),
                        F.count(F.lit(1)).alias("meetings"))
