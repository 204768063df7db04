"""Adapters that give the driver's tables the shape of the pipeline's inputs.

Each adapter exists twice, as DataFrame expressions and as SQL text for the
oracle; ``FIXTURES.md`` explains which case each expression covers. Every
adapter keeps all rows and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townhall_spark.functions.lexicon import Lexicon
from townhall_spark.functions.literals import text_array
from townhall_spark.functions.regions import STATE_CODES
from townhall_spark.functions.text import sentences
from townhall_spark.sources.specs import SourceSpec, canonical_of

STATE_NAMES = ("California", "Washington", "Massachusetts", "Texas", "Ohio", "Florida",
               "Colorado", "Minnesota", "New York", "Guam")
BODIES = ("City Council", "Planning Commission", "County Commission", "School Board",
          "Zoning Board of Appeals", "Board of Supervisors")
SEGMENT_BODIES = ("DenverCityCouncil", "SeattleCityCouncil", "BostonCommittee",
                  "LongBeachSpecial", "KingCountyWorkshop", "AlamedaCityCouncil",
                  "UnknownTown", "DenverCommittee")
NO_CAPTION = "<No Caption Available>"

TEST_LEXICON = Lexicon(
    topic="testdata",
    adaptation_strong=("eran", "achte", "ciónbo", "rele"),
    mitigation_strong=("anes", "erte", "ouvi", "license"),
    climate_generic=("edst", "éque", "einber"),
    weak_context=("from", "mi ", "une "),
    procedural=("for the", "is and", "que la"),
    hazards=(("sea_level_rise", ("ment", "sch")), ("flood", ("tion",)),
             ("wildfire", ("rea", "onen")), ("heat", ("der",)), ("drought", ("las",)),
             ("storm", ("her",))),
)
# The sources of the given documents.
SOURCES = tuple(f"src{i}" for i in range(20))
# The second method of comparisons: the same lexicon without its weak list.
STRICT_LEXICON = Lexicon(**{**TEST_LEXICON.__dict__, "weak_context": ()})
TEST_VERSION = "lexicon:testdata"

TABULAR_SPEC = SourceSpec.from_mapping("captions", {
    "loader": {"type": "table"},
    "mapper": {"type": "generic_tabular"},
    "order_column": "ingest_seq",
    "source_column": "source",
    # Columns of the field map by every kind of spec but a constant, which CONST_MAP has.
    "field_map": {
        "jurisdiction_fips": {"copy": "st_fips"},
        "jurisdiction_name": {"copy": "place_name"},
        "state": {"state_abbrev": "state_name"},
        "meeting_date": {"parse_date": {"column": "meeting_date", "format": "iso"}},
        "meeting_type": {"meeting_type_from_govt": "place_govt"},
        "transcript": {"clean_text": {"column": "caption_text_clean",
                                      "missing": "<no caption available>"}},
        "source_url": {"template": "https://video.example.org/watch?v={vid_id}"},
        "source_record_id": {"copy": "vid_id"},
    },
})
CONST_MAP = {"meeting_type": {"const": "other"}, "state": {"const": "GU"},
             "source_record_id": {"copy": "vid_id"}}
SEGMENT_SPEC = SourceSpec.from_mapping("segments", {
    "loader": {"type": "table"},
    "mapper": {"type": "meetingbank_segments"},
    "order_column": "ingest_seq",
    "source_url": "https://segments.example.org/",
})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(text_array(values), (index + 1).cast("int"))


def place_number() -> Column:
    """A third of all documents share 50 places."""
    doc = F.col("doc_id")
    return F.when(doc % 3 == 0, doc % 50).otherwise(doc % 700)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over all cores: the small test files are one scan task each.

    Tables with as many splits as cores pass through without a shuffle.
    """
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def lexicon_terms(lexicon: Lexicon) -> tuple[str, ...]:
    """Every term of a lexicon, once."""
    lists = (lexicon.adaptation_strong, lexicon.mitigation_strong, lexicon.climate_generic,
             lexicon.weak_context, lexicon.procedural, *(words for _, words in lexicon.hazards))
    return tuple(dict.fromkeys(term for words in lists for term in words))


def planted(terms: tuple[str, ...]) -> Column:
    """The text of a document and a sentence with two of the terms, by its number."""
    doc, n = F.col("doc_id"), len(terms)
    return F.concat("text", F.lit("\nThe Board spoke of "), _pick(terms, doc % n), F.lit(" and "),
                    _pick(terms, F.floor(doc / 7) % n), F.lit(" at some length."))


def raw_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, k = F.col("doc_id"), F.col("k")
    cycle = F.when(doc % 3 == 0, F.lit(0)).otherwise(13 * F.floor(doc / 1400))
    days = ((9 * k + cycle) % 6570).cast("int")
    return (documents(spark, sf_dir).withColumn("k", place_number()).select(
        F.concat(F.lit("vid"), doc.cast("string")).alias("vid_id"),
        doc.alias("ingest_seq"), "source",
        F.when(doc % 97 == 0, "").otherwise((1000000 + k).cast("string")).alias("st_fips"),
        F.concat(F.lit("NATION_"), (k % 25).cast("string"),
                 F.when(doc % 11 == 3, " City").otherwise("")).alias("place_name"),
        F.when(doc % 31 == 7, _pick(STATE_NAMES, (k % 25 + 1) % 10))
        .otherwise(_pick(STATE_NAMES, (k % 25) % 10)).alias("state_name"),
        _pick(BODIES, k % 6).alias("place_govt"),
        F.when(doc % 89 == 1, "n/a").otherwise(
            F.date_add(F.lit("2006-01-01").cast("date"), days).cast("string"))
        .alias("meeting_date"),
        F.when(doc % 13 == 5, NO_CAPTION).otherwise(F.col("text")).alias("caption_text_clean")))


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    days = ((conv % 60 + 60 * F.floor(conv / 480)) % 3000).cast("int")
    day = F.date_format(F.date_add(F.lit("2016-01-01").cast("date"), days), "MMddyyyy")
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", _pick(SEGMENT_BODIES, conv % 8),
                    F.when(conv % 23 == 4, "13412016").otherwise(day),
                    F.col("turn").cast("string")).alias("uid"),
        F.when(F.col("role") != "system", F.col("text")).alias("transcript"),
        (conv * 100 + F.col("turn")).alias("ingest_seq"))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_of(raw_tabular(spark, sf_dir), TABULAR_SPEC)


def segment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_of(raw_segments(spark, sf_dir), SEGMENT_SPEC)


def _state_code(index: Column) -> Column:
    codes = tuple(STATE_CODES.get(name, "GU") for name in STATE_NAMES)
    return _pick(codes, index)


def counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One county per nation with risks from its customers' balances."""
    def risk(segment: str | None) -> Column:
        balance = F.col("c_acctbal")
        if segment:
            balance = F.when(F.col("c_mktsegment") == segment, balance)
        return F.bround(F.avg(balance), 6)

    risks = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        risk(None).alias("RISK_SCORE"), risk("AUTOMOBILE").alias("IFLD_RISKS"),
        risk("MACHINERY").alias("CFLD_RISKS"), risk("FURNITURE").alias("WFIR_RISKS"),
        risk("BUILDING").alias("HWAV_RISKS"), risk("HOUSEHOLD").alias("DRGT_RISKS"),
        F.count(F.lit(1)).alias("POPULATION"))
    key = F.col("n_nationkey")
    return (table(spark, sf_dir, "nation").join(
        risks, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .select(F.lpad((key + 1).cast("string"), 5, "0").alias("STCOFIPS"),
                _state_code(key % 10).alias("STATEABBRV"),
                F.upper("n_name").alias("COUNTY"), "POPULATION", "RISK_SCORE",
                "IFLD_RISKS", "CFLD_RISKS", "WFIR_RISKS", "HWAV_RISKS", "DRGT_RISKS",
                F.lit(None).cast("double").alias("HRCN_RISKS")))


def _county_of_place(k: int) -> str:
    return str(k % 25 + 1).zfill(5)


FIXED_COUNTY = {str(1000000 + k): _county_of_place(k) for k in range(20)}


def wide_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide county file of text columns: one county per customer."""
    balance = F.col("c_acctbal").cast("string")
    risks = ("RISK_SCORE", "IFLD_RISKS", "CFLD_RISKS", "WFIR_RISKS", "HWAV_RISKS", "DRGT_RISKS",
             "HRCN_RISKS")
    return table(spark, sf_dir, "customer").select(
        "*", F.col("c_custkey").cast("string").alias("STCOFIPS"),
        F.col("c_mktsegment").alias("STATEABBRV"), F.col("c_name").alias("COUNTY"),
        F.col("c_nationkey").cast("string").alias("POPULATION"),
        *[balance.alias(r) for r in risks])


def place_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several counties for each place, in the order of customers."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("place_fips"),
        F.col("c_custkey").cast("string").alias("county_fips"), F.col("c_custkey").alias("row_order"))


def place_to_county(spark: SparkSession) -> DataFrame:
    """Places 20 to 119."""
    k = F.col("id")
    return spark.range(20, 120, 1, 1).select(
        (1000000 + k).cast("string").alias("place_fips"),
        F.lpad((k % 25 + 1).cast("string"), 5, "0").alias("county_fips"))


def with_county_names(meetings: DataFrame) -> DataFrame:
    """Places 120 to 299 are named as counties."""
    name = F.col("jurisdiction_name")
    k = F.col("jurisdiction_fips").cast("long") - 1000000
    county = F.concat(F.regexp_replace(name, " City$", ""), F.lit(" County"))
    return meetings.withColumn(
        "jurisdiction_name", F.when((k >= 120) & (k < 300), county).otherwise(name))


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listed jurisdiction per nation."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("Nation_"), key.cast("string")).alias("jurisdiction_name"),
        _state_code(key % 10).alias("state"),
        F.lpad((key + 1).cast("string"), 7, "0").alias("fips"),
        F.lit("place").alias("fips_type"))


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of a labelled document, stored as excerpts are."""
    labels, docs = table(spark, sf_dir, "labels"), documents(spark, sf_dir)
    toxic, quality = F.col("toxic") == 1, F.col("quality") == 1
    doc = F.col("doc_id")
    category = (F.when(toxic & quality, "both").when(toxic, "adaptation")
                .when(~quality, "mitigation").otherwise("unrelated"))
    hazard = F.when(doc % 3 == 0, "flood").when(doc % 3 == 1, "heat")
    return (docs.join(labels, "doc_id").select(
        doc, category.alias("action_category"), hazard.alias("hazard_type"),
        F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
        .select((doc * 1000000 + F.col("pos")).alias("seq"),
                F.concat(F.lit("doc"), doc.cast("string")).alias("canonical_id"),
                F.substring("sentence", 1, 500).alias("action_text"),
                "action_category", "hazard_type"))


def _item(text: Column, category: Column | str, hazard: Column | str, confidence: Column | str
          ) -> Column:
    def col(v: Column | str) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    body = F.to_json(F.struct(text.alias("action_text"), col(category).alias("action_category"),
                              col(hazard).alias("hazard_type")))
    return F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"confidence":'),
                    col(confidence), F.lit("}"))


def _list(*items: Column) -> Column:
    parts: list[Column] = [F.lit('{"actions":[')]
    for i, item in enumerate(items):
        parts += ([F.lit(",")] if i else []) + [item]
    return F.concat(*parts, F.lit("]}"))


RESPONSE_CATEGORIES = ("adaptation", "mitigation", "both", "unrelated")
RESPONSE_HAZARDS = ("flood", "wildfire", "heat", "drought", "storm", "sea_level_rise",
                    "other", "none")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model response about every document, well-formed or broken by turns."""
    doc, text = F.col("doc_id"), F.col("text")
    turn = F.floor(doc / 7)
    hundredths = F.concat(F.lit("0."), F.lpad((doc % 100).cast("string"), 2, "0"))
    category = _pick(RESPONSE_CATEGORIES, turn % 4)
    hazard = _pick(RESPONSE_HAZARDS, turn % 8)
    good = _item(text, category, hazard, hundredths)
    bad = _list(F.to_json(F.array(text)), _item(text, "bogus", "heat", "0.5"),
                _item(text, "mitigation", "bogus", "5"))
    loose = _list(_item(F.lit("  "), "both", "heat", "0.9"),
                  _item(text, category, hazard, F.concat(F.lit('"'), hundredths, F.lit('"'))),
                  _item(text, "both", hazard, '"high"'))
    kind = doc % 7
    raw = (F.when(kind == 0, F.concat(F.lit("not json "), text))
           .when(kind == 1, F.to_json(F.array(text)))
           .when(kind == 2, '{"actions":[]}')
           .when(kind == 3, '{"actions":null}')
           .when(kind == 4, _list(good))
           .when(kind == 5, bad)
           .otherwise(loose))
    return documents(spark, sf_dir).select(
        F.concat(F.lit("doc"), doc.cast("string")).alias("canonical_id"), raw.alias("raw"))


def label_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-excerpt label response about every document."""
    doc, text = F.col("doc_id"), F.col("text")
    turn = F.floor(doc / 5)
    hundredths = F.concat(F.lit("0."), F.lpad((doc % 100).cast("string"), 2, "0"))
    category = _pick(RESPONSE_CATEGORIES, turn % 4)
    kind = doc % 5
    raw = (F.when(kind == 0, _item(text, category, _pick(RESPONSE_HAZARDS, turn % 8),
                                   hundredths))
           .when(kind == 1, _item(text, category, "bogus", "7"))
           .when(kind == 2, _item(text, "bogus", "heat", "0.9"))
           .when(kind == 3, F.concat(F.lit("not json "), text))
           .otherwise(_item(text, category, "heat", '"high"')))
    return documents(spark, sf_dir).select("doc_id", raw.alias("raw"))
