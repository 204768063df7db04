"""Table schemas and value domains.

``ingest_seq`` and ``transcript_chars`` are additions of this library: the first
makes the arrival order explicit (ties and merges depend on it), the second lets
linking rank records without reading transcripts again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The value domains of the stored tables.
MEETING_TYPES = ("council_full", "committee", "special", "workshop", "executive", "other")
TRANSCRIPT_QUALITIES = ("full_text", "summary", "metadata_only")
ACTION_CATEGORIES = ("adaptation", "mitigation", "both", "unrelated")
CLIMATE_CATEGORIES = ("adaptation", "mitigation", "both")
ADAPTATION_CATEGORIES = ("adaptation", "both")
HAZARD_TYPES = (
    "flood", "wildfire", "heat", "drought", "storm", "sea_level_rise", "other", "none",
)

# Rank of a transcript's quality, higher wins.
QUALITY_RANK = {"full_text": 3, "summary": 2, "metadata_only": 1}

# Hazard tag -> risk score column of the county risk table.
HAZARD_RISK_COLUMNS = {
    "flood": "IFLD_RISKS",
    "sea_level_rise": "CFLD_RISKS",
    "wildfire": "WFIR_RISKS",
    "heat": "HWAV_RISKS",
    "drought": "DRGT_RISKS",
    "storm": "HRCN_RISKS",
}


# A sortable place of a row in the files it was read from.
ROW_ORDER = "row_order"


CANONICAL_MEETING = T.StructType([
    T.StructField("canonical_id", T.StringType(), nullable=False),
    T.StructField("jurisdiction_name", T.StringType()),
    T.StructField("jurisdiction_fips", T.StringType(), nullable=False),
    T.StructField("state", T.StringType()),
    T.StructField("meeting_date", T.DateType(), nullable=False),
    T.StructField("meeting_type", T.StringType(), nullable=False),
    T.StructField("transcript", T.StringType()),
    T.StructField("transcript_quality", T.StringType(), nullable=False),
    T.StructField("source", T.StringType(), nullable=False),
    T.StructField("source_url", T.StringType()),
    T.StructField("source_record_id", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("ingest_seq", T.LongType()),
    T.StructField("transcript_chars", T.LongType()),
])

ACTION = T.StructType([
    T.StructField("canonical_id", T.StringType(), nullable=False),
    T.StructField("action_text", T.StringType(), nullable=False),
    T.StructField("action_category", T.StringType(), nullable=False),
    T.StructField("hazard_type", T.StringType()),
    T.StructField("confidence", T.DoubleType(), nullable=False),
    T.StructField("model_version", T.StringType(), nullable=False),
    T.StructField("extracted_at", T.TimestampType()),
])

PROVENANCE_LINK = T.StructType([
    T.StructField("canonical_id", T.StringType(), nullable=False),
    T.StructField("source", T.StringType(), nullable=False),
    T.StructField("source_record_id", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("transcript_quality", T.StringType()),
    T.StructField("is_primary", T.BooleanType(), nullable=False),
])

CONFLICT = T.StructType([
    T.StructField("canonical_id", T.StringType(), nullable=False),
    T.StructField("field", T.StringType(), nullable=False),
    T.StructField("source_a", T.StringType()),
    T.StructField("value_a", T.StringType()),
    T.StructField("source_b", T.StringType()),
    T.StructField("value_b", T.StringType()),
    T.StructField("resolved_value", T.StringType()),
    T.StructField("note", T.StringType()),
])

COUNTY_RISK = T.StructType([
    T.StructField("STCOFIPS", T.StringType(), nullable=False),
    T.StructField("STATEABBRV", T.StringType()),
    T.StructField("COUNTY", T.StringType()),
    T.StructField("POPULATION", T.LongType()),
    T.StructField("RISK_SCORE", T.DoubleType()),
    T.StructField("IFLD_RISKS", T.DoubleType()),
    T.StructField("CFLD_RISKS", T.DoubleType()),
    T.StructField("WFIR_RISKS", T.DoubleType()),
    T.StructField("HWAV_RISKS", T.DoubleType()),
    T.StructField("DRGT_RISKS", T.DoubleType()),
    T.StructField("HRCN_RISKS", T.DoubleType()),
])

PLACE_TO_COUNTY = T.StructType([
    T.StructField("place_fips", T.StringType()),
    T.StructField("county_fips", T.StringType()),
])

CROSSWALK = T.StructType([
    T.StructField("jurisdiction_name", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("fips", T.StringType()),
    T.StructField("fips_type", T.StringType()),
])

EXPOSURE = T.StructType([
    T.StructField("canonical_id", T.StringType(), nullable=False),
    T.StructField("county_fips", T.StringType()),
    T.StructField("county_name", T.StringType()),
    T.StructField("overall_risk", T.DoubleType()),
    *[T.StructField(f"risk_{hazard}", T.DoubleType()) for hazard in HAZARD_RISK_COLUMNS],
])

GOLDEN = T.StructType([
    T.StructField("canonical_id", T.StringType()),
    T.StructField("action_text", T.StringType(), nullable=False),
    T.StructField("action_category", T.StringType(), nullable=False),
    T.StructField("hazard_type", T.StringType()),
    T.StructField("label_source", T.StringType()),
    T.StructField("labelled_at", T.TimestampType()),
])

RESPONSE = T.StructType([
    T.StructField("canonical_id", T.StringType(), nullable=False),
    T.StructField("raw", T.StringType()),
])

RAW_SEGMENT = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("transcript", T.StringType()),
])


def quality_rank(quality: Column) -> Column:
    """3 for full text, 2 for a summary, 1 for metadata only."""
    expr = None
    for name, rank in QUALITY_RANK.items():
        expr = (F.when(quality == name, rank) if expr is None
                else expr.when(quality == name, rank))
    return expr.otherwise(0)
