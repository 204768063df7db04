"""Domain and range validation that splits a table instead of aborting the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.schemas import (
    ACTION_CATEGORIES,
    HAZARD_TYPES,
    MEETING_TYPES,
    TRANSCRIPT_QUALITIES,
)


def _outside(name: str, values: tuple[str, ...], nullable: bool = False) -> Column:
    bad = ~F.col(name).isin(*values)
    return F.coalesce(bad, F.lit(not nullable))


MEETING_RULES = {
    "canonical_id": lambda: F.col("canonical_id").isNull(),
    "jurisdiction_name": lambda: F.col("jurisdiction_name").isNull(),
    "jurisdiction_fips": lambda: F.col("jurisdiction_fips").isNull(),
    "state": lambda: F.col("state").isNull(),
    "meeting_date": lambda: F.col("meeting_date").isNull(),
    "meeting_type": lambda: _outside("meeting_type", MEETING_TYPES),
    "transcript_quality": lambda: _outside("transcript_quality", TRANSCRIPT_QUALITIES),
    "source": lambda: F.col("source").isNull(),
    "source_url": lambda: F.col("source_url").isNull(),
    "source_record_id": lambda: F.col("source_record_id").isNull(),
}

ACTION_RULES = {
    "canonical_id": lambda: F.col("canonical_id").isNull(),
    "action_text": lambda: F.col("action_text").isNull(),
    "action_category": lambda: _outside("action_category", ACTION_CATEGORIES),
    "hazard_type": lambda: _outside("hazard_type", HAZARD_TYPES, nullable=True),
    "confidence": lambda: ~F.coalesce(
        F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence"), F.lit(False)),
    "model_version": lambda: F.col("model_version").isNull(),
}


def with_violations(df: DataFrame, rules: dict) -> DataFrame:
    """Adds ``violations``: the names of the fields that break a rule, in rule order."""
    found = F.array(*[F.when(rule(), F.lit(name)) for name, rule in rules.items()])
    return df.withColumn("violations", F.array_compact(found))


def check_domain(df: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their ``violations``)."""
    checked = with_violations(df, rules)
    valid = checked.where(F.size("violations") == 0).drop("violations")
    return valid, checked.where(F.size("violations") > 0)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns back to null."""
    columns = []
    for field in df.schema.fields:
        col = F.col(field.name)
        if field.dataType.typeName() in ("double", "float"):
            col = F.when(~F.isnan(col), col).alias(field.name)
        columns.append(col)
    return df.select(*columns)
