"""Choosing label candidates and merging labels into the golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.functions.regions import lookup
from townhall_spark.functions.text import or_none, ustrip
from townhall_spark.operators.sampling import SAMPLE_SEED, stratified_sample

# One-letter label codes.
CATEGORY_CODES = {"a": "adaptation", "m": "mitigation", "b": "both", "u": "unrelated"}
HAZARD_CODES = {
    "f": "flood", "w": "wildfire", "h": "heat", "d": "drought",
    "s": "storm", "l": "sea_level_rise", "o": "other", "n": "none",
}


def apply_code(code: Column, codes: dict[str, str], guess: Column) -> Column:
    """Meaning of a typed code; empty or unknown keeps the guess."""
    return lookup(codes, F.lower(ustrip(code)), guess)


def label_candidates(actions: DataFrame, golden: DataFrame, n: int,
                     seed: int = SAMPLE_SEED) -> DataFrame:
    """Stratified candidates whose text has no label yet, one per text.

    There are at most about ``n`` candidates, so the golden set is only
    filtered by them and never shuffled whole.
    """
    first = F.min(F.struct("canonical_id", "action_category", "hazard_type", "confidence"))
    candidates = (stratified_sample(actions, n, seed).groupBy("action_text")
                  .agg(first.alias("c")).select("action_text", "c.*"))
    labelled = golden.join(F.broadcast(candidates.select("action_text")), "action_text",
                           "left_semi").select("action_text").distinct()
    return candidates.join(F.broadcast(labelled), "action_text", "left_anti")


def label(candidates: DataFrame, category_code: Column, hazard_code: Column,
          label_source: str) -> DataFrame:
    """Golden rows from candidates and the codes typed for them."""
    return candidates.select(
        "canonical_id", "action_text",
        apply_code(category_code, CATEGORY_CODES, F.col("action_category"))
        .alias("action_category"),
        apply_code(hazard_code, HAZARD_CODES, or_none(F.col("hazard_type")))
        .alias("hazard_type"),
        F.lit(label_source).alias("label_source"))
