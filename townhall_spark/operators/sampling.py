"""Bounded, group-preserving and stratified samples.

Seeded choice ranks keys by a hash, so a sample is the same on any cluster and
in any engine. Group sizes come from one aggregate, never from a window over a
group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townhall_spark.functions.ids import hash_rank
from townhall_spark.operators.skew import top_k_per_group
from townhall_spark.schemas import ACTION_CATEGORIES

# Default sample size and seed, and how many multi-row groups are kept.
SAMPLE_SIZE = 200
SAMPLE_SEED = 42
MAX_GROUPS = 40


def bounded(rows: DataFrame, size: int, order: str = "ingest_seq") -> DataFrame:
    """The first ``size`` rows in arrival order; 0 means all of them."""
    return rows.orderBy(order).limit(size) if size else rows


def group_preserving_sample(rows: DataFrame, group_keys: Sequence[str],
                            size: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED) -> DataFrame:
    """Up to 40 multi-row groups kept whole, then single-row groups up to ``size`` rows.

    Groups are never cut, so the sample may exceed ``size``. At most
    ``40 + size`` keys are chosen; only they are ranked and broadcast.
    """
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None"))
                             for c in group_keys])
    keyed = rows.withColumn("_key", key)
    groups = (keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_hash", hash_rank(seed, F.col("_key"))))
    order = [F.col("_hash"), F.col("_key")]
    several = groups.where(F.col("_n") > 1).orderBy(*order).limit(MAX_GROUPS)
    singles = groups.where(F.col("_n") == 1).orderBy(*order).limit(size)
    kept_rows = F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).over(
        Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.col("_n") > 1).orderBy(*order))
    chosen = (several.unionByName(singles)
              .withColumn("_kept", kept_rows).withColumn("_rank", rank)
              .where((F.col("_n") > 1)
                     | (F.col("_rank") <= F.greatest(F.lit(size) - F.col("_kept"), F.lit(0)))))
    return keyed.join(F.broadcast(chosen.select("_key")), "_key", "left_semi").drop("_key")


def stratified_sample(actions: DataFrame, n: int, seed: int = SAMPLE_SEED,
                      key: Sequence[str] = ("canonical_id", "action_text")) -> DataFrame:
    """``max(n // 4, 1)`` actions of each of the four categories, chosen by hash."""
    per_category = max(n // 4, 1)
    unique = F.concat_ws("|", *key)
    return (top_k_per_group(
        actions.where(F.col("action_category").isin(*ACTION_CATEGORIES))
        .withColumn("_hash", hash_rank(seed, unique)),
        ["action_category"], [F.col("_hash")], per_category, F.col("_hash"))
        .drop("_hash"))
