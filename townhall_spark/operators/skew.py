"""Keeping one dominant key from becoming one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spread of one group over tasks in the first step of a two-step top-k.
TOP_K_SPREAD = 64


def top_k_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    spread: Column, buckets: int = TOP_K_SPREAD) -> DataFrame:
    """The first ``k`` rows of each group, exactly, without one task per group.

    ``spread`` is any value that varies within a group. Each group is first
    ranked in ``buckets`` slices, so the final step sees at most
    ``k * buckets`` rows per group.
    """
    group = list(group)
    slices = Window.partitionBy(*group, "_slice").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (rows.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(buckets)))
            .withColumn("_rank", F.row_number().over(slices)).where(F.col("_rank") <= k)
            .withColumn("_rank", F.row_number().over(final)).where(F.col("_rank") <= k)
            .drop("_slice", "_rank"))
