"""Numbering rows in order, of a table or of each group, without gathering either.

Rows are sorted by ranges over all tasks, so a group of any size lies in as many
slices as it needs. Each slice is numbered on its own; what comes before a slice is the
sum over the slices before it, of which there are no more than tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townhall_spark.sources.sinks import stored


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], width: str) -> DataFrame:
    """``rows`` with ``_number`` (from 0), ``_before`` and ``_total`` of their group.

    ``_before`` is the sum of ``width``, a long, over the rows before, and ``_total``
    that over the group. Groups have equal ``keys``; without keys the table is one
    group. ``order`` must tell the rows of a group apart. ``rows`` should be narrow:
    they are written once to the scratch folder, so that slices stay as they are.
    """
    keys, order = list(keys), list(order)
    sliced = stored(rows.repartitionByRange(*keys, *order)
                    .withColumn("_slice", F.spark_partition_id()))
    at = Window.partitionBy(*keys, "_slice").orderBy(*order)
    inside = (sliced.withColumn("_row", F.row_number().over(at) - 1)
              .withColumn("_sum", F.sum(width).over(
                  at.rowsBetween(Window.unboundedPreceding, 0)) - F.col(width)))
    of_slices = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    slices = (sliced.groupBy(*keys, "_slice")
              .agg(F.count(F.lit(1)).alias("_rows"), F.sum(width).alias("_width"))
              .withColumn("_first", F.coalesce(F.sum("_rows").over(of_slices), nothing))
              .withColumn("_start", F.coalesce(F.sum("_width").over(of_slices), nothing))
              .withColumn("_total", F.sum("_width").over(Window.partitionBy(*keys)))
              .select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
                      F.col("_slice").alias("_of"), "_first", "_start", "_total"))
    same = F.col("_slice") == F.col("_of")
    for i, key in enumerate(keys):
        same &= F.col(key).eqNullSafe(F.col(f"_key{i}"))
    return inside.join(slices, same).select(
        *rows.columns, (F.col("_row") + F.col("_first")).alias("_number"),
        (F.col("_sum") + F.col("_start")).alias("_before"), "_total")
