"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall_spark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b) of longs: the smallest node that can be reached.

    Labels spread along edges and then jump to their label's label, so the number of
    rounds grows with the logarithm of a long chain. Every round is written to the
    shared folder; only a count comes back to the driver. A node with very many edges
    is a skewed join key, which adaptive execution splits.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"),
                                                          F.col("a").alias("b"))))
    both = stored(edges.where("a != b").select(ways.alias("e")).select("e.*").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                    .select("node", F.least("node", "least").alias("label")))
    while True:
        near = (both.join(labels, F.col("a") == F.col("node"))
                .groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near")))
        spread = stored(labels.join(near, "node").select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        jumped = stored(spread.join(
            spread.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
            .select("node", "was", F.col("next").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.where("was != label").isEmpty():
            return labels
