"""Sharding by largest differencing: shards of almost equal bytes, groups kept whole.

Documents with equal texts form an indivisible group. Groups are dealt by hash to
buckets of bounded size; in each bucket the Karmarkar-Karp method combines the two
partial partitions of largest spread in opposite order until one is left. Its
``n_shards`` sums are again a partial partition, so buckets are combined the same
way, in levels of bounded fan-in. No task sees all groups.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townhall_spark.llm.common import stored, text_or_empty

# Groups, or partial partitions, that one task combines.
BUCKET_GROUPS = 20_000
FAN_IN = 2_048
# Rows of one numbered slice of a shard.
SLICE_ROWS = 100_000


def differencing(sums: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over partial partitions.

    ``sums`` (m x k) are the bins' sizes of m partial partitions; the result (m x k)
    gives the final bin of each of their bins. Bins of one partial partition stay
    apart. Ties go to the earlier partition, so the result is deterministic.
    """
    m, k = sums.shape
    order = [tuple(int(b) for b in np.argsort(row, kind="stable")) for row in sums]
    value = [[int(row[b]) for b in o] for row, o in zip(sums, order, strict=True)]
    # A node's bins are kept ascending; `down` leads from a node's bins to its parent's.
    down: list[tuple[int, list[int]] | None] = [None] * m
    heap = [(v[0] - v[-1], i) for i, v in enumerate(value)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        raw = [x + y for x, y in zip(value[a], reversed(value[b]), strict=True)]
        rank = sorted(range(k), key=raw.__getitem__)
        to = [0] * k
        for place, i in enumerate(rank):
            to[i] = place
        new = len(value)
        value.append([raw[i] for i in rank])
        down[a], down[b] = (new, to), (new, to[::-1])
        down.append(None)
        value[a] = value[b] = []
        heapq.heappush(heap, (value[new][0] - value[new][-1], new))
    final: list[list[int]] = [[]] * len(down)
    for node in range(len(down) - 1, -1, -1):
        step = down[node]
        final[node] = list(range(k)) if step is None else [final[step[0]][i] for i in step[1]]
    out = np.empty((m, k), np.int32)
    for i in range(m):
        for place, b in enumerate(order[i]):
            out[i, b] = final[i][place]
    return out


def _combine_groups(n_shards: int):
    def combine(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "digest"], ascending=[False, True])
        sums = np.zeros((len(group), n_shards), np.int64)
        sums[:, 0] = group["bytes"]
        return group[["digest", "node", "bytes"]].assign(
            bin=differencing(sums)[:, 0].astype(np.int32))
    return combine


def _combine_nodes(n_shards: int):
    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = np.sort(rows["node"].unique())
        at = np.searchsorted(nodes, rows["node"])
        sums = np.zeros((len(nodes), n_shards), np.int64)
        sums[at, rows["bin"]] = rows["bytes"]
        to = differencing(sums)[at, rows["bin"]]
        return rows[["node", "bin", "parent", "bytes"]].assign(parent_bin=to.astype(np.int32))
    return combine


def assign_groups(groups: DataFrame, n_shards: int, bucket_groups: int = BUCKET_GROUPS,
                  fan_in: int = FAN_IN) -> DataFrame:
    """(digest, shard) for (digest, bytes), one row per indivisible group."""
    count = groups.count()
    n_nodes = max(1, math.ceil(count / bucket_groups))
    placed = stored(
        groups.withColumn("node", F.pmod(F.xxhash64("digest"), F.lit(n_nodes)))
        .groupBy("node").applyInPandas(
            _combine_groups(n_shards), "digest string, node long, bytes long, bin int"))
    way = None
    nodes = placed.groupBy("node", "bin").agg(F.sum("bytes").alias("bytes"))
    while True:
        level = stored(
            nodes.withColumn("parent", F.floor(F.col("node") / fan_in).cast("long"))
            .groupBy("parent").applyInPandas(
                _combine_nodes(n_shards),
                "node long, bin int, parent long, bytes long, parent_bin int"))
        step = level.select("node", "bin", "parent", "parent_bin")
        way = step if way is None else stored(
            way.join(step.select(F.col("node").alias("parent"), F.col("bin").alias("parent_bin"),
                                 F.col("parent").alias("_p"), F.col("parent_bin").alias("_b")),
                     ["parent", "parent_bin"])
            .select("node", "bin", F.col("_p").alias("parent"), F.col("_b").alias("parent_bin")))
        n_nodes = math.ceil(n_nodes / fan_in)
        if n_nodes == 1:
            break
        nodes = (level.groupBy(F.col("parent").alias("node"), F.col("parent_bin").alias("bin"))
                 .agg(F.sum("bytes").alias("bytes")))
    return placed.join(way, ["node", "bin"]).select("digest", F.col("parent_bin").alias("shard"))


def shard(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text",
          bucket_groups: int = BUCKET_GROUPS, fan_in: int = FAN_IN,
          slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(key, size, text_crc32, shard, slot): every row in one shard of balanced bytes.

    Size is the UTF-8 length plus 1; a null text counts as empty. Equal texts,
    repeated rows among them, share a shard. ``slot`` numbers a shard's rows from 0
    without gaps, by slices of the shard, ties by key, size and checksum. Rows without a
    key are placed as others are; other columns are not read, whatever they are called; an
    empty table gives an empty table.
    """
    light = stored(docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(text_or_empty(text)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty(text)).alias("text_crc32"),
        F.md5(text_or_empty(text)).alias("digest")))
    groups = light.groupBy("digest").agg(F.sum("size").alias("bytes"))
    where = assign_groups(groups, n_shards, bucket_groups, fan_in)
    slices = max(16, math.ceil(light.count() / n_shards / slice_rows))
    placed = stored(light.join(where, "digest").withColumn(
        "_slice", F.pmod(F.xxhash64("_key", "digest"), F.lit(slices)).cast("int")))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
               .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
               .drop("_rows"))
    inside = Window.partitionBy("shard", "_slice").orderBy("_key", "size", "text_crc32")
    numbered = placed.withColumn("_row", F.row_number().over(inside))
    return (numbered.join(offsets, ["shard", "_slice"])
            .select(F.col("_key").alias(key), "size", "text_crc32", "shard",
                    (F.col("_offset") + F.col("_row") - 1).cast("long").alias("slot")))
