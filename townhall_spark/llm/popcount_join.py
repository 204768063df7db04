"""SimHash near-duplicates: fingerprints linked within a Hamming distance.

A fingerprint is embedded by the bit counts of its 32 segments of two bits. The
Manhattan distance of two embeddings is at most the Hamming distance, so fingerprints
within 4 bits are within 4 there, and within 2 in one half of the segments. Each half is
a grid with a cell per vector. Every fingerprint goes into its cell and all cells one
step away, so that two that are within 2 steps meet in a cell between them. In a cell
the fingerprints' exact distance decides.

Equal fingerprints are one row before that. Cells come sorted and are compared in numpy;
a cell that a group of near-copies fills hands out a tree of links, not its pairs, and
is cut into slices that meet pairwise if it is too large for one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall_spark.llm.common import stored, values
from townhall_spark.llm.components import components

WIDTH = 4
RADIUS = 4
SEED = 42
# Shingles whose bits are counted at once.
_COUNTED = 1 << 13
# Members up to which a cell's pairs are compared side by side.
SMALL_CELL = 8
# Members of a cell, or of a slice of it, that a task compares.
LARGE_CELL = 4096
# Cells one step away from a cell, and the cell.
_STEPS = 33
# Members whose distances to all others are computed at once.
_FRONT = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)
# The bit count of a two-bit segment holding 0, 1, 2 or 3.
_COUNT = np.array([0, 1, 1, 2], np.uint8)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash of all ``width``-word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(0, len(words) - width)
    spans = zip(starts[:last + 1].tolist(), ends[len(words) - 1 - last:].tolist(), strict=True)
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for _ in range(0, last + 1, _COUNTED):
        hashes = np.array([digest(line[a:b], SEED) for _, (a, b) in
                           zip(range(_COUNTED), spans)], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > last + 1).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 width: int = WIDTH) -> DataFrame:
    """(id, print) of every row; the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint(t, width)) for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())],
                                             ["id", "print"])
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, print long")


def embedding(prints: np.ndarray) -> np.ndarray:
    """(n x 32): the bit counts of the segments."""
    segments = np.stack([(prints >> np.uint64(2 * s)) & np.uint64(3) for s in range(32)], axis=1)
    return _COUNT[segments.astype(np.uint8)]


def cells(prints: np.ndarray, steps: bool) -> tuple[np.ndarray, np.ndarray]:
    """(cell, place of the fingerprint) of each half: its cell, and those a step away."""
    counts = embedding(prints).astype(np.int64)
    every, places = [], []
    for half in range(2):
        own = counts[:, 16 * half:16 * half + 16]
        # Two bits a segment, and a bit for the half.
        power = np.int64(1) << (2 * np.arange(16, dtype=np.int64))
        home = (own * power).sum(axis=1) | (np.int64(half) << 32)
        every.append(home)
        places.append(np.arange(len(prints)))
        for step in (1, -1) if steps else ():
            row, segment = np.nonzero((own + step >= 0) & (own + step <= 2))
            every.append(home[row] + step * power[segment])
            places.append(row)
    return np.concatenate(every), np.concatenate(places)


def _spread(steps: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            cell, place = cells(prints, steps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(prints[place].view(np.int64))], ["cell", "print"])
    return run


def _tree(members: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect the members of a cell as their distances do, a tree of them.

    A search from a member compares with those not yet reached, so a group of
    near-copies shrinks with its first searches.
    """
    waiting = members
    while len(waiting) > 1:
        root, waiting = waiting[0], waiting[1:]
        front = np.array([root], np.uint64)
        while len(front) and len(waiting):
            reached = np.zeros(len(waiting), bool)
            for at in range(0, len(front), _FRONT):
                reached |= (np.bitwise_count(front[at:at + _FRONT, None] ^ waiting)
                            <= radius).any(axis=0)
            front, waiting = waiting[reached], waiting[~reached]
            if len(front):
                yield np.full(len(front), root), front


def links(cell: np.ndarray, prints: np.ndarray, radius: int
          ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the fingerprints of each cell; ``cell`` is sorted."""
    bounds = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
    sizes = np.diff(bounds)
    for k in np.flatnonzero(sizes > SMALL_CELL):
        yield from _tree(np.unique(prints[bounds[k]:bounds[k + 1]]), radius)
    size = np.repeat(sizes, sizes)
    left = np.flatnonzero((size > 1) & (size <= SMALL_CELL))
    for shift in range(1, SMALL_CELL):
        left = left[left + shift < len(cell)]
        left = left[cell[left] == cell[left + shift]]
        a, b = prints[left], prints[left + shift]
        near = np.bitwise_count(a ^ b) <= radius
        yield a[near], b[near]


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b) of a partition's cells, which come sorted; a cell may span batches."""
        rest: list[tuple[np.ndarray, np.ndarray]] = []

        def out(cell: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in links(cell, prints, radius):
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(cell):
                continue
            at = int(np.searchsorted(cell, cell[-1]))
            if at or (rest and rest[0][0][0] != cell[-1]):
                rest.append((cell[:at], prints[:at]))
                yield from out(*map(np.concatenate, zip(*rest, strict=True)))
                rest = []
            rest.append((cell[at:], prints[at:]))
        if rest:
            yield from out(*map(np.concatenate, zip(*rest, strict=True)))
    return run


def _slices(prints: DataFrame) -> DataFrame:
    """(cell, slices) of cells that may have more than ``LARGE_CELL`` members.

    A cell holds the fingerprints at home there or a step away. Only homes of many count:
    the others together hold at most half of a large cell.
    """
    many = LARGE_CELL // (2 * _STEPS)
    homes = stored(prints.mapInArrow(_spread(False), "cell long, print long")
                   .groupBy("cell").agg(F.count(F.lit(1)).alias("members"))
                   .where(F.col("members") > many))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, members = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            every, counts = [home], [members]
            for segment in range(16):
                digit = (home >> (2 * segment)) & 3
                for step in (1, -1):
                    fits = (digit + step >= 0) & (digit + step <= 2)
                    every.append(home[fits] + (np.int64(step) << (2 * segment)))
                    counts.append(members[fits])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(every)), pa.array(np.concatenate(counts))],
                ["cell", "members"])

    most = F.sum("members") + LARGE_CELL // 2
    return stored(homes.mapInArrow(near, "cell long, members long").groupBy("cell").agg(
        F.ceil(most / LARGE_CELL).cast("long").alias("slices")).where("slices > 1"))


def _meetings(prints: DataFrame) -> DataFrame:
    """(cell, print): what meets, with large cells as pairs of slices."""
    placed = prints.mapInArrow(_spread(True), "cell long, print long")
    large = _slices(prints)
    if large.isEmpty():
        return placed
    own = F.pmod(F.xxhash64("print"), F.col("slices"))
    every = F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)
    pair = F.transform(every, lambda s: F.xxhash64(
        "cell", F.least(own, s), F.greatest(own, s)))
    return placed.join(large, "cell", "left").select(
        F.explode(F.when(F.col("slices").isNull(), F.array("cell")).otherwise(pair))
        .alias("cell"), "print")


def join(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(id, print, component) per row: fingerprint and the smallest id reachable by links.

    The fingerprint, a signed long, is the SimHash of the ``width``-word shingles of the
    whole text with A-Z lower-cased, repeats included; a shorter text is one shingle, and
    a null, empty or wordless one has fingerprint zero, which links like any other. Rows
    link when their fingerprints differ in at most ``radius`` bits; up to 4 the method
    finds every link, and more is refused. Rows without id take part and
    keep a null id; their component is null where no reachable row has an id. Repeated
    rows each give a row; an empty table gives an empty table; other columns are not
    read.
    """
    if not 0 <= radius <= 4:
        raise ValueError("two halves a step apart each find links of up to 4 bits")
    rows = stored(fingerprints(docs, key, text, width))
    prints = stored(rows.groupBy("print").agg(F.min("id").alias("least")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = (_meetings(prints.select("print")).repartition(parts, "cell")
             .sortWithinPartitions("cell").mapInArrow(_link(radius), "a long, b long"))
    labels = components(edges)
    labelled = stored(prints.join(labels.withColumnRenamed("node", "print"), "print", "left")
                      .withColumn("label", F.coalesce("label", "print")))
    least = labelled.groupBy("label").agg(F.min("least").alias("component"))
    classes = stored(labelled.join(least, "label").select("print", "component"))
    return rows.join(classes, "print").select("id", "print", "component")
