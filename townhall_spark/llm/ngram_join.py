"""N-gram Jaccard join: documents linked by the overlap of their shingle sets.

Exact, in three steps:

1. Document frequencies of all shingles. Each task deals its shingles to buckets by
   hash, as packed arrays, a frequent one once with its count; a bucket counts them and
   sends back those that several documents have. A document orders its shingles from rare to frequent. Two linked
   documents share one of the few rarest of each (prefix filter), whatever the
   order, so only shared shingles in that prefix make candidates. Frequent
   passages are in the prefix only of documents that hold little else.
2. Documents that share such a shingle, and are of similar size, form a candidate
   group. Groups are cut into cells of bounded size, so that any two documents that
   may link meet in a cell.
3. In each cell a T-occurrence search over inverted lists: short lists are merged by
   a heap, long ones are probed by binary search (DivideSkip), and documents with
   the required overlap are linked. Links only have to connect what is not yet
   connected, so documents of a cell's largest group need not search. A large cell is
   cut into slices, and searches meet every slice.

Components of the links, over all cells, are the result.
"""

from __future__ import annotations

import heapq
import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.llm.common import (
    WordHashes,
    shingle_set,
    stored,
    text_or_empty,
    values,
)
from townhall_spark.llm.components import components
from townhall_spark.operators.skew import top_k_per_group

# Shingles of one block of documents and of one bucket, at least. Both grow with the root
# of the corpus, so that what a block sends to a bucket is at least PACKED shingles.
LEAST_BLOCK = 1 << 20
PACKED = 64
# A shingle that more documents of a block hold, and more than one in so many, is counted
# there and sent to its bucket once.
FREQUENT = 32
# Text bytes to a word, about; only sizes of blocks and buckets depend on it.
WORD_BYTES = 6
# Documents of one slice of a cell, and its shingles; a task holds two slices.
LEAST_SLICE = 256
MOST_SLICE = 4096
SLICE_SHINGLES = 4 << 20
# Documents of a cell of several slices that search before all others.
FIRST_SEARCHES = 8
# Weight of list length against probing, as published for DivideSkip.
MU = 0.0085
# Rows without an id get internal ids from here on.
NO_ID = 1 << 62


def required(n: int, m: int, percent: int) -> int:
    """The least overlap at which sets of ``n`` and ``m`` shingles link."""
    return -(-percent * (n + m) // (100 + percent))


def _ids(key: str, text: str) -> Column:
    """The row's id; rows without one get one from their text, above all others."""
    return F.coalesce(F.col(key).cast("long"),
                      F.lit(NO_ID) + F.pmod(F.xxhash64(text_or_empty(text)), F.lit(1 << 60)))


def _deal(width: int, bits: int, block_shingles: int):
    """Blocks of documents: per bucket the shingles' keys and how many each document has."""
    names = [c.split()[0] for c in _DEALT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, block = WordHashes(), TaskContext.get().partitionId() << 32
        ids, digests, sets, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, ids, digests, sets, total
            sizes = np.array([len(s) for s in sets], np.uint32)
            shingles = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
            # What many documents of a block hold goes to its bucket once, with its count;
            # who holds it goes with the block's own data.
            order = np.argsort(shingles)
            every = shingles[order]
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            times = np.diff(np.append(starts, len(every)))
            many = times > max(FREQUENT, len(sets) // FREQUENT)
            often, counted = every[starts[many]], times[many].astype(np.uint32)
            # Places of the frequent ones' occurrences, one shingle after the other.
            at = order[np.repeat(many, times)]
            del order, every, starts
            places = np.repeat(np.arange(len(counted), dtype=np.uint32), counted)
            holders = doc[at].astype(np.uint32)
            shingles, doc = np.delete(shingles, at), np.delete(doc, at)
            shift = np.uint64(64 - bits)
            bucket = (shingles >> shift).astype(np.min_scalar_type((1 << bits) - 1))
            order = np.argsort(bucket, kind="stable")
            keys = (shingles >> np.uint64(32 - bits)).astype(np.uint32)[order]
            ends = np.cumsum(np.bincount(bucket, minlength=1 << bits))
            bounds = np.searchsorted((often >> shift).astype(np.int64), np.arange((1 << bits) + 1))
            often = (often >> np.uint64(32 - bits)).astype(np.uint32)
            home, rows = block % (1 << bits), []
            for b in range(1 << bits):
                own = slice(ends[b - 1] if b else 0, ends[b])
                counts = np.bincount(doc[order[own]], minlength=len(sets))
                of = slice(bounds[b], bounds[b + 1])
                rows.append((block, b, len(sets), keys[own].tobytes(),
                             counts.astype(np.min_scalar_type(counts.max())).tobytes(),
                             often[of].tobytes(), counted[of].tobytes(),
                             *((np.array(ids, np.int64).tobytes(), b"".join(digests),
                                sizes.tobytes(), places.tobytes(), holders.tobytes())
                               if b == home else [None] * 5)))
            block, ids, digests, sets, total = block + 1, [], [], [], 0
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
                 pa.array(columns[2], pa.int32()),
                 *[pa.array(c, pa.binary()) for c in columns[3:]]], names)

        for batch in batches:
            for key, digest, text in zip(*map(values, batch.columns), strict=True):
                found = shingle_set(text, width, seen)
                ids.append(key)
                digests.append(digest)
                sets.append(found)
                total += len(found)
                if total >= block_shingles or len(sets) >= block_shingles // PACKED:
                    yield flush()
        if sets:
            yield flush()
    return run


_OWN = "ids binary, digests binary, sizes binary, places binary, holders binary"
_DEALT = ("block long, bucket int, docs int, keys binary, counts binary, often binary, "
          f"times binary, {_OWN}")
_SHARED = ("block long, bucket int, keys binary, docs binary, ranks binary, often_ranks binary, "
           f"often binary, {_OWN}")
_NODES = "id long, digest binary, n long, tokens array<long>"


def _count(rows: pa.Table) -> pa.Table:
    """A bucket's shingles that several documents have, with their rank of frequency."""
    keys = [np.frombuffer(k, np.uint32) for k in rows.column("keys").to_pylist()]
    often = [np.frombuffer(k, np.uint32) for k in rows.column("often").to_pylist()]
    once = sum(map(len, keys))
    _, where = np.unique(np.concatenate(keys + often), return_inverse=True)
    times = np.bincount(where, np.concatenate(
        [np.ones(once), *[np.frombuffer(t, np.uint32) for t in rows.column("times").to_pylist()]]))
    # The rank is all that matters, and equal for equal shingles: logarithmic steps do.
    rank = np.minimum(255, np.floor(8 * np.log2(np.maximum(times, 1)))).astype(np.uint8)
    out, at, of = [], 0, once
    for key, counts, n, some in zip(keys, rows.column("counts").to_pylist(),
                                    rows.column("docs").to_pylist(), often, strict=True):
        own = where[at:at + len(key)]
        at += len(key)
        shared = times[own] > 1
        # The counts of a block's n documents are as wide as the largest needs.
        docs = np.repeat(np.arange(n, dtype=np.min_scalar_type(n)),
                         np.frombuffer(counts, f"u{len(counts) // n}"))
        out.append((key[shared].tobytes(), docs[shared].tobytes(), rank[own][shared].tobytes(),
                    rank[where[of:of + len(some)]].tobytes()))
        of += len(some)
    columns = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)]
    return pa.table([rows.column("block"), rows.column("bucket"), *columns,
                     *[rows.column(c) for c in
                       ("often", "ids", "digests", "sizes", "places", "holders")]],
                    names=[c.split()[0] for c in _SHARED.split(", ")])


def _prefixes(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        """Per document its rarest shared shingles, as many as the prefix leaves room for."""
        parts = {c: rows.column(c).to_pylist() for c in rows.column_names}
        first = next(i for i, ids in enumerate(parts["ids"]) if ids is not None)
        ids = np.frombuffer(parts["ids"][first], np.int64)
        digests = parts["digests"][first]
        n = np.frombuffer(parts["sizes"][first], np.uint32).astype(np.int64)
        keys = np.concatenate([(np.int64(b) << 32) | np.frombuffer(k, np.uint32).astype(np.int64)
                               for b, k in zip(parts["bucket"], parts["keys"], strict=True)])
        place = np.min_scalar_type(len(ids))
        docs = np.concatenate([np.frombuffer(d, place) for d in parts["docs"]]).astype(np.int64)
        ranks = np.concatenate([np.frombuffer(r, np.uint8) for r in parts["ranks"]])
        # Frequent shingles are numbered by hash, so by bucket and key.
        by_bucket = np.argsort(parts["bucket"])
        often = np.concatenate([(np.int64(parts["bucket"][i]) << 32) | np.frombuffer(
            parts["often"][i], np.uint32).astype(np.int64) for i in by_bucket])
        often_ranks = np.concatenate([np.frombuffer(parts["often_ranks"][i], np.uint8)
                                      for i in by_bucket])
        places = np.frombuffer(parts["places"][first], np.uint32)
        keys = np.concatenate([keys, often[places]])
        docs = np.concatenate([docs, np.frombuffer(parts["holders"][first], np.uint32)
                               .astype(np.int64)])
        ranks = np.concatenate([ranks, often_ranks[places]])
        order = np.lexsort((keys, ranks, docs))
        keys, docs = keys[order], docs[order]
        shared = np.bincount(docs, minlength=len(n))
        # The prefix: without it, fewer shingles are left than a link requires.
        prefix = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
        room = np.clip(prefix - (n - shared), 0, shared)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(shared) - shared, shared)
        kept = keys[place < room[docs]]
        offsets = np.concatenate([[0], np.cumsum(room)]).astype(np.int32)
        return pa.table([
            pa.array(ids), pa.array([digests[i:i + 16] for i in range(0, len(digests), 16)],
                                    pa.binary()),
            pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept))],
            names=["id", "digest", "n", "tokens"])
    return run


def _nodes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, digest, n, tokens) per row: its set's size and the shingles to match by."""
    shingles = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WORD_BYTES + 1
    block = max(LEAST_BLOCK, math.isqrt(PACKED * shingles))
    bits = max(3, math.ceil(math.log2(shingles / block)))
    dealt = docs.select("id", F.unhex(F.md5("text")).alias("digest"), "text").mapInArrow(
        _deal(width, bits, block), _DEALT)
    shared = dealt.groupBy("bucket").applyInArrow(_count, _SHARED)
    return stored(shared.groupBy("block").applyInArrow(_prefixes(percent), _NODES))


class _Groups:
    """Union-find over a cell's documents."""

    def __init__(self, n: int):
        self.parent, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.parent[b] = a
            self.size[a] += self.size[b]


class Index:
    """Inverted lists over documents numbered by ascending set size."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = [len(s) for s in sets]
        every = np.concatenate(sets)
        docs = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        shared, starts = np.unique(every[order], return_index=True)
        ends = np.append(starts[1:], len(every))
        several = ends - starts > 1
        listed = docs[order]
        self.lists = {s: listed[a:b].tolist() for s, a, b in zip(
            shared[several].tolist(), starts[several].tolist(), ends[several].tolist(),
            strict=True)}
        self.sets = sets

    def search(self, doc: int) -> list[int]:
        """The other documents whose overlap with ``doc`` reaches what a link requires."""
        n = self.sizes[doc]
        low = bisect_left(self.sizes, -(-self.percent * n // 100))
        high = bisect_left(self.sizes, 100 * n // self.percent + 1)
        least = required(n, self.sizes[low], self.percent)
        lists = []
        for token in self.sets[doc].tolist():
            found = self.lists.get(token)
            if found:
                if found[0] < low or found[-1] >= high:
                    found = found[bisect_left(found, low):bisect_left(found, high)]
                lists.append(found)
        if len(lists) < least:
            return []
        lists.sort(key=len)
        n_long = min(least - 1, int(least / (MU * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[:len(lists) - n_long], lists[len(lists) - n_long:]
        out = []
        for other, hits in groupby(heapq.merge(*short)):
            count = sum(1 for _ in hits)
            if other == doc or count < least - n_long:
                continue
            need = required(n, self.sizes[other], self.percent)
            for left, found in zip(range(len(long), 0, -1), long, strict=True):
                if count >= need or count + left < need:
                    break
                at = bisect_left(found, other)
                count += at < len(found) and found[at] == other
            if count >= need:
                out.append(other)
        return out


def linked(sets: list[np.ndarray], percent: int, asking: list[int] | None = None) -> list[int]:
    """For each set a representative of its component under links; exact.

    With ``asking`` only those sets search, and links between others are not looked
    for. Otherwise all links count: one between two components has an end outside
    the largest, so it is enough that all documents outside it have searched.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    index = Index([sets[i] for i in order], percent)
    groups, searched = _Groups(len(sets)), [len(s) == 0 for s in index.sets]
    largest, only = 0, None if asking is None else set(asking)

    def settled(doc: int) -> bool:
        if searched[doc] or only is not None:
            return searched[doc] or order[doc] not in only
        top = groups.find(largest)
        return groups.size[top] > 1 and groups.find(doc) == top

    while waiting := [d for d in range(len(sets)) if not settled(d)]:
        for doc in waiting:
            if settled(doc):
                continue
            searched[doc] = True
            for other in index.search(doc):
                groups.union(doc, other)
            if groups.size[groups.find(doc)] > groups.size[groups.find(largest)]:
                largest = doc
    back = [0] * len(sets)
    for place, i in enumerate(order):
        back[i] = order[groups.find(place)]
    return back


def _join_cell(width: int, percent: int):
    def run(rows: pa.Table) -> pa.Table:
        """(a, b): each document of a cell and its component's representative there."""
        seen = WordHashes()
        ids = rows.column("id").to_pylist()
        asks = rows.column("asks").to_pylist()
        sets = [shingle_set(t, width, seen) for t in values(rows.column("text"))]
        asking = None if None in asks else [i for i, a in enumerate(asks) if a]
        roots = linked(sets, percent, asking)
        pairs = [(ids[i], ids[r]) for i, r in enumerate(roots) if ids[i] != ids[r]]
        return pa.table([pa.array([p[0] for p in pairs], pa.int64()),
                         pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])
    return run


def _cell(*, of: str = "0", by: str = "0") -> Column:
    """The task of a cell's slice ``of`` and block of searching documents ``by``."""
    return F.expr(f"struct(label, at, CAST({of} AS BIGINT) AS slice, CAST({by} AS BIGINT) AS block)")


class _Cells(NamedTuple):
    """``small``: (id, cell, asks) of cells that one task searches in full. ``large``: the
    members of the others, with the ``slice`` of the cell that they are in."""

    small: DataFrame
    large: DataFrame


def _cells(members: DataFrame) -> _Cells:
    """The cells in which a document meets all it may link with.

    Size classes are a little wider than the least ratio of linked sizes, so linked
    documents are in one class or in neighbouring ones; a cell of a group holds two
    neighbouring classes. Slices of a cell grow with the root of its documents, so
    that slices and searches of slices both stay bounded for long.
    """
    placed = stored(members.select(
        "id", "n", "label", "class", F.explode(F.array(F.col("class"), F.col("class") + 1))
        .alias("at")))
    size = F.greatest(F.lit(LEAST_SLICE), F.least(F.lit(MOST_SLICE), 6 * F.sqrt("docs")))
    slices = F.ceil(F.greatest(F.col("docs") / size, F.col("shingles") / SLICE_SHINGLES))
    sizes = stored(placed.groupBy("label", "at").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"),
        F.max("class").alias("most")).where("docs > 1 and most = at")
        .select("label", "at", slices.cast("long").alias("slices")))
    cells = placed.select("id", "label", "at").join(sizes, ["label", "at"])
    return _Cells(
        stored(cells.where("slices = 1").select(
            "id", _cell().alias("cell"), F.lit(None).cast("boolean").alias("asks"))),
        stored(cells.where("slices > 1").withColumn(
            "slice", F.pmod(F.xxhash64("id"), F.col("slices")))))


def _search(rows: DataFrame, tasks: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): connected pairs that the tasks (id, cell, asks) find."""
    tasks = stored(tasks)
    # A short list of ids reaches all tasks by Spark's own size check; then only the texts
    # of candidates are shuffled. A long one is one more use of the same shuffle by id.
    wanted = stored(tasks.select("id").distinct())
    texts = rows.join(wanted, "id", "left_semi").join(tasks, "id")
    # Cells are few bytes and much work: a number of partitions that is asked for keeps
    # adaptive execution from putting many of them into one task.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(texts.repartition(parts, "cell").groupBy("cell").applyInArrow(
        _join_cell(width, percent), "a long, b long"))


def _search_large(rows: DataFrame, large: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of cells of several slices: searches of documents against every slice.

    First a few documents of each cell search, which connects most of a large group
    of near-copies. A link between components has an end outside of the cell's largest
    one, so then all documents outside of it search, in blocks.
    """
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    no, yes = F.lit(False).alias("asks"), F.lit(True).alias("asks")
    few = top_k_per_group(large, ["label", "at"], [F.xxhash64("id"), F.col("id")], FIRST_SEARCHES,
                          F.col("id"))
    first = _search(rows, large.select("id", _cell(of="slice").alias("cell"), no).unionByName(
        few.withColumn("of", slices).select("id", _cell(of="of").alias("cell"), yes)),
        width, percent)
    labels = components(first).select(F.col("node").alias("id"), F.col("label").alias("found"))
    grouped = stored(large.join(labels, "id", "left").withColumn(
        "found", F.coalesce("found", "id")))
    largest = (grouped.groupBy("label", "at", "found").agg(F.count(F.lit(1)).alias("docs"))
               .groupBy("label", "at").agg(F.max(F.struct("docs", "found")).alias("top"))
               .select("label", "at", F.col("top.found").alias("found")))
    outside = stored(grouped.join(largest, ["label", "at", "found"], "left_anti"))
    blocks = outside.groupBy("label", "at").agg(F.count(F.lit(1)).alias("searches"))
    size = F.greatest(F.lit(LEAST_SLICE), F.least(F.lit(MOST_SLICE), 6 * F.sqrt("searches")))
    blocks = stored(blocks.select("label", "at", F.ceil(F.col("searches") / size).cast("long")
                                  .alias("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    held = (large.join(blocks, ["label", "at"]).withColumn("by", every)
            .select("id", _cell(of="slice", by="by").alias("cell"), no))
    asked = (outside.join(blocks, ["label", "at"])
             .withColumn("by", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")))
             .withColumn("of", slices).select("id", _cell(of="of", by="by").alias("cell"), yes))
    return first.unionByName(_search(rows, held.unionByName(asked), width, percent))


def _apart(table: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``table`` (id, digest, ...) with ``node``: an id for every text of an id.

    The text of the smallest digest has the id itself, others get internal ids.
    """
    if repeated is None:
        return table.withColumn("node", F.col("id"))
    other = F.col("keeps").isNotNull() & (F.col("digest") != F.col("keeps"))
    inner = F.lit(NO_ID) + F.pmod(F.xxhash64("id", "digest"), F.lit(1 << 60))
    return table.join(repeated, "id", "left").withColumn(
        "node", F.when(other, inner).otherwise(F.col("id"))).drop("keeps")


def _classes(docs: DataFrame, width: int, percent: int, key: str, text: str, by_id: bool
             ) -> DataFrame:
    """(id, digest, n, component) per row; with ``by_id`` texts of one id are connected."""
    rows = docs.select(_ids(key, text).alias("id"), text_or_empty(text).alias("text"))
    nodes = _nodes(rows, width, percent)
    repeated = stored(nodes.groupBy("id").agg(F.min("digest").alias("keeps"),
                                              F.max("digest").alias("last"))
                      .where("keeps <> last").select("id", "keeps"))
    if repeated.isEmpty():
        repeated = None
    else:
        rows = rows.withColumn("digest", F.unhex(F.md5("text")))
        nodes = stored(_apart(nodes, repeated))
    nodes = nodes if repeated is not None else _apart(nodes, None)
    rows = _apart(rows, repeated).select(F.col("node").alias("id"), "text")
    some = nodes.where((F.col("n") > 0) & (F.size("tokens") > 0))
    # Equal texts have equal tokens and become one; the step combines before its shuffle.
    distinct = stored(some.groupBy("digest").agg(
        F.min("node").alias("id"), F.max("n").alias("n"), F.max("tokens").alias("tokens")))
    ratio = 1.001 * math.log(100 / percent)
    classed = distinct.withColumn("class", F.floor(F.log("n") / ratio).cast("long"))
    # A hub is a shingle and a size class; the next class's documents are in it, too.
    at_hubs = stored(classed.select("id", F.explode("tokens").alias("token"), "class").select(
        "id", F.explode(F.array(F.xxhash64("token", "class"),
                                F.xxhash64("token", F.col("class") + 1))).alias("hub")))
    hubs = stored(at_hubs.groupBy("hub").agg(F.min("id").alias("least"), F.max("id").alias("most"))
                  .where("least < most"))
    near = at_hubs.join(hubs, "hub").select(F.col("id").alias("a"), F.col("least").alias("b"))
    labels = components(near)
    members = classed.select("id", "n", "class").join(
        labels.withColumnRenamed("node", "id"), "id")
    cells = _cells(members)
    links = _search(rows, cells.small, width, percent)
    if not cells.large.isEmpty():
        links = links.unionByName(_search_large(rows, cells.large, width, percent))
    own = some.join(distinct.select("digest", F.col("id").alias("least")), "digest").select(
        F.col("node").alias("a"), F.col("least").alias("b"))
    links = links.unionByName(own.where("a != b"))
    if by_id and repeated is not None:
        links = links.unionByName(nodes.where("node <> id").select(
            F.col("node").alias("a"), F.col("id").alias("b")))
    joined = components(links)
    named = nodes.select("id", "digest", "n", "node").join(
        joined.select("node", "label"), "node", "left")
    return named.select("id", "digest", "n", F.coalesce("label", "node").alias("component"))


def join(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(id, n, component) per row: set size and the smallest id reachable by links.

    A set holds the distinct ``width``-word shingles of the whole lower-cased text; a
    shorter text is one shingle; null, empty and wordless texts have none and link with
    nothing. Two rows link when the overlap is at least ``percent`` per cent of the
    union. Rows of one id count as one document, which links as any of its texts does.
    A row without id gets an internal one (``NO_ID`` and above) that is never the
    smallest where there is a real one. Repeated rows each give a row; an empty table
    gives an empty table; other columns are not read. The join runs when it is called:
    its steps are written to the scratch folder.
    """
    return _classes(docs, width, percent, key, text, True).select("id", "n", "component")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """The documents with the smallest id of each component, their columns unchanged.

    Texts of one id that do not link are documents of their own, and all stay. Of texts
    of one id that link, the one of the smallest digest stays; of rows that repeat id and
    text, the smallest by all columns; so a run repeated gives the same rows. Rows without
    words all stay. Rows without id go before others of their component. Columns may
    have any name.
    """
    found = stored(_classes(docs, width, percent, key, text, False).where("n > 0")
                   .select("id", "digest", "component"))
    best = found.groupBy("component").agg(F.min(F.struct("id", "digest")).alias("best"))
    told = stored(found.groupBy("component", "id", "digest").agg(F.count(F.lit(1)).alias("rows"))
                  .join(best, "component").select(
                      "id", "digest", "rows",
                      (F.struct("id", "digest") != F.col("best")).alias("goes")))
    # An id goes as a whole unless one of its texts stays: ids are few bytes, and where they are
    # few, no text has to be shuffled to leave them out.
    of_id = told.groupBy("id").agg(F.bool_and("goes").alias("all"), F.bool_or("goes").alias("any"))
    id_name, row_name = (f"_{uuid.uuid4().hex}" for _ in range(2))
    gone = stored(of_id.where("all").select(F.col("id").alias(id_name)))
    kept = docs.withColumn(id_name, _ids(key, text)).join(gone, id_name, "left_anti")
    split = of_id.where("any and not all").select("id")
    row = F.struct("id", "digest").alias(row_name)
    apart = stored(told.join(split, "id").where("goes").select(row))
    again = stored(told.where("not goes and rows > 1").select(row))
    if apart.isEmpty() and again.isEmpty():
        return kept.drop(id_name)
    kept = kept.withColumn(row_name, F.struct(
        F.col(id_name).alias("id"), F.unhex(F.md5(text_or_empty(text))).alias("digest"))).drop(
        id_name).join(apart, row_name, "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = (kept.join(again, row_name, "left_semi").groupBy(row_name)
            .agg(F.min_by(whole, F.to_json(whole, {"ignoreNullFields": "false"})).alias("row"))
            .select("row.*"))
    return kept.join(again, row_name, "left_anti").drop(row_name).unionByName(once)
