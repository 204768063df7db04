"""Benchmark decontamination: passages of documents that are benchmark items.

Items and windows get a 64-bit SimHash of their weighted words. Windows are as long as
items: item lengths within a few per cent share one window length, and windows start
at every eighth of it. All fingerprints of a length are looked up in tables of the
items of that length, one for each quarter of the bits: two fingerprints within the
radius of 15 differ in at most 3 bits of some quarter, and a table lists an item under
every value that near to its quarter, so no fingerprint within the radius is missed.
Around such hits, the exact share of the item's weighted shingles that a window of the
item's own length holds decides.

The fingerprints are the only way to a candidate. A window that reaches the similarity
may have one beyond the radius, so recall is not certain: the tests hold it to 0.99 on
items edited down to the threshold.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from itertools import combinations, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall_spark.llm.common import WordHashes, combined, stored, values
from townhall_spark.llm.words import HashSet, words

WIDTH = 5
LEAST = 0.8
RADIUS = 15
BLOCKS = 4
# Lengths of items that share a window length differ by this factor at most.
LENGTHS = 1.15
# Windows start at every so-manieth part of their length.
STARTS = 8
# Steps of word weights in fingerprints.
STEPS = 4
# Text bytes of items that go to every task at once; more items take more scans. The tables
# hold about 11 KB an item.
ITEM_BYTES = 4 << 20
# Words of documents that are fingerprinted together.
STREAM = 1 << 13

_BITS = 64 // BLOCKS
_MASK = np.uint64((1 << _BITS) - 1)
MATCHES = "array<struct<item_id:bigint,similarity:double,start_word:bigint,n_words:bigint>>"
_FORM = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()),
                            ("start_word", pa.int64()), ("n_words", pa.int64())]))


def _shingles(hashes: np.ndarray) -> np.ndarray:
    return combined(hashes, min(WIDTH, len(hashes)))


class Held(NamedTuple):
    """In how many of ``items`` items each word and each shingle is."""

    items: int
    words: Mapping[int, int]
    shingles: Mapping[int, int]

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]]) -> Held:
        seen, found, shingles, n = WordHashes(), Counter(), Counter(), 0
        for _, text in rows:
            if len(hashes := seen.of(words(text))):
                n += 1
                found.update(set(hashes.tolist()))
                shingles.update(set(_shingles(hashes).tolist()))
        return cls(n, found, shingles)

    def weight(self, times: int) -> float:
        """Weight of what ``times`` items hold; nothing weighs more than what none holds."""
        return math.log(1 + self.items / (1 + times))


class Item(NamedTuple):
    item_id: int
    length: int
    width: int
    shingles: Counter
    distinct: np.ndarray
    total: float


class Table:
    """Fingerprints of one window length, under every value near to each of their blocks."""

    def __init__(self, members: list[int], prints: np.ndarray, length: int):
        self.members, self.prints, self.length = np.array(members), prints, length
        flips = np.array([sum(1 << b for b in at) for n in range(RADIUS // BLOCKS + 1)
                          for at in combinations(range(_BITS), n)])
        self.blocks = []
        for block in range(BLOCKS):
            value = (prints >> np.uint64(_BITS * block)) & _MASK
            near = (value.astype(np.int64)[:, None] ^ flips[None]).ravel()
            order = np.argsort(near, kind="stable")
            counts = np.bincount(near, minlength=1 << _BITS)
            self.blocks.append((counts > 0,
                                np.concatenate([[0], np.cumsum(counts)]).astype(np.int32),
                                np.repeat(np.arange(len(prints), dtype=np.int32), len(flips))[order]))

    def look_up(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of the fingerprint, member) of all pairs within the radius, by block."""
        values = np.ascontiguousarray(prints.astype("<u8").view("<u2").reshape(-1, BLOCKS).T)
        for value, (some, bounds, listed) in zip(values, self.blocks, strict=True):
            # No value is out of bounds: clipping only saves the test.
            place = np.flatnonzero(some.take(value, mode="clip"))
            if not len(place):
                continue
            value = value.take(place).astype(np.intp)
            first = bounds.take(value, mode="clip")
            counts = bounds.take(value + 1, mode="clip") - first
            at = np.repeat(first - np.cumsum(counts) + counts, counts)
            at += np.arange(len(at), dtype=np.int32)
            member, place = listed.take(at, mode="clip"), np.repeat(place, counts)
            near = np.flatnonzero(np.bitwise_count(
                prints.take(place) ^ self.prints.take(member, mode="clip")) <= RADIUS)
            if len(near):
                yield place[near], member[near]


def _add_up(rows: np.ndarray) -> None:
    """Running sums of rows, in place; several times as fast as numpy's along that axis."""
    whole = len(rows) // 16 * 16
    blocks = rows[:whole].reshape(-1, 16, rows.shape[1])
    for k in range(1, 16):
        blocks[:, k] += blocks[:, k - 1]
    blocks[:, 15] = np.cumsum(blocks[:, 15], axis=0, dtype=rows.dtype)
    blocks[1:, :15] += blocks[:-1, 15:]
    for k in range(max(whole, 1), len(rows)):
        rows[k] += rows[k - 1]


class Index:
    """Benchmark items, their shingles, and their fingerprints in tables."""

    def __init__(self, rows: list[tuple[int, str | None]], held: Held | None = None):
        held = held or Held.of(rows)
        seen = WordHashes()
        kept = [(i, h) for i, t in rows if len(h := seen.of(words(t)))]
        self.weight = {s: held.weight(n) for s, n in held.shingles.items()}
        self.items = []
        for item_id, hashes in kept:
            own = Counter(_shingles(hashes).tolist())
            self.items.append(Item(item_id, len(hashes), min(WIDTH, len(hashes)), own,
                                   np.fromiter(own, np.uint64, len(own)),
                                   sum(self.weight[s] * c for s, c in own.items())))
        wide = [i.distinct for i in self.items if i.width == WIDTH]
        self.wide = HashSet(np.concatenate(wide) if wide else np.empty(0, np.uint64))
        self.longest = max((i.length for i in self.items), default=0)
        self.words = HashSet(np.fromiter(held.words, np.uint64, len(held.words)))
        scale = STEPS / held.weight(0) if held.items else 0.0
        self.steps = np.array([max(1, round(scale * held.weight(held.words[w])))
                               for w in self.words.sorted.tolist()], np.uint16)
        alike = defaultdict(list)
        for n, item in enumerate(self.items):
            alike[int(math.log(item.length) / math.log(LENGTHS))].append(n)
        self.tables = []
        for members in alike.values():
            lengths = [self.items[n].length for n in members]
            prints = [self.prints(kept[n][1], self.items[n].length, 1)[0] for n in members]
            self.tables.append(Table(members, np.array(prints, np.uint64),
                                     (min(lengths) + max(lengths) + 1) // 2))

    def _votes(self, hashes: np.ndarray, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the words' weighted bits and of their weights."""
        weight = np.full(len(hashes), STEPS, np.uint16)
        known = self.words.where(hashes)
        weight[known] = self.steps[np.searchsorted(self.words.sorted, hashes[known])]
        weight[empty] = 0
        # Sums of a window fit, so sums from the start may overflow: differences are right.
        kind = np.min_scalar_type(STEPS * self.longest)
        votes = np.zeros((len(hashes) + 1, 64), kind)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes[1:] = bits * weight.astype(kind)[:, None]
        _add_up(votes)
        return votes, np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])

    @staticmethod
    def _windows(votes: np.ndarray, weights: np.ndarray, length: int, step: int) -> np.ndarray:
        sums = votes[length::step] - votes[:-length:step]
        half = (weights[length::step] - weights[:-length:step]) // 2
        return np.packbits((sums > half.astype(votes.dtype)[:, None]).ravel()).view("<u8")

    def prints(self, hashes: np.ndarray, length: int, step: int) -> np.ndarray:
        """The SimHash of every ``step``-th window of ``length`` words."""
        return self._windows(*self._votes(hashes, np.empty(0, int)), length, step)

    def look_up(self, hashes: np.ndarray, empty: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, item, step): windows of a stream of words that are near to an item."""
        votes, weights = self._votes(hashes, empty)
        # A region without a shingle of any item has no similarity to verify.
        shared = np.zeros(len(hashes) + 1, np.int64)
        shared[self.wide.where(combined(hashes, WIDTH)) + 1] = 1
        shared = np.cumsum(shared)
        for table in self.tables:
            if table.length > len(hashes):
                continue
            step = max(1, table.length // STARTS)
            prints = self._windows(votes, weights, table.length, step)
            for place, member in table.look_up(prints):
                start = place * step
                reach = step + table.length // 4 + 1
                low = np.maximum(0, start - reach)
                high = np.minimum(len(hashes), start + table.length + reach)
                full = weights[start + table.length] > weights[start]
                if table.length >= WIDTH:
                    full &= shared[high] > shared[low]
                for p, m in zip(start[full].tolist(), table.members[member[full]].tolist(),
                                strict=True):
                    yield p, m, step

    def _similarity(self, item: Item, shingles: list[int]) -> float:
        shared = Counter(shingles) & item.shingles
        return sum(self.weight[s] * c for s, c in shared.items()) / item.total

    def _best(self, item: Item, hashes: np.ndarray, low: int, high: int, least: float
              ) -> dict | None:
        """The best window of an item that starts from ``low`` to ``high``."""
        last = max(0, len(hashes) - item.length)
        low, high, span = max(0, min(low, last)), min(high, last), item.length - item.width
        shingles = combined(hashes[low:high + item.length], item.width)
        found = np.flatnonzero(np.isin(shingles, item.distinct))
        if not len(found):
            return None
        starts = np.arange(high - low + 1)
        # At most the weight of the item's shingles in a window is shared with it.
        weight = np.array([self.weight[s] for s in shingles[found].tolist()])
        sums = np.concatenate([[0.0], np.cumsum(weight)])
        bound = (sums[np.searchsorted(found, starts + span, "right")]
                 - sums[np.searchsorted(found, starts, "left")])
        best = None
        for start in starts[bound >= least * item.total - 1e-9].tolist():
            share = self._similarity(item, shingles[start:start + span + 1].tolist())
            if share >= least - 1e-12 and (best is None or share > best["similarity"]):
                best = {"item_id": item.item_id, "similarity": share, "start_word": low + start,
                        "n_words": min(item.length, len(hashes))}
        return best

    def _verified(self, hashes: np.ndarray, hits: dict[int, list[tuple[int, int]]], least: float
                  ) -> list[dict]:
        """The items that a document holds near its hits, each with its best window."""
        out = []
        for n, near in hits.items():
            item, best, past = self.items[n], None, -1
            for start, step in sorted(set(near)):
                reach = step + item.length // 4 + 1
                low, past = max(past + 1, start - reach), max(past, start + reach)
                found = self._best(item, hashes, low, past, least) if low <= past else None
                if found and (best is None or found["similarity"] > best["similarity"]):
                    best = found
            if best:
                out.append(best)
        return sorted(out, key=lambda m: m["item_id"])

    def matches(self, documents: list[np.ndarray], least: float) -> list[list[dict]]:
        """Per document, given as its words' hashes, the items it holds.

        Documents are fingerprinted in streams, with room between them: the weightless
        words behind a document let a window reach past its end, and a shorter document
        be less than a window. Long documents are cut into streams that overlap by a
        window.
        """
        hits: list[dict] = [defaultdict(list) for _ in documents]
        stream: list[np.ndarray] = []
        empty: list[np.ndarray] = []
        owners: list[tuple[int, int, int, int]] = []
        size = 0

        def flush() -> None:
            nonlocal stream, empty, owners, size
            if stream:
                ends = np.array([o[1] for o in owners])
                for start, item, step in self.look_up(np.concatenate(stream),
                                                      np.concatenate(empty)):
                    # A window counts for the document in which it starts.
                    begin, end, doc, at = owners[int(np.searchsorted(ends, start, "right"))]
                    if begin <= start < end:
                        hits[doc][item].append((at + start - begin, step))
            stream, empty, owners, size = [], [], [], 0

        for doc, hashes in enumerate(documents):
            if not self.items:
                break
            room = max(len(hashes) // 4 * (len(hashes) < self.longest),
                       self.longest // STARTS) + 1
            for at in range(0, len(hashes), STREAM):
                part = hashes[at:at + STREAM + self.longest]
                stream += [part, np.zeros(room, np.uint64)]
                empty.append(np.arange(size + len(part), size + len(part) + room))
                owners.append((size, size + len(part), doc, at))
                size += len(part) + room
                if size >= STREAM:
                    flush()
        flush()
        return [self._verified(h, found, least)
                for h, found in zip(documents, hits, strict=True)]


def _hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, shingle, hash): the distinct words and shingles of items."""
    seen = WordHashes()
    for batch in batches:
        for part, text in zip(*map(values, batch.columns), strict=True):
            hashes = seen.of(words(text))
            for shingle, own in ((False, hashes), (True, _shingles(hashes))):
                found = np.unique(own).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(found), pa.int64()),
                     pa.array([shingle] * len(found), pa.bool_()), pa.array(found)],
                    ["part", "shingle", "hash"])


def _indexes(items: DataFrame, key: str, text: str) -> Iterator[Index]:
    """The items in indexes of bounded size; one at the usual benchmark sizes.

    Weights are those of all items together, whatever the number of indexes: they are
    counted over the whole table, and an index is sent those of its own items.
    """
    rows = items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(
        "k is not null and t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = size // ITEM_BYTES + 1
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(parts)))
    held = stored(dealt.select("part", "t").mapInArrow(
        _hold, "part long, shingle boolean, hash long"))
    times = held.groupBy("shingle", "hash").agg(F.count(F.lit(1)).alias("items"))
    of_parts = stored(held.distinct().join(times, ["shingle", "hash"]))
    total = rows.select(F.lit(0).cast("long"), "t").mapInArrow(
        _hold_any, "items long").agg(F.sum("items")).first()[0] or 0
    for part in range(parts):
        own = of_parts.where(F.col("part") == part).toPandas()
        hashes = own["hash"].to_numpy(np.int64).view(np.uint64)
        is_shingle, counts = own["shingle"].to_numpy(bool), own["items"].to_numpy(np.int64)
        known = [dict(zip(hashes[which].tolist(), counts[which].tolist(), strict=True))
                 for which in (~is_shingle, is_shingle)]
        yield Index(sorted((r["k"], r["t"]) for r in dealt.where(F.col("part") == part).collect()),
                    Held(total, *known))


def _hold_any(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of items with words."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array([sum(bool(words(t)) for t in values(batch.column(1)))], pa.int64())], ["items"])


def _flag(found: DataFrame, index: Index, at: int, least: float) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for batch in batches:
            # A stream's worth of documents at a time, not the batch's.
            both, held, size = [], [], 0
            texts, old = values(batch.column(0).field(at)), values(batch.column(1))

            def flush() -> None:
                nonlocal held, size
                for before, new in zip(islice(old, len(held)), shared.value.matches(held, least),
                                       strict=True):
                    both.append(sorted(before + new, key=lambda m: m["item_id"]))
                held, size = [], 0

            for text in texts:
                held.append(seen.of(words(text)))
                size += len(held[-1])
                if size >= STREAM or len(held) >= STREAM:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both, _FORM)],
                                             names=["row", "matches"])
    return found.mapInArrow(run, found.schema)


def flagged(docs: DataFrame, items: DataFrame, least: float = LEAST, text: str = "text",
            item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, matches): every row of ``docs`` and the items that its whole text holds.

    A match is a window of the item's length that holds at least ``least`` of the
    weight of the item's five-word shingles (all words of a shorter item), near a window
    whose fingerprint is within the radius of the item's; of several the best and then the
    first. Items that are null, without words or without id, and documents that are
    null or empty, match nothing; equal items each match. Repeated rows get the same
    answer; empty tables give no matches; columns named like the result's stay in
    ``row``. Documents are not shuffled; indexes of bounded size go to all tasks, one
    scan each.
    """
    found = docs.select(F.struct("*").alias("row"), F.expr(f"cast(array() AS {MATCHES})")
                        .alias("matches"))
    for index in _indexes(items, item_key, item_text):
        if index.items:
            found = _flag(found, index, docs.columns.index(text), least)
    return found


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that hold no item, with their own columns, whatever these are called.

    Rows without text stay, repeated rows each stay or go, and with an empty table of
    items all documents stay.
    """
    return flagged(docs, items, least).where(F.size("matches") == 0).select("row.*")
