"""Source divergence audit: how far the sources of a language differ in their words.

Tasks count the terms of their documents and combine before anything is shuffled.
Per language, each kept term is a row of its nonzero counts, in the order of sources,
and equal rows become one with a multiplicity. The rows go into a frequent-pattern
tree, in which rows with the same first entries share a path. The distance of two
sources is what it would be if no term occurred in either, plus what each source's
own counts change, plus a correction for terms that both have: that is summed once
per node and ancestor, times the rows through the node.

The rows reach the tree in path order, so that only its last branch is open. A node
is closed, and its corrections are added up, when a row leaves it; memory is that of
one branch.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townhall_spark.llm.common import stored, text_or_empty, values
from townhall_spark.operators.skew import top_k_per_group

LEAST_DOCS = 30
TOP_TERMS = 50
# Terms that a task counts before it hands over what it has.
COUNTED = 1 << 19
# Corrections that a task holds before it adds them up, and hands over.
CORRECTIONS = 1 << 20

# Entries of a path by which rows are dealt to tasks.
_RANGED = 4

# A-Z become a-z; other ASCII characters that are no letter separate terms.
_TERMS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
               for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_CORRECTIONS = "lang string, source string, item string, value long"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text: runs of ASCII letters and non-ASCII characters."""
    return (text or "").encode("utf-8", "replace").translate(_TERMS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (language, source) and term its occurrences and documents, in bounded parts."""
    occurs, docs = defaultdict(Counter), defaultdict(Counter)
    names = [c.split()[0] for c in _COUNTS.split(", ")]

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurs.items():
            held, own = list(counts), docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(held)), pa.array([source] * len(held)),
                 pa.array(held, pa.binary()).cast(pa.string()),
                 pa.array(list(counts.values()), pa.int64()),
                 pa.array([own[t] for t in held], pa.int64())], names)
        occurs.clear()
        docs.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*map(values, batch.columns), strict=True):
            found = terms(text)
            if not found:
                continue
            counts = occurs[lang, source]
            size -= len(counts)
            counts.update(found)
            size += len(counts)
            docs[lang, source].update(set(found))
            if size >= COUNTED:
                yield from flush()
                size = 0
    yield from flush()


def _share(count: str, total: str) -> Column:
    """The smoothed share, in billionths; decimals, as products may exceed a long."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({count} + 5 AS DECIMAL(19, 0)))"
                  f" div CAST({total} + 5 * terms AS DECIMAL(20, 0))")


class Tree:
    """The open branch of one language's frequent-pattern tree.

    ``insert`` takes rows in path order. ``close`` leaves nodes: each one's rows are
    added to its parent's, and corrections of its source with those of all ancestors
    to what is pending.
    """

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.branch: list[tuple[str, int]] = []
        self.numbers = np.empty((4, 16), np.int64)  # code, share, share of none, rows
        self.pending, self.size = [], 0

    def insert(self, sources: list[str], shares: list[int], none: list[int], rows: int) -> None:
        path = list(zip(sources, shares, strict=True))
        same = 0
        while same < min(len(path), len(self.branch)) and path[same] == self.branch[same]:
            same += 1
        self.close(same)
        if len(path) > self.numbers.shape[1]:
            self.numbers = np.pad(self.numbers, ((0, 0), (0, 2 * len(path))))
        new = slice(same, len(path))
        self.numbers[0, new] = [self.codes.setdefault(s, len(self.codes)) for s in sources[new]]
        self.numbers[1, new], self.numbers[2, new], self.numbers[3, new] = shares[new], none[new], 0
        self.numbers[3, len(path) - 1] += rows
        self.branch = path

    def close(self, depth: int) -> None:
        """Leave the nodes from ``depth`` on."""
        end = len(self.branch)
        if depth >= end:
            return
        code, share, none, rows = self.numbers[:, :end]
        through = np.cumsum(rows[depth:][::-1])[::-1]
        if depth:
            rows[depth - 1] += through[0]
        step = max(1, CORRECTIONS // end)
        for at in range(max(depth, 1), end, step):
            own = slice(at, min(end, at + step))
            p, z = share[own, None], none[own, None]
            change = np.abs(p - share) - np.abs(p - none) - np.abs(z - share) + np.abs(z - none)
            change *= through[own.start - depth:own.stop - depth, None]
            above = np.arange(end) < np.arange(own.start, own.stop)[:, None]
            pair = (code[own, None] << 32) | code
            self.pending.append((pair[above], change[above]))
            self.size += len(self.pending[-1][0])
        self.branch = self.branch[:depth]

    def corrections(self) -> tuple[list[str], list[str], np.ndarray]:
        """(source, source of an ancestor, sum) of what is pending."""
        if not self.pending:
            return [], [], np.empty(0, np.int64)
        pairs, changes = (np.concatenate(c) for c in zip(*self.pending, strict=True))
        self.pending, self.size = [], 0
        order = np.argsort(pairs, kind="stable")
        found, starts = np.unique(pairs[order], return_index=True)
        names = list(self.codes)
        return ([names[c] for c in found >> 32], [names[c] for c in found & 0xFFFFFFFF],
                np.add.reduceat(changes[order], starts))


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree, of = Tree(), None

    def batch() -> pa.RecordBatch:
        a, b, sums = tree.corrections()
        return pa.RecordBatch.from_arrays(
            [pa.array([of] * len(a), pa.string()), pa.array(a, pa.string()),
             pa.array(b, pa.string()), pa.array(sums, pa.int64())],
            [c.split()[0] for c in _CORRECTIONS.split(", ")])

    for part in batches:
        for lang, sources, shares, none, rows in zip(*map(values, part.columns), strict=True):
            if lang != of:
                tree.close(0)
                yield batch()
                tree, of = Tree(), lang
            tree.insert(sources, shares, none, rows)
            if tree.size >= CORRECTIONS:
                yield batch()
    tree.close(0)
    yield batch()


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of every two sources of a language."""
    entry = F.struct("source", "share", "none")
    paths = stored(kept.groupBy("lang", "term")
                   .agg(F.array_sort(F.collect_list(entry)).alias("path"))
                   .groupBy("lang", "path").agg(F.count(F.lit(1)).alias("rows")))
    # Ranges of the first entries keep paths that share them together; bounds stay short.
    both = stored(paths.repartitionByRange("lang", F.slice("path", 1, _RANGED))
                  .sortWithinPartitions("lang", "path")
                  .select("lang", "path.source", "path.share", "path.none", "rows")
                  .mapInArrow(_grow, _CORRECTIONS))
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    # What two sources differ by if no term occurs in either.
    base = groups.join(other, "lang").where("source <> item").select(
        "lang", "source", "item", (F.col("terms") * F.abs(F.col("none") - F.col("other")))
        .alias("value"))
    # What a source's own counts change, whether the other has the term or not.
    own = (kept.groupBy("lang", "source", "none", "share").agg(F.count(F.lit(1)).alias("rows"))
           .join(other, "lang").where("source <> item")
           .groupBy("lang", "source", "item").agg(F.sum(F.col("rows") * (
               F.abs(F.col("share") - F.col("other")) - F.abs(F.col("none") - F.col("other"))))
               .alias("value")))
    changes = stored(own.unionByName(both))
    turned = changes.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                            "value")
    return (base.unionByName(changes).unionByName(turned).groupBy("lang", "source", "item")
            .agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS,
          lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its language.

    A language keeps the terms that at least ``least_docs`` of its documents hold. Part
    ``pair`` has every other source of the language by falling distance; part ``term``
    the source's ``top`` terms by how much their share exceeds the language's. Equal
    values rank by UTF-8 order of the item. Null language, source or text count as
    empty; a source without terms, or of a language without kept terms, still has its
    pairs. Repeated rows count as documents of their own; an empty table gives an empty
    table; other columns are not read. A term's row has an entry per source at most, as
    has the result.
    """
    rows = docs.select(*[text_or_empty(c).alias(n) for c, n in
                         ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = stored(counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("of_lang"),
        F.collect_list(F.struct("source", "n")).alias("entries"))
        .where(F.col("docs") >= least_docs).select(
            "lang", "term", "of_lang", F.explode("entries").alias("entry"))
        .select("lang", "term", "of_lang", "entry.source", "entry.n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    languages = kept.select("lang", "term", "of_lang").distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("of_lang").alias("lang_total"))
    groups = stored(rows.select("lang", "source").distinct()
                    .join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
                    .withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
                    .withColumn("none", _share("0", "total")))
    shared = stored(kept.join(groups, ["lang", "source"]).withColumn(
        "share", _share("n", "total")).withColumn("of_all", _share("of_lang", "lang_total")))
    pairs = _pairs(shared, groups).withColumn("part", F.lit("pair"))
    more = shared.select("lang", "source", F.col("term").alias("item"),
                         (F.col("share") - F.col("of_all")).alias("value")).where("value > 0")
    falling = [F.desc("value"), F.col("item")]
    best = top_k_per_group(more, ["lang", "source"], falling, top, F.col("item")).withColumn(
        "part", F.lit("term"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*falling))
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value",
                                          rank.alias("rank"))
