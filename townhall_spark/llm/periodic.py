"""Periodic run detection: stretches of words that repeat three times or more.

The words of a text go into a suffix automaton, whose suffix links are a tree. Words
are then appended one by one: a link-cut access walks from the new prefix to the root
and recolours the path with the prefix's end. The segments that it takes over have the
colours of earlier ends: a segment of colour ``j`` whose deepest state has length ``n``
says that the last ``n`` words ended at ``j`` before. If the distance of the two ends is
within ``n``, the words between are a square, and the distance is its smallest period
(a smaller one would have been a later end). It starts where no word before it
continues the period, and is extended to the right to a maximal run.

A word of a run with three periods occurs three times in it, so words that occur less
often in a stretch lie in no run and cut it. Only what is left goes into an automaton.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall_spark.llm.common import values

LEAST_WORDS = 24
LEAST_PERIODS = 3
# How often a stretch is cut again by counts of its own; only speed depends on it.
CUTS = 6

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_FORM = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()),
                            ("period", pa.int64())]))


def automaton(words: Sequence) -> tuple[list[int], list[int], list[int]]:
    """(length, suffix link) of all states, and the state of every prefix."""
    length, link, after = [0], [-1], [{}]
    prefixes, last = [], 0
    for word in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        after.append({})
        prefixes.append(new)
        state, last = last, new
        while state != -1 and word not in after[state]:
            after[state][word] = new
            state = link[state]
        if state == -1:
            continue
        known = after[state][word]
        if length[known] != length[state] + 1:
            clone = len(length)
            length.append(length[state] + 1)
            link.append(link[known])
            after.append(after[known].copy())
            while state != -1 and after[state].get(word) == known:
                after[state][word] = clone
                state = link[state]
            link[known] = known = clone
        link[new] = known
    return length, link, prefixes


class LastOccurrences:
    """A link-cut tree over suffix links; a preferred path has one colour, its last end.

    Each path is a splay tree by depth, whose root holds the colour. ``up`` is the
    parent in the splay tree or, at its root, the state above the path.
    """

    def __init__(self, link: list[int]):
        self.up = link[:]
        self.left, self.right = [-1] * len(link), [-1] * len(link)
        self.colour = [-1] * len(link)

    def _rotate(self, x: int, p: int) -> None:
        """Lift ``x`` over its parent ``p``."""
        up, left, right = self.up, self.left, self.right
        above = up[p]
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child != -1:
            up[child] = p
        if above != -1:
            if left[above] == p:
                left[above] = x
            elif right[above] == p:
                right[above] = x
        up[p], up[x] = x, above

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        root = -1
        while (p := up[x]) != -1 and (left[p] == x or right[p] == x):
            root, g = p, up[p]
            if g != -1 and (left[g] == p or right[g] == p):
                root = g
                if (left[g] == p) == (left[p] == x):
                    self._rotate(p, g)
                else:
                    self._rotate(x, p)
                    p = g
            self._rotate(x, p)
        if root != -1:
            self.colour[x] = self.colour[root]

    def access(self, state: int, end: int) -> Iterator[tuple[int, int]]:
        """Colour the path from the root to ``state``; (old colour, deepest state) of each
        segment that was coloured."""
        up, right, colour = self.up, self.right, self.colour
        x, below = state, -1
        while x != -1:
            self._splay(x)
            old, cut = colour[x], right[x]
            if cut != -1:
                colour[cut] = old
            right[x] = below
            if old != -1:
                yield old, x
            below, x = x, up[x]
        colour[below] = end


def _stretches(words: list, least: int, periods: int) -> Iterator[tuple[int, int]]:
    """The stretches, from start to end, that may hold runs."""
    waiting = [(0, len(words), 0)]
    while waiting:
        start, end, cuts = waiting.pop()
        if end - start < least:
            continue
        part = words[start:end] if end - start < len(words) else words
        counts = Counter(part)
        rare = [i for i, w in enumerate(part) if counts[w] < periods] if cuts < CUTS else []
        if not rare:
            yield start, end
        before = -1
        for i in [*rare, len(part)] if rare else ():
            if i - before > least:
                waiting.append((start + before + 1, start + i, cuts + 1))
            before = i


def _runs_of(words: list, least: int, periods: int) -> Iterator[tuple[int, int, int]]:
    length, link, prefixes = automaton(words)
    paths, until = LastOccurrences(link), {}
    for end, state in enumerate(prefixes):
        for before, deepest in paths.access(state, end):
            period, same = end - before, length[deepest]
            if same < (periods - 1) * period or until.get(period, -1) > end:
                continue
            stop = end + 1
            while stop < len(words) and words[stop] == words[stop - period]:
                stop += 1
            until[period] = stop
            start = before - same + 1
            if stop - start >= max(least, periods * period):
                yield start, stop - start, period


def runs(words: list, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
         ) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run, by start and period.

    A run has at least ``least`` words and ``periods`` (2 or more) periods.
    """
    return sorted((start + at, n, period) for start, end in _stretches(words, least, periods)
                  for at, n, period in _runs_of(words[start:end], least, periods))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats: of each run its first period stays."""
    kept, at = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in found):
        if start > at:
            kept += words[at:start]
        at = max(at, end)
    return kept + words[at:] if found else words


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS,
             periods: int = LEAST_PERIODS) -> DataFrame:
    """(row, runs, collapsed): every row, the runs of its whole text, and the text without
    their repetitions, its words joined by single spaces.

    Words are separated by the characters 9 to 13 and 32; a run's start counts words
    from 0. Null, empty and wordless texts have no runs and collapse to the empty text.
    Overlapping runs each count, and a word goes if any run repeats it. Repeated rows get
    the same answer; an empty table gives an empty table; columns named like the result's
    stay in ``row``. A task holds one text's automaton at a time. Nothing is shuffled.
    """
    kind, at = docs.schema.simpleString(), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, short = [], []
            for value in values(batch.column(0).field(at)):
                words = (value or "").encode("utf-8", "replace").split()
                own = runs(words, least, periods)
                found.append([dict(zip(("start", "length", "period"), r, strict=True))
                              for r in own])
                short.append(b" ".join(collapsed(words, own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, _FORM),
                 pa.array(short, pa.binary()).cast(pa.string())], ["row", "runs", "collapsed"])
    return docs.select(F.struct("*").alias("row")).mapInArrow(
        run, f"row {kind}, runs {RUNS}, collapsed string")
