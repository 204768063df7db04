"""Text primitives with Unicode whitespace, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Unicode-aware string stripping removes; Spark's plain trim
# only knows U+0020.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a Java regex class (plain \s is ASCII only in Java).
SPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"

# Where a sentence ends, and the shortest sentence that counts.
SENTENCE_BREAK = rf"(?<=[.!?]){SPACE_CLASS}+|\n+"
MIN_SENTENCE_CHARS = 25


def ustrip(col: Column) -> Column:
    """Strip Unicode whitespace from both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Predicate pushdown and project collapsing inline a column's expression at
    every use; binding it to a lambda variable keeps one evaluation per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sentences(text: Column, min_chars: int = MIN_SENTENCE_CHARS) -> Column:
    """Array of stripped sentences of at least ``min_chars`` characters, in text order.

    Stripping and the length test stay inside the array so that nothing is
    evaluated twice when the array is exploded.
    """
    stripped = F.transform(F.split(text, SENTENCE_BREAK, -1), ustrip)
    return F.filter(stripped, lambda s: F.length(s) >= min_chars)


def zfill(col: Column, width: int) -> Column:
    """Left-pad with zeros; unlike ``lpad`` a longer value is kept whole."""
    return F.when(F.length(col) < width, F.lpad(col, width, "0")).otherwise(col)


def or_none(col: Column) -> Column:
    """The value, or ``none`` when it is null or empty."""
    return F.when(has_text(col), col).otherwise("none")


def has_text(col: Column) -> Column:
    """True when the text is neither null nor empty."""
    return F.coalesce(F.length(col) > 0, F.lit(False))
