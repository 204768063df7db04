"""Helpers of this subpackage: tables, texts and word shingles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townhall_spark.sources.sinks import stored

__all__ = ["WordHashes", "bounded_batches", "combined", "shingle_set", "stored", "table", "text_or_empty", "values"]

_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS_KEPT = 1 << 18
# Rows of whole texts that Python is handed at once.
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lets Spark hand Python at most ``rows`` rows at once, in this session, if it were more.

    A task and its Python worker each hold a batch as it comes and as it goes back; with
    whole texts in the rows that is what most of their memory is for.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, str(rows))


def text_or_empty(name: str = "text") -> Column:
    """The column with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def values(column: pa.Array) -> Iterator:
    """The values of an Arrow column, one at a time."""
    return (v.as_py() for v in column)


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` neighbouring word hashes, in order."""
    count = len(hashes) - width + 1
    if count < 1:
        return hashes[:0]
    mixed = hashes[:count].copy()
    for k in range(1, width):
        mixed *= _MIX
        mixed ^= hashes[k:count + k]
    mixed *= _MIX
    return mixed ^ (mixed >> np.uint64(29))


def shingle_set(text: str | None, width: int, seen: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text.

    A-Z are lower-cased; words are separated by the bytes 9 to 13 and 32. A text
    of fewer words is one shingle; a text without words has none.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00" + b" ".join(words))], np.uint64)
    return np.unique(combined(seen.of(words), width))
