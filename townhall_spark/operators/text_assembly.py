"""Joining the texts of a group, in order, into one document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.functions.text import has_text, let, ustrip

SEPARATOR = "\n\n"

# Bytes that a Spark string can hold; a longer document is an error, never cut.
MAX_STRING_BYTES = 2**31 - 2**20


def in_order(order: Sequence[str], text: str) -> Column:
    """Aggregate: the group's non-empty texts in order as one string, null without any."""
    entry = F.struct(*[F.col(c) for c in order], F.col(text).alias("_text"))
    entries = F.array_sort(F.collect_list(F.when(has_text(F.col(text)), entry)))
    joined = let(F.transform(entries, lambda e: e["_text"]),
                 lambda p: F.when(F.size(p) > 0, F.array_join(p, SEPARATOR)))
    total = F.sum(F.octet_length(text) + len(SEPARATOR))
    return F.when(total > MAX_STRING_BYTES, F.raise_error(F.lit(
        "the text of one meeting is longer than a string can hold"))).otherwise(joined)


def distinct_texts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str
                   ) -> DataFrame:
    """(keys, order, text): every different stripped text of a group, at its first place.

    Copies meet before the shuffle, so a text that very many records of one group
    share costs one row per task.
    """
    return (rows.select(*keys, *order, ustrip(F.col(text)).alias(text))
            .where(has_text(F.col(text)))
            .groupBy(*keys, text).agg(F.min(F.struct(*order)).alias("_first"))
            .select(*keys, "_first.*", text))
