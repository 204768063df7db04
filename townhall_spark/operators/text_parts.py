"""Texts of groups in order as tables of parts, and windows over them.

A part knows where it starts in the joined text of its group, so whatever needs a
stretch of that text works on the parts that the stretch covers. The joined text is
made only where someone asks for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.functions.text import has_text
from townhall_spark.operators.ordering import numbered
from townhall_spark.operators.text_assembly import MAX_STRING_BYTES, SEPARATOR, in_order
from townhall_spark.sources.sinks import stored

# Characters of a block that a part is cut into before windows are laid over it.
BLOCK_CHARS = 4096
# Parts that are joined to one text before the text of their group is.
JOINED_PARTS = 1000


def parts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "transcript",
          repeated: bool = False) -> DataFrame:
    """(keys, part, offset, total, text): every non-empty text of a group, in order.

    ``offset`` counts the characters before the part in the text that all parts of the
    group make when joined by ``SEPARATOR``; ``total`` are that text's characters.
    ``order`` must tell the rows of a group apart, as an arrival number does; with
    ``repeated`` rows of equal order may occur, and count as one. Texts are written once
    to the scratch folder; only their lengths are sorted and summed.
    """
    keys, order = list(keys), list(order)
    own = rows.select(*keys, *order, F.col(text).alias("text")).where(has_text(F.col("text")))
    own = stored(own.dropDuplicates([*keys, *order]) if repeated else own)
    names = [f"_k{i}" for i in range(len(keys) + len(order))]
    light = own.select(*[F.col(c).alias(n) for c, n in zip([*keys, *order], names, strict=True)],
                       (F.length("text") + len(SEPARATOR)).cast("long").alias("_chars"))
    places = numbered(light, names[:len(keys)], names[len(keys):], "_chars")
    same = F.lit(True)
    for column, name in zip([*keys, *order], names, strict=True):
        same &= F.col(column).eqNullSafe(F.col(name))
    return own.join(places, same).select(
        *keys, F.col("_number").alias("part"), F.col("_before").alias("offset"),
        (F.col("_total") - len(SEPARATOR)).alias("total"), "text")


def joined(of: DataFrame, keys: Sequence[str], at_once: int = JOINED_PARTS) -> DataFrame:
    """(keys, text): the parts of each group as one text.

    Runs of ``at_once`` parts are joined first, wherever they are, so that the last step
    of a group of very many parts puts few long texts together. A text with more characters
    than a string has bytes is an error before any of it is gathered, one with more bytes
    when it is; neither is cut.
    """
    fits = F.when(F.col("total") > MAX_STRING_BYTES, F.raise_error(F.lit(
        "the text of one group is longer than a string can hold"))).otherwise(F.col("text"))
    runs = of.select(*keys, F.expr(f"part div {at_once}").alias("_run"), "part", fits.alias("text"))
    return (runs.groupBy(*keys, "_run").agg(in_order(["part"], "text").alias("text"))
            .groupBy(*keys).agg(in_order(["_run"], "text").alias("text")))


def _blocks(text: Column) -> Column:
    """A text in blocks, cut in one pass however long it is."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))


def windows(of: DataFrame, keys: Sequence[str], max_chars: int, overlap: int) -> DataFrame:
    """(keys, window_seq, excerpt): windows that cover each group's joined text.

    A window holds ``max_chars`` characters and starts ``overlap`` before the end of the
    one before. Blocks of parts are dealt to the windows that they reach into, each
    with just the piece that a window holds, so a window gathers ``max_chars``
    characters and no more.
    """
    keys, step = list(keys), max_chars - overlap
    end = F.col("offset") + F.length("text")
    spaced = F.when(end < F.col("total"), F.concat("text", F.lit(SEPARATOR))).otherwise(
        F.col("text"))
    blocks = of.select(*keys, "offset", "total", F.posexplode(_blocks(spaced)).alias("_at", "_piece")
                       ).withColumn("_start", F.col("offset") + F.col("_at") * BLOCK_CHARS)
    # Windows reach from w * step to w * step + max_chars; the last one holds the end.
    last = f"CAST(ceil(greatest(total - {max_chars}, 0) / {step}) AS BIGINT)"
    first = f"greatest(0, (_start - {max_chars}) div {step} + IF(_start < {max_chars}, 0, 1))"
    until = f"least({last}, (_start + length(_piece) - 1) div {step})"
    dealt = blocks.withColumn("window_seq", F.explode(F.expr(f"sequence({first}, {until})")))
    begin = F.greatest(F.col("window_seq") * step - F.col("_start"), F.lit(0))
    stop = F.least(F.col("window_seq") * step + max_chars - F.col("_start"), F.length("_piece"))
    piece = F.struct("_start", F.col("_piece").substr(
        (begin + 1).cast("int"), (stop - begin).cast("int")).alias("_text"))
    return (dealt.select(*keys, F.col("window_seq").cast("int").alias("window_seq"),
                         piece.alias("_p"))
            .groupBy(*keys, "window_seq")
            .agg(F.array_sort(F.collect_list("_p")).alias("_p"))
            .select(*keys, "window_seq",
                    F.array_join(F.transform("_p", lambda p: p["_text"]), "").alias("excerpt")))


def whole(rows: DataFrame, keys: Sequence[str], text: str = "transcript") -> DataFrame:
    """Texts that are already joined, as parts: one for each row."""
    return rows.where(has_text(F.col(text))).select(
        *keys, F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("offset"),
        F.length(text).cast("long").alias("total"), F.col(text).alias("text"))
