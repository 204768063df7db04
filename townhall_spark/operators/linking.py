"""Linking records of the same meeting: primary, provenance, conflicts.

Primary selection is an aggregate (the smallest ordering struct per meeting), so
copies of one meeting collapse before the shuffle; no window ever gathers a
whole meeting in one task. Links and conflicts join each record to its
meeting's primary and carry no transcript.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.functions.text import has_text, ustrip
from townhall_spark.operators.text_assembly import distinct_texts, in_order
from townhall_spark.operators.text_parts import parts
from townhall_spark.schemas import quality_rank

KEY = "canonical_id"
DESCRIPTIVE = ("jurisdiction_name", "jurisdiction_fips", "state", "meeting_date",
               "meeting_type", "transcript_quality", "source", "source_url",
               "source_record_id")
# Fields on which linked records may disagree.
CONFLICT_FIELDS = ("jurisdiction_name", "state")
ORDER = ("rank_quality", "rank_chars", "ingest_seq")


class Resolved(NamedTuple):
    """``meetings`` one row each, without text; ``links`` one row per record;
    ``conflicts`` one per disagreeing record and field."""

    meetings: DataFrame
    links: DataFrame
    conflicts: DataFrame


def _chars(records: DataFrame) -> Column:
    """Length of the transcript as it came, 0 when there is none or it is blank."""
    if "transcript_chars" in records.columns:
        return F.coalesce("transcript_chars", F.lit(0)).cast("long")
    text = F.col("transcript")
    return F.when(ustrip(text) != "", F.length(text)).otherwise(0).cast("long")


def _ranked(records: DataFrame) -> DataFrame:
    """Adds the ascending order that puts the best record of a meeting first."""
    return (records.withColumn("rank_quality", -quality_rank(F.col("transcript_quality")))
            .withColumn("rank_chars", -_chars(records)))


def primary_records(records: DataFrame) -> DataFrame:
    """Per meeting: ``best`` (the primary's descriptive columns), whether any record has
    a transcript, and ``first_seq``, where the meeting first appears."""
    return _ranked(records).groupBy(KEY).agg(
        F.min(F.struct(*ORDER, *DESCRIPTIVE)).alias("best"),
        (F.min("rank_chars") < 0).alias("has_transcript"),
        F.min("ingest_seq").alias("first_seq"))


def meetings(records: DataFrame) -> DataFrame:
    """One row per meeting: the primary record's description; no text is read."""
    return primary_records(records).select(
        KEY, *[F.col(f"best.{c}").alias(c) for c in DESCRIPTIVE], "has_transcript",
        F.col("best.ingest_seq").alias("ingest_seq"), "first_seq")


def transcript_parts(records: DataFrame) -> DataFrame:
    """(canonical_id, part, offset, total, text): the distinct texts of each meeting in rank
    order, with their places in the merged transcript; no task holds a meeting."""
    return parts(distinct_texts(_ranked(records), [KEY], ORDER, "transcript"), [KEY], ORDER)


def merged_transcripts(records: DataFrame) -> DataFrame:
    """(canonical_id, transcript) of meetings with text: distinct texts in rank order."""
    texts = distinct_texts(_ranked(records), [KEY], ORDER, "transcript")
    return texts.groupBy(KEY).agg(in_order(ORDER, "transcript").alias("transcript"))


def primaries(records: DataFrame) -> DataFrame:
    """One row per meeting: the primary record with the merged transcript."""
    return (meetings(records).drop("has_transcript", "first_seq")
            .join(merged_transcripts(records), KEY, "left"))


def members(records: DataFrame) -> DataFrame:
    """Every record, without transcript, next to its meeting's primary (``best``).

    One meeting may own very many records; adaptive execution splits such a key.
    """
    light = records.select(KEY, *DESCRIPTIVE, "ingest_seq")
    return light.join(primary_records(records).select(KEY, "best"), KEY)


def provenance(records: DataFrame) -> DataFrame:
    """One link per input record; exactly one primary per meeting."""
    return members(records).select(
        KEY, "source", "source_record_id", "source_url", "transcript_quality",
        (F.col("ingest_seq") == F.col("best.ingest_seq")).alias("is_primary"))


def conflicts(records: DataFrame) -> DataFrame:
    """One row per record and descriptive field that differs from the primary's."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"best.{f}").alias("value_a"),
                 F.col(f).alias("value_b"))
        for f in CONFLICT_FIELDS])
    return (members(records)
            .select(KEY, F.col("best.source").alias("source_a"),
                    F.col("source").alias("source_b"), F.explode(pairs).alias("c"))
            .where(~F.col("c.value_a").eqNullSafe(F.col("c.value_b")))
            .select(KEY, "c.field", "source_a", "c.value_a", "source_b", "c.value_b",
                    F.lit(None).cast("string").alias("resolved_value"),
                    F.lit(None).cast("string").alias("note")))


def resolutions(records: DataFrame) -> DataFrame:
    """(canonical_id, field, resolved_value, note): the value that the records of a meeting
    vote for, for each conflict field on which they name several.

    A value of a record of better quality wins, then one that more records have, then
    the one seen first. Missing and empty values have no vote. Votes are counted a value
    before they are compared, so a meeting of very many records is no row of its own.
    """
    votes = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))
                      for f in CONFLICT_FIELDS])
    values = (records.select(KEY, quality_rank(F.col("transcript_quality")).alias("rank"),
                             "ingest_seq", F.explode(votes).alias("v"))
              .where(has_text(F.col("v.value")))
              .groupBy(KEY, F.col("v.field").alias("field"), F.col("v.value").alias("value"))
              .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"),
                   (-F.min("ingest_seq")).alias("first")))
    best = values.groupBy(KEY, "field").agg(
        F.max(F.struct("rank", "n", "first", "value")).alias("best"),
        F.count(F.lit(1)).alias("values"), F.sum("n").alias("votes"))
    note = F.format_string("%d of %d records, quality %d, %d values", "best.n", "votes",
                           "best.rank", "values")
    return best.where("values > 1").select(
        KEY, "field", F.col("best.value").alias("resolved_value"), note.alias("note"))


def conflicts_resolved(records: DataFrame) -> DataFrame:
    """:func:`conflicts` with the value that each is resolved to, and why."""
    return conflicts(records).drop("resolved_value", "note").join(
        resolutions(records), [KEY, "field"], "left")


def resolve(records: DataFrame) -> Resolved:
    """The linking results over one table of canonical records."""
    return Resolved(meetings(records), provenance(records), conflicts(records))


def overlap_stats(links: DataFrame, conflict_rows: DataFrame) -> DataFrame:
    """Counts of a linking run: records, meetings, linked, cross-source, conflicts."""
    per_meeting = links.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("source").alias("low"), F.max("source").alias("high"))
    stats = per_meeting.select(
        F.col("n").alias("records"), F.lit(1).cast("long").alias("meetings"),
        (F.col("n") > 1).cast("long").alias("linked"),
        (F.col("low") != F.col("high")).cast("long").alias("cross_source"),
        F.lit(0).cast("long").alias("conflicts"))
    zero = F.lit(0).cast("long")
    flagged = conflict_rows.select(
        zero.alias("records"), zero.alias("meetings"), zero.alias("linked"),
        zero.alias("cross_source"), F.lit(1).cast("long").alias("conflicts"))
    return stats.unionByName(flagged).agg(*[
        F.coalesce(F.sum(c), zero).alias(c)
        for c in ("records", "meetings", "linked", "cross_source", "conflicts")])
