"""Agenda segments with a composite uid, grouped into meetings.

A uid reads ``<Body>_<MMDDYYYY>_<item>``; the body names a jurisdiction and
the kind of meeting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.functions.fields import parse_date
from townhall_spark.functions.ids import canonical_id
from townhall_spark.functions.literals import text_array
from townhall_spark.functions.regions import lookup
from townhall_spark.functions.text import has_text, let, ustrip
from townhall_spark.operators.text_assembly import in_order
from townhall_spark.operators.text_parts import parts

# Token in the body -> (fips, state, name), tested in this order.
BODY_JURISDICTIONS = {
    "alameda": ("0600562", "CA", "Alameda"),
    "boston": ("2507000", "MA", "Boston"),
    "denver": ("0820000", "CO", "Denver"),
    "longbeach": ("0643000", "CA", "Long Beach"),
    "kingcounty": ("53033", "WA", "King County"),
    "seattle": ("5363000", "WA", "Seattle"),
}
# Words in the body that name the meeting type, tested in this order.
BODY_TYPES = ("committee", "special", "workshop")
BODY_TYPE_DEFAULT = "council_full"


def _first_token(low: Column, tokens: tuple[str, ...]) -> Column:
    """First of the tokens, in their order, that occurs in the text."""
    return F.get(F.filter(text_array(tokens), lambda t: F.contains(low, t)), F.lit(0))


def _attribute(token: Column, position: int) -> Column:
    return lookup({t: v[position] for t, v in BODY_JURISDICTIONS.items()}, token, None)


def parse_uid(uid: Column) -> Column:
    """``struct<fips, state, name, meeting_date, meeting_type, meeting_uid>``, or null
    when the uid names no known jurisdiction or no valid date."""
    def parts(p: Column) -> Column:
        body, day = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return F.struct(
            _first_token(F.lower(body), tuple(BODY_JURISDICTIONS)).alias("place"),
            F.coalesce(_first_token(F.lower(body), BODY_TYPES), F.lit(BODY_TYPE_DEFAULT))
            .alias("kind"),
            parse_date(day, "mmddyyyy").alias("day"),
            F.concat_ws("_", body, day).alias("meeting_uid"))

    def fields(p: Column) -> Column:
        return F.when(p.place.isNotNull() & p.day.isNotNull(), F.struct(
            _attribute(p.place, 0).alias("fips"), _attribute(p.place, 1).alias("state"),
            _attribute(p.place, 2).alias("name"), p.day.alias("meeting_date"),
            p.kind.alias("meeting_type"), p.meeting_uid.alias("meeting_uid")))

    return let(let(F.split(uid, "_", -1), parts), fields)


def _parsed(raw: DataFrame) -> DataFrame:
    return (raw.select(parse_uid(F.col("uid")).alias("p"), "transcript", "ingest_seq")
            .where(F.col("p").isNotNull()).select("p.*", "transcript", "ingest_seq"))


def segment_parts(raw: DataFrame) -> DataFrame:
    """(canonical_id, part, offset, total, text): the segments of each meeting in arrival
    order, with their places in its transcript; no task holds a meeting."""
    meeting = canonical_id(F.col("fips"), F.col("meeting_date"), F.col("meeting_type"))
    return parts(_parsed(raw).select(meeting.alias("canonical_id"), "transcript", "ingest_seq"),
                 ["canonical_id"], ["ingest_seq"])


def segments_to_meetings(raw: DataFrame, source: str, source_url: str = "") -> DataFrame:
    """Canonical records of raw segments (uid, transcript, ingest_seq), one per meeting.

    Segment texts join in arrival order; the first segment gives the meeting's
    uid and arrival number.
    """
    grouped = _parsed(raw).groupBy("fips", "meeting_date", "meeting_type").agg(
        F.min(F.struct("ingest_seq", "meeting_uid", "state", "name")).alias("first"),
        in_order(["ingest_seq"], "transcript").alias("transcript"))
    chars = F.when(ustrip(F.col("transcript")) != "", F.length("transcript")).otherwise(0)
    return grouped.select(
        canonical_id(F.col("fips"), F.col("meeting_date"), F.col("meeting_type"))
        .alias("canonical_id"),
        F.col("first.name").alias("jurisdiction_name"),
        F.col("fips").alias("jurisdiction_fips"),
        F.col("first.state").alias("state"),
        "meeting_date", "meeting_type", "transcript",
        F.when(has_text(F.col("transcript")), "full_text").otherwise("metadata_only")
        .alias("transcript_quality"),
        F.lit(source).alias("source"), F.lit(source_url).alias("source_url"),
        F.col("first.meeting_uid").alias("source_record_id"),
        F.col("first.ingest_seq").alias("ingest_seq"),
        chars.cast("long").alias("transcript_chars"))
