"""Composite ids and segment grouping."""

import datetime as dt

from pyspark.sql import functions as F

from townhall_spark.operators import linking, segments


def test_parse_uid(spark):
    cases = {
        "DenverCityCouncil_05012017_17-0161": ("0820000", "CO", "Denver", dt.date(2017, 5, 1),
                                               "council_full", "DenverCityCouncil_05012017"),
        "KingCountySpecialCommittee_02292016": ("53033", "WA", "King County",
                                                dt.date(2016, 2, 29), "committee",
                                                "KingCountySpecialCommittee_02292016"),
        "LongBeachSpecialWorkshop_01012020_x_y": ("0643000", "CA", "Long Beach",
                                                  dt.date(2020, 1, 1), "special",
                                                  "LongBeachSpecialWorkshop_01012020"),
        "bostonalameda_01012020_1": ("0600562", "CA", "Alameda", dt.date(2020, 1, 1),
                                     "council_full", "bostonalameda_01012020"),
        "Springfield_05012017_1": None, "Denver": None, "Denver_13012017_1": None,
        "Denver_5012017_1": None, "Denver_05010000_1": None, "": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "uid string")
    out = df.select("uid", segments.parse_uid(F.col("uid")).alias("p")).collect()
    assert {r.uid: None if r.p is None else tuple(r.p) for r in out} == cases


def raw(spark):
    return spark.createDataFrame([
        ("DenverCityCouncil_05012017_b", "second", 12),
        ("DenverCityCouncil_05012017_a", "first", 11),
        ("DenverCityCouncil_05012017_c", "first", 13),
        ("DenverCityCouncil_05012017_d", None, 14),
        ("DenverCouncil_05012017_e", "other body, same day", 15),
        ("DenverCommittee_05012017_a", None, 1),
        ("DenverCommittee_05012017_b", "", 2),
        ("Nowhere_05012017_b", "lost", 3),
    ], "uid string, transcript string, ingest_seq long")


def test_grouping(spark):
    rows = {r.meeting_type: r for r in
            segments.segments_to_meetings(raw(spark), "segments", "https://x/").collect()}
    council, committee = rows["council_full"], rows["committee"]
    assert len(rows) == 2
    assert council.transcript == "first\n\nsecond\n\nfirst\n\nother body, same day"
    assert (council.source_record_id, council.ingest_seq, council.transcript_quality) == (
        "DenverCityCouncil_05012017", 11, "full_text")
    assert (committee.transcript, committee.transcript_quality, committee.transcript_chars,
            committee.source, committee.source_url) == (
        None, "metadata_only", 0, "segments", "https://x/")


def test_a_huge_meeting_is_one_record_of_true_length(spark):
    rows = [(f"DenverCityCouncil_05012017_{i}", f"segment {i} " + "x" * 20000, i)
            for i in range(1000)]
    rows.append(("DenverCommittee_05012017_1", " \n", 2000))
    df = spark.createDataFrame(rows, "uid string, transcript string, ingest_seq long")
    got = {r.meeting_type: r for r in segments.segments_to_meetings(df, "segments").collect()}
    whole = "\n\n".join(r[1] for r in rows[:1000])
    assert len(got) == 2 and got["council_full"].transcript == whole
    assert got["council_full"].transcript_chars == len(whole) > 20_000_000
    blank = got["committee"]
    assert (blank.transcript, blank.transcript_quality, blank.transcript_chars) == (
        " \n", "full_text", 0)
    linked = {r.meeting_type: r for r in linking.primaries(
        segments.segments_to_meetings(df, "segments")).collect()}
    assert linked["council_full"].transcript == whole
    assert linked["committee"].transcript is None
