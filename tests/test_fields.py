"""Field specs, text primitives, ids, regions and domain checks on hand-made rows."""

import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from townhall_spark.functions import domains, fields, regions, text
from townhall_spark.functions.ids import canonical_id
from townhall_spark.plans.fixtures import TABULAR_SPEC
from townhall_spark.schemas import ACTION, CANONICAL_MEETING
from townhall_spark.sources import specs


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", build(F.col("v")).alias("out")).collect()
    return [r["out"] for r in sorted(rows)]


def spec_values(spark, spec, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", fields.compile_spec(spec, df.schema).alias("out")).collect()
    return [r["out"] for r in sorted(rows)]


def test_whitespace_is_pythons():
    assert set(text.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip_matches_python(spark):
    values = [None, "", "  a b ", "　\x1cx \n", " ", "\ta\x85", "a\x00 "]
    assert column(spark, values, text.ustrip) == [v if v is None else v.strip() for v in values]


def test_sentences_match_python(spark):
    values = [
        "One sentence that is long enough. Two sentences that are long enough! short. x",
        "No break here even though it is a very long line\n\nAnd another long line  here",
        "Ends with dots...   And goes on for quite a long while after that?　Yes it does, really",
        "   Leading blanks before a sentence of enough length.\n  \nTrailing too, with enough length   ",
        "", "too short", "x" * 25, "x" * 24,
    ]
    expected = [[s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", v) if len(s.strip()) >= 25]
                for v in values]
    assert column(spark, values, text.sentences) == expected


def test_zfill_never_truncates(spark):
    assert column(spark, ["1", "12345", "123456", None], lambda c: text.zfill(c, 5)) == [
        "00001", "12345", "123456", None]


def test_copy_const_template(spark):
    assert spec_values(spark, {"copy": "v"}, [" a ", None]) == ["a", None]
    assert spec_values(spark, {"copy": "absent"}, ["a"]) == [None]
    assert spec_values(spark, {"const": 7}, ["a"]) == [7]
    assert spec_values(spark, {"template": "u/{v}?x"}, ["a", None]) == ["u/a?x", "u/?x"]
    assert spec_values(spark, {"template": "u/{v}"}, [5, 0], "int") == ["u/5", "u/"]
    assert spec_values(spark, {"template": "u/{absent}"}, ["a"]) == [""]
    with pytest.raises(ValueError):
        spec_values(spark, {"upper": "v"}, ["a"])


def test_state_and_body(spark):
    assert spec_values(spark, {"state_abbrev": "v"},
                       [" Ohio ", "ohio", None, "District of Columbia", "Guam"]) == [
        "OH", "", "", "DC", ""]
    assert spec_values(spark, {"meeting_type_from_govt": "v"}, [
        "City Council", "planning commission", "AMAZON COUNCIL", "School Board",
        "board of supervisors", "", None, "County Commission"]) == [
        "council_full", "committee", "committee", None, "council_full", None, None,
        "council_full"]


def test_dates(spark):
    iso = {"parse_date": {"column": "v"}}
    assert spec_values(spark, iso, [
        "2014-01-05", "2014-1-5", "2014-01-05T10:00", "2014-02-30", "0000-01-01", "n/a", "",
        None, "12345-01-01", "2014-01-5x"]) == [
        dt.date(2014, 1, 5), dt.date(2014, 1, 5), dt.date(2014, 1, 5), None, None, None, None,
        None, None, None]
    us = {"parse_date": {"column": "v", "format": "mmddyyyy"}}
    assert spec_values(spark, us, ["05012017", "13412016", "05010000", "5012017", "0501201x",
                                   "02292016", "02292015"]) == [
        dt.date(2017, 5, 1), None, None, None, None, dt.date(2016, 2, 29), None]


def test_clean_text(spark):
    spec = {"clean_text": {"column": "v", "missing": "<None>"}}
    assert spec_values(spark, spec, [" a ", "<NONE>", " <none> ", "", "  ", None, "<none>x"]) == [
        "a", None, None, None, None, None, "<none>x"]
    assert spec_values(spark, {"clean_text": {"column": "v"}}, ["", "a"]) == [None, "a"]


def test_canonical_id(spark):
    day = F.lit("2021-05-03").cast("date")
    out = column(spark, ["council_full", "committee"],
                 lambda c: canonical_id(F.lit("0820000"), day, c))
    assert out == [hashlib.sha1(f"0820000|2021-05-03|{t}".encode()).hexdigest()[:16]
                   for t in ("council_full", "committee")]


def test_regions(spark):
    assert column(spark, ["WA", "wa", "", "GU", None, "DC"], regions.region) == [
        "West", "West", "Unknown", "Unknown", "Unknown", "South"]
    assert column(spark, ["OH", "HI", ""], regions.division) == [
        "East North Central", "Pacific", "Unknown"]
    assert len(regions.STATE_REGION) == 51
    assert set(regions.STATE_REGION) == set(regions.STATE_CODES.values())


def test_map_fields_drops_unidentified(spark):
    raw = spark.createDataFrame([
        ("1", "Town", "Ohio", "2014-01-05", "City Council", " text ", "v1", 1),
        ("", "Town", "Ohio", "2014-01-05", "City Council", "text", "v2", 2),
        ("2", "Town", "Ohio", "bad", "City Council", "text", "v3", 3),
        ("3", "Town", "Ohio", "2014-01-05", "School Board", "text", "v4", 4),
        ("4", None, "Guam", "2014-01-05", "Zoning", None, None, 5),
    ], "st_fips string, place_name string, state_name string, meeting_date string,"
       "place_govt string, caption_text_clean string, vid_id string, ingest_seq long"
    ).withColumn("source", F.lit("s"))
    rows = {r.ingest_seq: r for r in specs.canonical_of(raw, TABULAR_SPEC).collect()}
    assert set(rows) == {1, 5}
    assert (rows[1].transcript, rows[1].transcript_quality, rows[1].transcript_chars) == (
        "text", "full_text", 4)
    five = rows[5]
    assert (five.jurisdiction_name, five.state, five.meeting_type, five.transcript,
            five.transcript_quality, five.source_record_id, five.source_url) == (
        "", "", "committee", None, "metadata_only", "",
        "https://video.example.org/watch?v=")


def test_domain_check_routes_rejects(spark):
    now = dt.datetime(2024, 1, 1)
    good = ("a", "n", "1", "WA", dt.date(2020, 1, 6), "council_full", "t", "full_text", "new",
            "", "r", now, 1, 1)
    bad = ("b", "n", "1", "WA", dt.date(2020, 1, 6), "picnic", "t", "great", "s", "", "r", now,
           2, 1)
    valid, rejects = domains.check_domain(
        spark.createDataFrame([good, bad], CANONICAL_MEETING), domains.MEETING_RULES)
    assert [r.canonical_id for r in valid.collect()] == ["a"]
    assert rejects.first().violations == ["meeting_type", "transcript_quality"]

    rows = [("x", "t", "both", "heat", 0.82, "v", now), ("y", "t", "both", None, 1.0, "v", now),
            ("z", "t", "both", "heat", 1.2, "v", now),
            ("n", "t", "both", "hail", float("nan"), "v", now)]
    valid, rejects = domains.check_domain(spark.createDataFrame(rows, ACTION),
                                          domains.ACTION_RULES)
    assert sorted(r.canonical_id for r in valid.collect()) == ["x", "y"]
    assert {r.canonical_id: r.violations for r in rejects.collect()} == {
        "z": ["confidence"], "n": ["hazard_type", "confidence"]}


def test_nan_to_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b")], "x double, y string")
    assert [r.x for r in domains.nan_to_null(df).orderBy("y").collect()] == [1.0, None]
