"""Ordered parts and windows against the joined texts, with one meeting of a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from townhall_spark.operators import extraction, linking, ordering, text_parts

SCHEMA = "meeting string, seq long, text string, other int"


def rows(seed, n=600):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        meeting = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None, "nothing"])
        text = "".join(rng.choices("ab é水\n😀", k=rng.choice([0, 1, 7, 40, 300])))
        out.append((meeting, seq, None if meeting == "nothing" or seq % 17 == 0 else text, 0))
    rng.shuffle(out)
    return out


def joined(data):
    texts = {}
    for meeting, _, text, _ in sorted(data, key=lambda r: r[1]):
        if text:
            texts.setdefault(meeting, []).append(text)
    return texts


def test_parts_against_joined_texts(spark):
    data = rows(1)
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = {}
    for r in text_parts.parts(df, ["meeting"], ["seq"], "text").collect():
        got.setdefault(r.meeting, []).append(r)
    want = joined(data)
    assert set(got) == set(want)
    for meeting, texts in want.items():
        whole, own = "\n\n".join(texts), sorted(got[meeting], key=lambda r: r.part)
        assert [r.part for r in own] == list(range(len(texts)))
        assert [r.text for r in own] == texts
        assert all(whole[r.offset:r.offset + len(r.text)] == r.text for r in own)
        assert {r.total for r in own} == {len(whole)}
    parts = text_parts.parts(df, ["meeting"], ["seq"], "text")
    for at_once in (1000, 7, 1):
        whole = text_parts.joined(parts, ["meeting"], at_once)
        assert {r.meeting: r.text for r in whole.collect()} == {
            m: "\n\n".join(t) for m, t in want.items()}


def test_a_text_that_no_string_holds_is_an_error_before_it_is_gathered(spark):
    parts = spark.createDataFrame([("a", 0, 0, 1 << 40, "x"), ("b", 0, 0, 1, "y")],
                                  "meeting string, part long, offset long, total long, text string")
    with pytest.raises(Exception, match="longer than a string"):
        text_parts.joined(parts, ["meeting"]).collect()
    assert text_parts.joined(parts.where("meeting = 'b'"), ["meeting"]).first().text == "y"


def test_rows_that_repeat_count_once_where_that_is_said(spark):
    data = [("m", 1, "one", 0), ("m", 1, "one", 0), ("m", 2, "two", 0), (None, 1, "x", 0)]
    got = text_parts.parts(spark.createDataFrame(data, SCHEMA), ["meeting"], ["seq"], "text",
                           repeated=True).collect()
    assert sorted((r.meeting or "", r.part, r.offset, r.total, r.text) for r in got) == [
        ("", 0, 0, 1, "x"), ("m", 0, 0, 8, "one"), ("m", 1, 5, 8, "two")]


@pytest.mark.parametrize(("size", "overlap", "block"), [(60, 9, 4096), (25, 24, 10), (7, 0, 3)])
def test_windows_against_joined_texts(spark, monkeypatch, size, overlap, block):
    monkeypatch.setattr(text_parts, "BLOCK_CHARS", block)
    data = rows(2, 120)
    parts = text_parts.parts(spark.createDataFrame(data, SCHEMA), ["meeting"], ["seq"], "text")
    got = {(r.meeting, r.window_seq): r.excerpt
           for r in text_parts.windows(parts, ["meeting"], size, overlap).collect()}
    want = {}
    for meeting, texts in joined(data).items():
        whole, step = "\n\n".join(texts), size - overlap
        for w in range(1 + -(-max(len(whole) - size, 0) // step)):
            want[meeting, w] = whole[w * step:w * step + size]
    assert got == want


def test_a_group_is_numbered_in_slices_of_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(F.lit("hot").alias("k"), F.xxhash64("id").alias("o"),
                                      (F.col("id") % 5).alias("w"))
        got = ordering.numbered(df, ["k"], ["o"], "w").collect()
        slices = ordering.stored(df.repartitionByRange("k", "o").withColumn(
            "s", F.spark_partition_id())).groupBy("s").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # One key lies in slices of about the same size.
    assert len(slices) == 8 and max(s["count"] for s in slices) < 2 * 5000 / 8
    before = 0
    for i, r in enumerate(sorted(got, key=lambda r: r.o)):
        assert (r._number, r._before, r._total) == (i, before, 10_000)
        before += r.w


def test_no_plan_gathers_a_meeting(spark):
    records = spark.createDataFrame(
        [(f"m{i % 3}", "n", "f", "OH", "2020-01-01", "other", "full_text", "s", "u", str(i),
          f"text {i % 50}", i) for i in range(200)],
        "canonical_id string, jurisdiction_name string, jurisdiction_fips string, state string, "
        "meeting_date string, meeting_type string, transcript_quality string, source string, "
        "source_url string, source_record_id string, transcript string, ingest_seq long")
    parts = linking.transcript_parts(records)
    assert "collect_list" not in parts._jdf.queryExecution().toString()
    prompts = extraction.prompt_windows(parts, "P")
    merged = extraction.prompt_table(linking.merged_transcripts(records), "P")
    assert sorted(map(tuple, prompts.collect())) == sorted(map(tuple, merged.collect()))


def test_empty_table(spark):
    parts = text_parts.parts(spark.createDataFrame([], SCHEMA), ["meeting"], ["seq"], "text")
    assert parts.count() == 0 and text_parts.windows(parts, ["meeting"], 10, 1).count() == 0


def test_one_very_long_text_is_cut_in_one_pass(spark):
    df = spark.range(1).select(F.lit("a").alias("meeting"), F.expr(
        "concat(repeat('0123456789', 1000000), 'end')").alias("text"))
    got = text_parts.windows(text_parts.whole(df, ["meeting"], "text"), ["meeting"], 6000, 200)
    n, chars, last = got.agg(F.count("*"), F.sum(F.length("excerpt")),
                             F.max_by("excerpt", "window_seq")).first()
    assert n == 1 + -(-(10_000_003 - 6000) // 5800) and last.endswith("9end")
    assert chars == 10_000_003 + 200 * (n - 1)
