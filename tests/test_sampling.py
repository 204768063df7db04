"""Sampling properties: bounds, whole groups, determinism, strata."""

import collections
import hashlib

import pytest

from townhall_spark.operators import labelling, sampling, skew
from pyspark.sql import functions as F


def grouped(spark, multi, singles, size=3):
    rows = [(f"g{g}", i) for g in range(multi) for i in range(size)]
    rows += [(f"s{s}", 0) for s in range(singles)]
    return spark.createDataFrame(rows, "k string, i int")


@pytest.mark.parametrize("multi,singles,size,expected_groups,expected_singles", [
    (5, 100, 50, 5, 35), (60, 10, 200, 40, 10), (60, 10, 30, 40, 0), (0, 10, 4, 0, 4),
    (3, 0, 200, 3, 0),
])
def test_group_preserving(spark, multi, singles, size, expected_groups, expected_singles):
    df = grouped(spark, multi, singles)
    rows = sampling.group_preserving_sample(df, ["k"], size).collect()
    counts = collections.Counter(r.k for r in rows)
    assert all(n == 3 for k, n in counts.items() if k.startswith("g"))
    assert sum(k.startswith("g") for k in counts) == expected_groups
    assert sum(k.startswith("s") for k in counts) == expected_singles
    again = sampling.group_preserving_sample(df.repartition(5), ["k"], size).collect()
    assert sorted(again) == sorted(rows)
    if 0 < expected_singles < singles:
        ranked = sorted((hashlib.sha1(f"42|s{i}".encode()).hexdigest(), f"s{i}")
                        for i in range(singles))
        assert {k for k in counts if k.startswith("s")} == {
            k for _, k in ranked[:expected_singles]}


def test_bounded(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("ingest_seq"))
    assert [r.ingest_seq for r in sampling.bounded(df, 3).collect()] == [0, 1, 2]
    assert sampling.bounded(df, 0).count() == 100


def test_top_k_per_group_is_exact(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot")
                                  .otherwise((F.col("id") % 7).cast("string")).alias("g"),
                                  ((F.col("id") * 7919) % 5003).alias("v"))
    got = skew.top_k_per_group(df, ["g"], [F.col("v")], 11, F.col("v"), 4).collect()
    by_group = {}
    for r in df.collect():
        by_group.setdefault(r.g, []).append(r.v)
    assert sorted((r.g, r.v) for r in got) == sorted(
        (g, v) for g, vs in by_group.items() for v in sorted(vs)[:11])


def actions(spark):
    rows = [(f"m{i}", f"text {i}", "adaptation" if i < 90 else "mitigation", "heat", 0.75)
            for i in range(100)]
    rows.append(("m200", "text 5", "adaptation", "heat", 0.75))
    return spark.createDataFrame(
        rows, "canonical_id string, action_text string, action_category string,"
              "hazard_type string, confidence double")


def test_stratified(spark):
    counts = collections.Counter(
        r.action_category for r in sampling.stratified_sample(actions(spark), 80).collect())
    assert counts == {"adaptation": 20, "mitigation": 10}
    assert sampling.stratified_sample(actions(spark), 1).count() == 2


def test_candidates_skip_labelled_and_repeat_texts(spark):
    golden = spark.createDataFrame([(f"text {i}",) for i in range(0, 90)],
                                   "action_text string")
    rows = labelling.label_candidates(actions(spark), golden, 1000).collect()
    assert sorted(r.action_text for r in rows) == [f"text {i}" for i in range(90, 100)]
    nothing = golden.where("false")
    texts = [r.action_text for r in
             labelling.label_candidates(actions(spark), nothing, 1000).collect()]
    assert len(texts) == len(set(texts)) == 100


def test_label_codes(spark):
    df = spark.createDataFrame([
        ("c", "t1", "both", "heat", " M ", "l"), ("c", "t2", "both", None, "", "?"),
        ("c", "t3", "both", "heat", None, "N")],
        "canonical_id string, action_text string, action_category string, hazard_type string,"
        "c1 string, c2 string")
    rows = labelling.label(df, F.col("c1"), F.col("c2"), "me").collect()
    assert [(r.action_text, r.action_category, r.hazard_type, r.label_source)
            for r in rows] == [("t1", "mitigation", "sea_level_rise", "me"),
                               ("t2", "both", "none", "me"), ("t3", "both", "none", "me")]
