"""Metrics against a plain-Python computation."""

import json
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from townhall_spark.operators import evaluation
from townhall_spark.schemas import ACTION_CATEGORIES, GOLDEN

PAIRS = ("y_true string, haz_true string, y_pred string, haz_pred string, confidence double")


def make_pairs(seed, n, categories):
    rng = random.Random(seed)
    return [(rng.choice(categories), rng.choice(["flood", "heat", "none"]),
             rng.choice(ACTION_CATEGORIES), rng.choice(["flood", "heat", "none"]),
             rng.choice([0.0, 0.45, 0.5, 0.6, 0.75, 0.9, 1.0])) for _ in range(n)]


def expected(pairs):
    n = len(pairs)
    true = [p[0] for p in pairs]
    pred = [p[2] for p in pairs]
    per, f1s = {}, []
    for c in ACTION_CATEGORIES:
        tp = sum(a == b == c for a, b in zip(true, pred))
        precision = tp / pred.count(c) if pred.count(c) else 0.0
        recall = tp / true.count(c) if true.count(c) else 0.0
        both = pred.count(c) + true.count(c)
        f1 = 2 * tp / both if both else 0.0
        f1s.append(f1)
        per[c] = (round(precision, 3), round(recall, 3), round(f1, 3), true.count(c))
    accuracy = sum(a == b for a, b in zip(true, pred)) / n
    chance = sum(true.count(c) * pred.count(c) for c in set(true + pred)) / n**2
    kappa = None if chance == 1 else round((accuracy - chance) / (1 - chance), 3)
    bins = {}
    for label, low, high in (("0.0-0.5", 0, 0.5), ("0.5-0.7", 0.5, 0.7), ("0.7-0.9", 0.7, 0.9),
                             ("0.9-1.0", 0.9, 1.01)):
        hit = [p for p in pairs if low <= p[4] < high]
        if hit:
            bins[label] = (len(hit), round(sum(p[0] == p[2] for p in hit) / len(hit), 3))
    hazards = {}
    for p in pairs:
        if p[0] == "adaptation":
            ok, total = hazards.get(p[1], (0, 0))
            hazards[p[1]] = (ok + (p[1] == p[3]), total + 1)
    hazards = {h: (ok, total, round(ok / total, 3)) for h, (ok, total) in hazards.items()}
    return per, (n, round(sum(f1s) / 4, 3), round(accuracy, 3), kappa), bins, hazards


@pytest.mark.parametrize("seed,n,categories", [
    (1, 200, ACTION_CATEGORIES), (2, 37, ("adaptation",)), (3, 50, ("both", "elsewhere")),
])
def test_reports(spark, seed, n, categories):
    pairs = make_pairs(seed, n, categories)
    tables = evaluation.evaluate_pairs(spark.createDataFrame(pairs, PAIRS), "m")
    per, overall, bins, hazards = expected(pairs)
    assert {r.category: tuple(r)[2:] for r in tables["per_category"].collect()} == per
    assert tuple(tables["overall"].first()) == ("m", *overall)
    assert {r.bin: (r.n, r.empirical_accuracy) for r in tables["calibration"].collect()} == bins
    assert {r.hazard_type: tuple(r)[2:] for r in tables["hazard"].collect()} == hazards


def test_perfect_single_class_has_no_kappa(spark):
    pairs = [("both", "none", "both", "none", 0.9)] * 5
    row = evaluation.overall(
        evaluation.score_cube(spark.createDataFrame(pairs, PAIRS)), "m").first()
    assert (row.golden_items, row.accuracy, row.kappa) == (5, 1.0, None)


def test_golden_last_label_wins_and_missing_hazard_is_none(spark):
    rows = [("c1", "same", "both", "heat", "x", 1), ("c2", "same", "adaptation", None, "y", 3),
            ("c3", "other", "mitigation", "none", "x", 2)]
    golden = spark.createDataFrame(
        rows, "canonical_id string, action_text string, action_category string,"
              "hazard_type string, label_source string, seq long")
    latest = {r.action_text: r for r in evaluation.golden_latest(golden).collect()}
    assert (latest["same"].action_category, latest["same"].canonical_id) == ("adaptation", "c2")
    always = lambda text: F.struct(F.lit("adaptation").alias("category"),
                                   F.lit(None).cast("string").alias("hazard"),
                                   F.lit(0.75).alias("confidence"))
    tables = evaluation.evaluate(golden, always, "always")
    assert tuple(tables["hazard"].first())[1:] == ("none", 1, 1, 1.0)
    assert tables["overall"].first().accuracy == 0.5


def test_scored_elsewhere(spark):
    golden = spark.createDataFrame([("a", "both", ""), ("b", "both", "heat")],
                                   "action_text string, action_category string,"
                                   "hazard_type string")
    scored = spark.createDataFrame([("a", "both", "heat", 0.8)],
                                   "action_text string, category string, hazard string,"
                                   "confidence double")
    rows = sorted(tuple(r) for r in evaluation.eval_pairs_scored(golden, scored).collect())
    assert rows == [("both", "heat", "unrelated", "none", 0.0),
                    ("both", "none", "both", "heat", 0.8)]


def test_empty_golden(spark):
    golden = spark.createDataFrame([], GOLDEN).withColumn("seq", F.lit(1))
    classify = lambda text: F.struct(F.lit("both").alias("category"),
                                     F.lit("none").alias("hazard"),
                                     F.lit(0.5).alias("confidence"))
    tables = evaluation.evaluate(golden, classify, "m")
    assert tuple(tables["overall"].first()) == ("m", 0, None, None, None)
    assert [r.support for r in tables["per_category"].collect()] == [0] * 4
    report = json.loads(evaluation.report_document(tables, "m").first().report)
    assert report["golden_items"] == 0 and "empty" in report["note"]


def test_method_compare_and_report(spark):
    pairs = make_pairs(5, 80, ACTION_CATEGORIES)
    tables = evaluation.evaluate_pairs(spark.createDataFrame(pairs, PAIRS), "m")
    per = {r.category: r.f1 for r in tables["per_category"].collect()}
    both = evaluation.method_compare(tables["per_category"],
                                     tables["per_category"].where("category <> 'both'"),
                                     ("x", "y")).collect()
    assert {r.category: (r.x, r.y) for r in both} == {
        c: (f, None if c == "both" else f) for c, f in per.items()}
    report = json.loads(evaluation.report_document(tables, "m").first().report)
    assert {c: e["f1"] for c, e in report["per_category"].items()} == per
    assert list(report) == [
        "method", "golden_items", "per_category", "macro_f1", "accuracy",
        "human_vs_model_cohen_kappa", "kappa_note", "confidence_calibration",
        "hazard_accuracy_exploratory", "hazard_note"]


def test_a_python_classifier_runs_once_a_row(spark):
    rows = [(f"the {i} flood plan" if i % 3 else None, "adaptation", "flood") for i in range(500)]
    golden = spark.createDataFrame(rows, "action_text string, action_category string, "
                                         "hazard_type string").repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def by_word(texts):
        seen.add(len(texts))
        flood = texts.str.contains("flood")
        return pd.DataFrame({"confidence": np.where(flood, 1, 0), "other": 1,
                             "hazard": np.where(flood, "flood", None),
                             "category": np.where(flood, "adaptation", "unrelated")})

    pairs = evaluation.eval_pairs(golden, evaluation.from_python(by_word)).collect()
    assert seen.value == 500
    assert Counter((r.y_pred, r.haz_pred, r.confidence) for r in pairs) == {
        ("adaptation", "flood", 1.0): 333, ("unrelated", "none", 0.0): 167}
    short = evaluation.from_python(lambda texts: by_word(texts).head(1))
    with pytest.raises(Exception, match="1 labels for"):
        evaluation.eval_pairs(golden, short).collect()
