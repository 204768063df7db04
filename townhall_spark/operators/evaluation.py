"""Scoring a classifier against a golden set.

One pass over the golden rows gives a small cube of counts (categories, bins,
hazards); every report is computed from that cube.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.functions.text import or_none
from townhall_spark.schemas import ACTION_CATEGORIES

# A classifier turns a text column into struct<category, hazard, confidence>; ``from_python``
# makes one of a Python function.
Classifier = Callable[[Column], Column]

# Confidence bins (label, lower bound, upper bound).
BINS = (("0.0-0.5", 0.0, 0.5), ("0.5-0.7", 0.5, 0.7), ("0.7-0.9", 0.7, 0.9),
        ("0.9-1.0", 0.9, 1.01))


def from_python(function: Callable[[pd.Series], pd.DataFrame]) -> Classifier:
    """The classifier of a Python function over batches of texts.

    ``function`` takes a series of texts, null as empty, and returns a frame of as many
    rows with the columns category, hazard and confidence; it runs in Python workers, on
    Arrow batches, once for each row. Load a model inside of it and keep it there: it
    is called once a batch.
    """
    fields = ("category", "hazard", "confidence")

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = function(texts.fillna(""))
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} labels for {len(texts)} texts")
            yield found[list(fields)].astype({"confidence": "float64"}).reset_index(drop=True)

    # Not deterministic to Spark: it must not be copied to where a field of it is used.
    udf = F.pandas_udf(label, "category string, hazard string, confidence double").asNondeterministic()
    return lambda text: udf(text)


def golden_latest(golden: DataFrame, order: str = "seq") -> DataFrame:
    """Last label per text wins; ``order`` is any unique, comparable column."""
    others = [c for c in golden.columns if c not in ("action_text", order)]
    return (golden.groupBy("action_text")
            .agg(F.max(F.struct(order, *others)).alias("last"))
            .select("action_text", f"last.{order}", *[f"last.{c}" for c in others]))


def _pairs(rows: DataFrame, keep: tuple[str, ...], label: Column) -> DataFrame:
    return (rows.select(*keep, F.col("action_category").alias("y_true"),
                        or_none(F.col("hazard_type")).alias("haz_true"),
                        label.alias("label"))
            .select(*keep, "y_true", "haz_true", F.col("label.category").alias("y_pred"),
                    or_none(F.col("label.hazard")).alias("haz_pred"),
                    F.col("label.confidence").cast("double").alias("confidence")))


def eval_pairs(golden: DataFrame, classifier: Classifier, keep: tuple[str, ...] = ()
               ) -> DataFrame:
    """(keep..., y_true, haz_true, y_pred, haz_pred, confidence) per golden row."""
    return _pairs(golden, keep, classifier(F.col("action_text")))


def eval_pairs_scored(golden: DataFrame, scored: DataFrame) -> DataFrame:
    """Pairs for predictions made elsewhere: (action_text, category, hazard, confidence).

    A golden text without a prediction counts as ``unrelated`` at confidence 0.
    """
    label = F.struct(
        F.coalesce("category", F.lit("unrelated")).alias("category"), F.col("hazard"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return _pairs(golden.join(scored, "action_text", "left"), (), label)


def score_cube(pairs: DataFrame) -> DataFrame:
    """Counts ``n`` by true and predicted category, confidence bin and hazard agreement.

    Its size is bounded by the domains, not by the data.
    """
    bin_label = None
    for label, low, high in BINS:
        inside = (F.col("confidence") >= low) & (F.col("confidence") < high)
        bin_label = F.when(inside, label) if bin_label is None else bin_label.when(inside, label)
    return pairs.groupBy(
        "y_true", "y_pred", bin_label.alias("bin"), "haz_true",
        (F.col("haz_true") == F.col("haz_pred")).alias("haz_ok"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    """Double ratio, null for a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def _or_zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def _label_counts(cube: DataFrame) -> DataFrame:
    """(label, tp, true_n, pred_n) over the union of observed labels."""
    zero = F.lit(0).cast("long")
    n = F.col("n")
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), n.alias("true_n"), zero.alias("pred_n"),
                 F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(zero).alias("tp")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("true_n"), n.alias("pred_n"),
                 zero.alias("tp")))
    return (cube.select(F.explode(sides).alias("s")).select("s.*").groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("true_n").alias("true_n"),
        F.sum("pred_n").alias("pred_n")))


def _category_dim(df: DataFrame) -> DataFrame:
    values = ", ".join(f"('{c}')" for c in ACTION_CATEGORIES)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(category)")


def _f1() -> Column:
    return _or_zero(_ratio(2 * F.col("tp"), F.col("pred_n") + F.col("true_n")))


def _scores(cube: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    joined = _category_dim(cube).join(
        F.broadcast(_label_counts(cube)), F.col("category") == F.col("label"), "left").select(
        "category", *[F.coalesce(c, zero).alias(c) for c in ("tp", "true_n", "pred_n")])
    return joined.select(
        "category",
        _or_zero(_ratio(F.col("tp"), F.col("pred_n"))).alias("precision"),
        _or_zero(_ratio(F.col("tp"), F.col("true_n"))).alias("recall"),
        _f1().alias("f1"), F.col("true_n").alias("support"))


def per_category(cube: DataFrame, method: str) -> DataFrame:
    """Precision, recall, F1 and support of the four categories, 0 where undefined."""
    return _scores(cube).select(
        F.lit(method).alias("method"), "category",
        *[F.bround(c, 3).alias(c) for c in ("precision", "recall", "f1")], "support")


def overall(cube: DataFrame, method: str) -> DataFrame:
    """Golden items, macro F1, accuracy and Cohen's kappa; nulls for an empty set."""
    # A category nobody used has no row here and an F1 of 0.
    scored = F.when(F.col("label").isin(*ACTION_CATEGORIES), _f1()).otherwise(0.0)
    totals = _label_counts(cube).agg(
        F.coalesce(F.sum("true_n"), F.lit(0).cast("long")).alias("golden_items"),
        F.sum("tp").alias("tp"), (F.sum(scored) / len(ACTION_CATEGORIES)).alias("macro"),
        F.sum(F.col("true_n").cast("double") * F.col("pred_n").cast("double")).alias("chance"))
    n = F.col("golden_items")
    agreed = _ratio(F.col("tp"), n)
    expected = F.try_divide(F.col("chance"), n.cast("double") * n.cast("double"))
    return totals.select(
        F.lit(method).alias("method"), "golden_items", F.bround("macro", 3).alias("macro_f1"),
        F.bround(agreed, 3).alias("accuracy"),
        F.bround(F.try_divide(agreed - expected, F.lit(1.0) - expected), 3).alias("kappa"))


def calibration(cube: DataFrame, method: str) -> DataFrame:
    """Size and accuracy of the non-empty confidence bins."""
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    return (cube.where(F.col("bin").isNotNull()).groupBy("bin")
            .agg(F.sum("n").alias("n"), right.alias("right"))
            .select(F.lit(method).alias("method"), "bin", "n",
                    F.bround(_ratio(F.col("right"), F.col("n")), 3)
                    .alias("empirical_accuracy")))


def hazard_accuracy(cube: DataFrame, method: str) -> DataFrame:
    """Hazard agreement per golden hazard, over golden adaptation rows."""
    return (cube.where(F.col("y_true") == "adaptation").groupBy("haz_true")
            .agg(F.sum(F.when(F.col("haz_ok"), F.col("n")).otherwise(0)).alias("correct"),
                 F.sum("n").alias("support"))
            .select(F.lit(method).alias("method"), F.col("haz_true").alias("hazard_type"),
                    "correct", "support",
                    F.bround(_ratio(F.col("correct"), F.col("support")), 3)
                    .alias("accuracy")))


def evaluate_cube(cube: DataFrame, method: str) -> dict[str, DataFrame]:
    """The four report tables of a score cube."""
    return {
        "per_category": per_category(cube, method),
        "overall": overall(cube, method),
        "calibration": calibration(cube, method),
        "hazard": hazard_accuracy(cube, method),
    }


def evaluate_pairs(pairs: DataFrame, method: str) -> dict[str, DataFrame]:
    """The four report tables of prepared pairs."""
    return evaluate_cube(score_cube(pairs), method)


def evaluate(golden: DataFrame, classifier: Classifier, method: str,
             order: str = "seq") -> dict[str, DataFrame]:
    """The four report tables of a classifier over the latest golden labels."""
    return evaluate_pairs(eval_pairs(golden_latest(golden, order), classifier), method)


def method_compare(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """F1 by category of two methods side by side."""
    left = first.select("category", F.col("f1").alias(names[0]))
    right = second.select("category", F.col("f1").alias(names[1]))
    return left.join(right, "category", "full")


# The notes of a report.
KAPPA_NOTE = "Agreement between annotator labels and the method, not inter-annotator agreement."
HAZARD_NOTE = "Exploratory only; small per-class support."


def _entry(columns: dict[str, str]) -> Column:
    return F.struct(*[F.col(c).alias(name) for name, c in columns.items()])


def report_document(tables: dict[str, DataFrame], method: str) -> DataFrame:
    """(method, report): the nested report as one JSON text.

    ``per_category`` and ``hazard_accuracy_exploratory`` are objects by name,
    ``confidence_calibration`` is a list by bin. All parts meet in one aggregate;
    each has at most one entry per category, bin or hazard.
    """
    scores = _entry({c: c for c in ("precision", "recall", "f1", "support")})
    bins = _entry({"bin": "bin", "n": "n", "empirical_accuracy": "empirical_accuracy"})
    hazards = _entry({c: c for c in ("correct", "support", "accuracy")})
    totals = F.struct("golden_items", "macro_f1", "accuracy", "kappa")
    rows = None
    for name, part in (("overall", totals), ("per_category", F.struct("category", scores.alias("v"))),
                       ("calibration", bins), ("hazard", F.struct("hazard_type", hazards.alias("v")))):
        frame = tables[name].select(part.alias(name))
        rows = frame if rows is None else rows.unionByName(frame, allowMissingColumns=True)

    def listed(name: str) -> Column:
        return F.array_sort(F.collect_list(name))

    gathered = rows.agg(F.max("overall").alias("o"), listed("per_category").alias("c"),
                        listed("calibration").alias("b"), listed("hazard").alias("h"))
    note = F.when(F.col("o.golden_items") == 0, "golden set is empty")
    return gathered.select(F.lit(method).alias("method"), F.to_json(F.struct(
        F.lit(method).alias("method"), F.col("o.golden_items").alias("golden_items"),
        F.map_from_entries("c").alias("per_category"),
        F.col("o.macro_f1").alias("macro_f1"), F.col("o.accuracy").alias("accuracy"),
        F.col("o.kappa").alias("human_vs_model_cohen_kappa"),
        F.lit(KAPPA_NOTE).alias("kappa_note"), F.col("b").alias("confidence_calibration"),
        F.map_from_entries("h").alias("hazard_accuracy_exploratory"),
        F.lit(HAZARD_NOTE).alias("hazard_note"), note.alias("note"))).alias("report"))
