"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its character n-grams, which do not
cross words and are hashed to a fixed number of buckets; a linear layer and a
softmax give the languages. Stochastic gradient descent fits both on a bounded
sample of labelled rows. Scores are calibrated by a temperature on rows that
training did not see. A text is rejected for a low score, or for a low share of
n-grams that training saw in the language found: a softmax alone is sure of texts in
languages it never learned. Quantiles over more such rows give both limits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.llm.common import values

BUCKETS = 1 << 15
WIDTHS = (1, 2, 3, 4)
DIMENSIONS = 16
EPOCHS = 6
RATE = 1.0
# Rows, of all languages together, that a model is fitted on.
SAMPLE_ROWS = 2000
# Labels that are learned; a sample has a few rows of each.
MOST_LANGUAGES = 200
# Every so many rows of the sample calibrate and are not trained on.
CALIBRATE_EVERY = 4
# Share of labelled texts that calibration lets be rejected by each of the two limits.
REJECTED_SHARE = 0.001
# Further rows, of all languages together, that only the limits are taken from.
CALIBRATE_ROWS = 20000
# N-grams that count as known in any text, so few unseen ones do not reject a short one.
PRIOR = 100
# Up to this share unseen n-grams never reject.
UNSEEN_ALLOWED = 0.02
UNKNOWN = "und"
_CHUNK = 1 << 20
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def feature_parts(text: str) -> Iterator[np.ndarray]:
    """The bucket of every n-gram of a text's words, in parts of bounded length; none without
    letters. A part reaches as far into the next one as its last n-gram does."""
    padded, longest = f" {text.lower()} ", max(WIDTHS)
    for at in range(0, len(padded), _CHUNK):
        codes = np.frombuffer(padded[at:at + _CHUNK + longest - 1].encode("utf-32-le", "replace"),
                              np.uint32)
        codes = np.where(_letters()[codes], codes, np.uint32(0))
        for width in WIDTHS:
            count = min(_CHUNK, len(codes) - width + 1)
            if count < 1:
                continue
            mixed = codes[:count] * _MULTIPLIERS[0] + np.uint32(width)
            inner = codes[:count] != 0 if width < 3 else np.ones(count, bool)
            for k in range(1, width):
                part = codes[k:count + k]
                mixed = (mixed ^ (mixed >> np.uint32(15))) * _MULTIPLIERS[1] + part
                if width > 2 and k < width - 1:
                    inner &= part != 0
            mixed = (mixed ^ (mixed >> np.uint32(13))) * _MULTIPLIERS[0]
            yield (mixed >> np.uint32(17))[inner]


def features(text: str) -> np.ndarray:
    """The bucket of every n-gram of a text's words."""
    return np.concatenate([np.empty(0, np.uint32), *feature_parts(text)])


class Model(NamedTuple):
    """``known`` tells, per language, in which buckets training saw n-grams of it."""

    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    known: np.ndarray
    least_known: float

    def measure(self) -> Callable[[str | None], tuple[str, float, float]]:
        """text -> (language, calibrated score, known share of its n-grams)."""
        logits = (self.embeddings @ self.weights).astype(np.float32)

        def of(text: str | None) -> tuple[str, float, float]:
            total, count = np.zeros(len(self.languages)), 0
            seen = np.zeros(len(self.languages), np.int64)
            for buckets in feature_parts(text or ""):
                total += logits[buckets].sum(axis=0, dtype=np.float64)
                seen += np.array([np.count_nonzero(own[buckets]) for own in self.known], np.int64)
                count += len(buckets)
            if not count or not self.languages:
                return UNKNOWN, 0.0, 0.0
            p = _softmax((total / count + self.bias) / self.temperature)
            best = int(np.argmax(p))
            return self.languages[best], float(p[best]), _known_share(seen[best], count)
        return of

    def scorer(self) -> Callable[[str | None], tuple[str, float, bool]]:
        """text -> (language, calibrated score, rejected)."""
        measure = self.measure()

        def score(text: str | None) -> tuple[str, float, bool]:
            name, p, share = measure(text)
            return name, p, name == UNKNOWN or p < self.least or share < self.least_known
        return score

    def limited(self, scores: np.ndarray, shares: np.ndarray) -> Model:
        """The model with limits from rows that training did not see.

        Each is the quantile at ``REJECTED_SHARE``. Fewer rows than that has one of
        say little about the lowest to come: there the limit is half of the lowest
        score, and twice the largest unseen share.
        """
        if not len(scores):
            return self
        at = int(len(scores) * REJECTED_SHARE)
        least, unseen = float(np.sort(scores)[at]), 1 - float(np.sort(shares)[at])
        if not at:
            least, unseen = 0.5 * least, 2 * unseen
        return self._replace(least=least, least_known=1 - max(unseen, UNSEEN_ALLOWED))


def _known_share(seen: int, count: int) -> float:
    return float((seen + PRIOR) / (count + PRIOR))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7
          ) -> tuple[Model, np.ndarray, np.ndarray]:
    """Fits a model on (buckets, counts) of texts; every fourth text calibrates it.

    The model, which rejects nothing with letters, and the scores and known shares of
    the texts that calibrate; none where there are too few to keep some from training.
    """
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights = np.zeros((DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    target = np.array([languages.index(x) for x in labels], np.int64)
    shares = [counts / counts.sum() for _, counts in bags]
    order = np.arange(len(bags))
    held = (order % CALIBRATE_EVERY == 0) if len(bags) >= 4 * CALIBRATE_EVERY else order < 0
    learn = order[~held]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(learn):
            buckets, share = bags[i][0], shares[i]
            x = share @ embeddings[buckets]
            error = _softmax(x @ weights + bias)
            error[target[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(x, error)
            bias -= 0.1 * rate * error
            embeddings[buckets] -= 20 * rate * np.outer(share, back)
    check = order[held] if held.any() else order
    logits = np.array([shares[i] @ (embeddings[bags[i][0]] @ weights) + bias for i in check])
    logits = logits.reshape(-1, max(1, len(languages)))
    truth = target[check]

    def loss(t: float) -> float:
        p = _softmax(logits / t)[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(p, 1e-12)).mean()) if len(truth) else 0.0
    temperature = min((0.1 * 1.25 ** k for k in range(24)), key=loss)
    known = np.zeros((len(languages), BUCKETS), bool)
    for i in learn:
        known[target[i], bags[i][0]] = True
    model = Model(languages, embeddings, weights, bias, temperature, 0.0, known, 0.0)
    if not held.any():
        return model, np.empty(0), np.empty(0)
    p = _softmax(logits / temperature)
    shares_known = [_known_share(bags[i][1][known[k, bags[i][0]]].sum(), bags[i][1].sum())
                    for i, k in zip(check, p.argmax(axis=1), strict=True)]
    return model, p.max(axis=1), np.array(shares_known)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, buckets, counts = [], [], []
        for lang, text in zip(*map(values, batch.columns), strict=True):
            bag = np.zeros(BUCKETS, np.int64)
            for found in feature_parts(text):
                bag += np.bincount(found, minlength=BUCKETS)
            if bag.any():
                langs.append(lang)
                buckets.append(np.flatnonzero(bag).astype(np.int32))
                counts.append(bag[bag > 0].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(buckets, pa.list_(pa.int32())),
             pa.array(counts, pa.list_(pa.int32()))], names=["lang", "buckets", "counts"])


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text",
        sample_rows: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES) -> Model:
    """A model from a sample of about ``sample_rows`` labelled rows, equal per language.

    Rows are chosen by the hash of their id, among those with label and text that are
    not held out. Of more than ``most_languages`` labels the most frequent are learned. Only the rows' n-gram counts come to the driver, at most ``BUCKETS``
    numbers a row. Without labelled rows the model knows no language. About
    ``CALIBRATE_ROWS`` further rows, with two numbers each, set the limits of rejection.
    """
    rows = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)).alias("at"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(
        most_languages).collect()
    if not sizes:
        return train([], [])[0]
    # Of each language, the hashes below which rows train, and from there on set limits.
    each, more = sample_rows // len(sizes), CALIBRATE_ROWS // len(sizes)
    bounds = docs.sparkSession.createDataFrame(
        [(r["lang"], (1 << 30) * each // r["count"], (1 << 30) * (each + more) // r["count"])
         for r in sizes], "lang string, most long, last long")
    told = rows.join(F.broadcast(bounds), "lang")
    further = told.where("at >= most AND at < last")
    found = (told.where("at < most").select("lang", "text")
             .mapInArrow(_bags, "lang string, buckets array<int>, counts array<int>").toArrow())
    langs = found.column("lang").to_pylist()
    bags = [(np.array(b.values), np.array(c.values)) for b, c in
            zip(found.column("buckets"), found.column("counts"), strict=True)]
    # The order in which rows arrive may differ between runs; their content gives one that does not.
    order = sorted(range(len(langs)), key=lambda i: (bags[i][0].tobytes(), bags[i][1].tobytes()))
    model, scores, shares = train([bags[i] for i in order], [langs[i] for i in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = model.measure()
        for batch in batches:
            got = [g for g in map(measure, values(batch.column(0))) if g[0] != UNKNOWN]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.float64())], names=["score", "known"])
    got = further.select("text").mapInArrow(run, "score double, known double").toArrow()
    return model.limited(np.concatenate([scores, got.column("score").to_numpy()]),
                         np.concatenate([shares, got.column("known").to_numpy()]))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, lang_pred, score, rejected): ``row`` holds all columns of ``docs``.

    A null text and one without letters get ``und``, score 0, and are rejected. Texts
    are read whole, in parts of bounded length. Repeated rows get the same answer; an
    empty table gives an empty table; columns named like the result's stay in ``row``.
    """
    kind, at = docs.schema.simpleString(), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            found = [score(t) for t in values(batch.column(0).field(at))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.bool_())],
                names=["row", "lang_pred", "score", "rejected"])
    return docs.select(F.struct("*").alias("row")).mapInArrow(
        run, f"row {kind}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that the model does not reject, with their own columns.

    Rows without text or without a letter go; repeated rows stay or go together; an empty
    table stays empty; columns may have any name.
    """
    return identify(docs, model, text).where(~F.col("rejected")).select("row.*")
