import random

import numpy as np
from townhall_spark.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"


def docs(spark, n=240):
    en = "the quick brown fox jumps over the lazy dog and then rests under a tree "
    de = "der schnelle braune Fuchs springt über den faulen Hund und schläft später "
    rows = [(i, (en if i % 2 else de)[i % 7:] * (1 + i % 3), "en" if i % 2 else "de", "x")
            for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_features_do_not_cross_words_and_chunks_add_up():
    assert sorted(langid.features("ab cd")) == sorted(
        list(langid.features("ab")) + list(langid.features("cd")))
    assert len(langid.features("123 !? ")) == 0


def test_parts_of_a_long_text_lose_and_add_no_n_gram(monkeypatch):
    text = "Überall der Hund, it's 7 dogs — and élan 水 vital " * 5
    whole = sorted(langid.features(text))
    for size in (1, 2, 3, 5, 16):
        monkeypatch.setattr(langid, "_CHUNK", size)
        assert sorted(langid.features(text)) == whole
    # Brute force: every n-gram of 1 to 4 characters, of which only the ends may be no letters.
    codes = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    n = sum((w > 2 or codes[i] != " ") and (" " not in codes[i + 1:i + w - 1] if w > 2 else True)
            for w in langid.WIDTHS for i in range(len(codes) - w + 1))
    assert n == len(whole)


def test_noise_in_labels_is_bounded(spark):
    rows = docs(spark).collect() + [(1000 + i, "some words here", f"noise{i}", "x")
                                    for i in range(400)]
    noisy = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    model = langid.fit(noisy, most_languages=4)
    assert {"de", "en"} <= set(model.languages) and len(model.languages) == 4
    found = langid.identify(docs(spark), model).collect()
    assert sum(r.lang_pred == r.row.lang for r in found) > 0.95 * len(found)
    few = langid.fit(noisy, sample_rows=100, most_languages=400)
    assert len(few.languages) <= 100


def test_scores_against_a_plain_computation(spark):
    """One text's score from its n-grams one at a time."""
    model = langid.fit(docs(spark))
    measure = model.measure()
    for text in ("the dog and der Hund", "x", "Fuchs " * 40):
        rows = [model.embeddings[b] for b in langid.features(text)]
        logits = (np.mean(rows, axis=0) @ model.weights + model.bias) / model.temperature
        p = np.exp(logits) / np.exp(logits).sum()
        name, score, share = measure(text)
        assert name == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-4
        known = sum(model.known[int(p.argmax())][b] for b in langid.features(text))
        assert abs(share - (known + langid.PRIOR) / (len(rows) + langid.PRIOR)) < 1e-9


def test_learned_languages_scores_and_missing_texts(spark):
    model = langid.fit(docs(spark))
    assert model.languages == ["de", "en"]
    rows = [(1, "the dog rests under the tree", None, "x"), (2, "der Hund schläft und springt", None, "x"),
            (3, None, "en", "x"), (4, "", "en", "x"), (5, "123 ?!", "en", "x"),
            (1, "the dog rests under the tree", None, "x"),
            (None, "the lazy dog " * 200000, None, "x")]
    found = langid.identify(spark.createDataFrame(rows, SCHEMA), model)
    got = sorted([(r.row.doc_id or 0, r.lang_pred, r.rejected) for r in found.collect()])
    assert got == [(0, "en", False), (1, "en", False), (1, "en", False), (2, "de", False),
                   (3, "und", True), (4, "und", True), (5, "und", True)]
    assert all(0 <= r.score <= 1 for r in found.collect())
    kept = langid.accepted(spark.createDataFrame(rows, SCHEMA), model)
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == 4


def test_fit_is_repeatable_and_reads_no_held_out_row(spark):
    first, again = langid.fit(docs(spark).repartition(3)), langid.fit(docs(spark).repartition(7))
    assert (first.weights == again.weights).all() and first.least == again.least
    only = docs(spark).where(langid.held_out())
    assert only.count() > 0 and langid.fit(only).languages == []


def test_without_labels_and_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = langid.fit(empty)
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs(spark, 4), model).collect()} == {"und"}


def test_a_left_out_language_and_letter_noise_are_rejected_and_learned_ones_stay(spark):
    rng = random.Random(4)
    alphabets = {"aa": "etaoinshrdlu", "bb": "aeioumnprstk", "cc": "wxzqjykvbgfc"}
    words = {n: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 8))) for _ in range(300)]
             for n, a in alphabets.items()}
    rows = [(i, " ".join(rng.choice(words[n]) for _ in range(60)), n, "x")
            for i, n in enumerate(["aa", "bb", "cc"] * 200)]
    rows += [(600 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(400)),
              "noise", "x") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(df.where("lang in ('aa', 'bb')"))
    got = langid.identify(df, model).select("row.doc_id", "row.lang", "rejected").collect()
    unknown = [r.rejected for r in got if r.lang in ("cc", "noise")]
    learned = [r.rejected for r in got if r.lang in ("aa", "bb")]
    assert sum(unknown) >= 0.95 * len(unknown) and sum(learned) <= 0.01 * len(learned)
