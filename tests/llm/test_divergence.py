import random
from collections import Counter

import numpy as np

from townhall_spark.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string, n long, term string, rank int"


def brute(rows, least, top):
    """All rows of the audit, from full vectors."""
    docs = [(lang or "", source or "", Counter(divergence.terms(text)))
            for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(s, c) for of, s, c in docs if of == lang]
        held = Counter(t for _, c in own for t in c)
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = {}
        for s, c in own:
            counts.setdefault(s, Counter()).update({t: c[t] for t in kept if t in c})
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
                           for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        for s in counts:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode())
                              for o in counts if o != s],
                     "term": [(p[s][t] - q[t], t) for t in kept
                              if counts[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                ranked = sorted(found, key=lambda f: (-f[0], f[1]))
                out += [(lang, s, part, item.decode(), value, rank) for rank, (value, item)
                        in enumerate(ranked if part == "pair" else ranked[:top], 1)]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = "river Flood élan board 水 tax-cut a1b vote plan fee zone".split()
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "fr", "", None])
        source = rng.choice(["s0"] * 5 + ["s1", "s2", "é3", None, ""])
        rows.append((lang, source, " ".join(rng.choices(words, k=rng.randrange(30)))))
    return rows + [("en", "s9", None), ("en", "s8", " 12 ! "), ("xx", "s1", "lone"), ("xx", "s2", "")]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 0, "x", 1) for i, r in enumerate(rows)], SCHEMA)


def test_against_full_vectors(spark):
    for seed in (1, 2):
        rows = corpus(seed) + corpus(seed)[:20]
        got = divergence.audit(frame(spark, rows).repartition(5), 6, 4).collect()
        assert sorted(map(tuple, got)) == brute(rows, 6, 4)


def test_hot_source_and_one_very_long_text(spark):
    rows = corpus(3) + [("en", "s0", "flood river")] * 200 + [("fr", "s1", "vote plan " * 200_000)]
    got = divergence.audit(frame(spark, rows), 10).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, 50)


def test_counts_handed_over_in_parts_are_the_same(spark, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(divergence, "COUNTED", 8)
    batches = frame(spark, rows).select("lang", "source", "text").fillna("").toArrow().to_batches()
    total = Counter()
    for part in divergence._count(iter(batches)):
        for r in part.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter()
    for lang, source, text in rows:
        want.update((lang or "", source or "", t.decode()) for t in divergence.terms(text))
    assert total == want


def test_tree_sums_corrections_over_shared_paths(monkeypatch):
    rng = np.random.default_rng(5)
    none = {s: int(rng.integers(1, 9)) for s in "abcdefgh"}
    rows = sorted(tuple((s, int(rng.integers(1, 4))) for s in "abcdefgh" if rng.random() < .6)
                  for _ in range(300))
    want = Counter()
    for row in rows:
        for i, (s, p) in enumerate(row):
            for t, r in row[:i]:
                want[s, t] += (abs(p - r) - abs(p - none[t]) - abs(none[s] - r)
                               + abs(none[s] - none[t]))
    for step in (divergence.CORRECTIONS, 8):
        monkeypatch.setattr(divergence, "CORRECTIONS", step)
        tree = divergence.Tree()
        for row in rows:
            if row:
                tree.insert([s for s, _ in row], [p for _, p in row], [none[s] for s, _ in row], 1)
        tree.close(0)
        a, b, sums = tree.corrections()
        assert {k: v for k, v in zip(zip(a, b, strict=True), sums.tolist(), strict=True) if v} \
            == {k: v for k, v in want.items() if v}


def test_a_language_without_kept_terms_and_an_empty_table(spark):
    rows = [("en", "a", "one"), ("en", "b", None)]
    got = sorted(map(tuple, divergence.audit(frame(spark, rows)).collect()))
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(frame(spark, [])).count() == 0
