import random
from collections import Counter

import numpy as np
import pytest

from townhall_spark.llm import ngram_join
from townhall_spark.llm.components import components

SCHEMA = "doc_id long, text string, n long, id string"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width, percent):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {d: shingles(t, width) for d, t in rows}
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {d: (len(sets[d]), label[d]) for d in sets}


def corpus(seed):
    """Texts with shared passages, chains of edits, copies, short and empty ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(40):
        texts.append([word() for _ in range(rng.randrange(1, 60))] + passage * rng.randrange(2))
    for _ in range(80):
        base = list(rng.choice(texts))
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = word()
        texts.append(base)
    texts += [passage] * 5 + [[], ["Solo"], ["solo"], ["a", "b", "c"], ["a", "b", "c"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_against_brute_force(spark, width, percent, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], SCHEMA).repartition(4)
    got = {r.id: (r.n, r.component) for r in ngram_join.join(docs, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_sliced_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_SLICE", 3)
    monkeypatch.setattr(ngram_join, "MOST_SLICE", 5)
    monkeypatch.setattr(ngram_join, "FIRST_SEARCHES", 1)
    rows = corpus(4)
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], SCHEMA)
    got = {r.id: (r.n, r.component) for r in ngram_join.join(docs, 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_a_large_group_of_near_copies_in_slices(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_SLICE", 9)
    monkeypatch.setattr(ngram_join, "MOST_SLICE", 14)
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(70)]
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(rng.randrange(7)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(300)}"
        rows.append((i, " ".join(text)))
    want = brute(rows, 4, 85)
    assert 2 < len(set(want.values())) and max(Counter(c for _, c in want.values()).values()) > 40
    got = {r.id: (r.n, r.component) for r in ngram_join.join(
        spark.createDataFrame([(d, t, 0, "x") for d, t in rows], SCHEMA), 4, 85).collect()}
    assert got == want


def test_search_in_one_cell_against_brute_force():
    rng = np.random.default_rng(5)
    for percent in (50, 80, 85, 100):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 40))).astype(np.uint64)
                for _ in range(60)]
        label = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                o = len(np.intersect1d(sets[a], sets[b]))
                if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                    old, new = label[a], label[b]
                    label = [new if x == old else x for x in label]
        roots = ngram_join.linked(sets, percent)
        pairs = {(label[i] == label[j], roots[i] == roots[j]) for i in range(60) for j in range(60)}
        assert pairs <= {(True, True), (False, False)}


def test_nulls_repeats_and_ids(spark):
    same = "one two three four five six seven eight"
    rows = [(7, same, 0, "x"), (7, same, 0, "x"), (3, same.upper(), 0, "x"), (None, same, 0, "x"),
            (None, None, 0, "x"), (9, None, 0, "x"), (10, "", 0, "x"), (11, " \t", 0, "x"),
            (12, "Ärger", 0, "x"), (13, "ärger", 0, "x")]
    got = ngram_join.join(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()
    assert len(got) == len(rows)
    by = {r.id: (r.n, r.component) for r in got if r.id < ngram_join.NO_ID}
    assert by == {7: (5, 3), 3: (5, 3), 9: (0, 9), 10: (0, 10), 11: (0, 11), 12: (1, 12), 13: (1, 13)}
    assert sorted((r.n, r.component < ngram_join.NO_ID) for r in got
                  if r.id >= ngram_join.NO_ID) == [(0, False), (5, True)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n", "id"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 3), (False, 9), (False, 10), (False, 11), (False, 12), (False, 13), (True, 0)]


def test_different_texts_of_one_id(spark):
    one, two = "one two three four five six seven eight", "nine ten eleven twelve some more words"
    rows = [(5, one, 1, "b"), (5, two, 2, "a"), (6, two, 3, "c"), (5, one, 1, "a"),
            (8, one, 4, "d"), (None, "alone here with words", 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = ngram_join.join(df, 4, 85).collect()
    assert sorted((r.id, r.component) for r in got if r.id < ngram_join.NO_ID) == [
        (5, 5), (5, 5), (5, 5), (6, 5), (8, 5)]
    # Both texts of the id stay, the same rows in every run.
    want = [(5, one, 1, "a"), (5, two, 2, "a"), (None, "alone here with words", 0, "x")]
    for n in (1, 2, 5):
        kept = ngram_join.one_of_each(df.repartition(n)).collect()
        assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_one_of_each_keeps_columns_of_any_name(spark):
    schema = "doc_id long, text string, _id string, digest string, component long, row int, rows int"
    rows = [(1, "a b c d e f", "p", "q", 7, 8, 9), (2, "A b c d e f", "p", "q", 7, 8, 9),
            (3, None, "r", "s", 1, 2, 3), (3, None, "r", "s", 1, 2, 3)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, schema))
    assert kept.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2], rows[3]]
    assert ngram_join.one_of_each(spark.createDataFrame([], schema)).count() == 0


def test_frequent_shingles_are_sent_once_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    rng = random.Random(6)
    common = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join(rng.sample(common, 2) + common + [f"w{rng.randrange(60)}"
                         for _ in range(rng.randrange(12))])) for i in range(150)]
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], SCHEMA).repartition(2)
    got = {r.id: (r.n, r.component) for r in ngram_join.join(docs, 4, 85).collect()}
    assert got == brute(rows, 4, 85)
    deal = ngram_join._deal(4, 3, 1 << 20)
    from pyspark import TaskContext
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda _: type("T", (), {
        "partitionId": lambda self: 0})()))
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in rows]), pa.array([b"0" * 16] * len(rows)),
         pa.array([t for _, t in rows])], ["id", "digest", "text"])
    dealt = [r for part in deal(iter([batch])) for r in part.to_pylist()]
    # Every document holds 27 common shingles: they are no occurrences any more.
    assert sum(len(r["keys"]) // 4 for r in dealt) <= sum(
        len(shingles(t, 4)) for _, t in rows) - 27 * 150
    assert sum(len(r["often"]) // 4 for r in dealt) >= 27
    assert sum(r["ids"] is not None for r in dealt) == 1


def test_a_very_long_text_and_its_near_copy(spark):
    words = [f"w{i % 977}x{i}" for i in range(60000)]
    near = words[:]
    near[30000] = "other"
    rows = [(1, " ".join(words), 0, "x"), (2, " ".join(near), 0, "x"), (3, "w0x0 w1x1", 0, "x")]
    got = {r.id: r.component for r in ngram_join.join(
        spark.createDataFrame(rows, SCHEMA), 4, 85).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, j) for j in range(6, 60)] + [(70, 70)]
    got = {r.node: r.label for r in components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(5, 60), 5)}
