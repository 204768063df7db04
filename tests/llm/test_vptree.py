import numpy as np
import pytest

from townhall_spark.llm import vptree

SCHEMA = "vec_id long, embedding array<double>, rank int"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v], 0)
                                  for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(ids, vectors, k):
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), int(j))
                          for j, w in zip(ids, vectors, strict=True) if j != i)
            out[int(i)] = near[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def test_factor_one_is_exact_over_shards_and_blocks(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1200, 8))
    vectors[700:720] = vectors[100]  # ties
    ids = rng.permutation(1200)
    df = frame(spark, ids, vectors)
    got = found(vptree.search(df, df.where("vec_id % 100 = 0"), 10, 1.0,
                              shard_vectors=300, query_block=5))
    want = brute(ids, vectors, 10)
    assert {q: [j for _, j in n] for q, n in got.items()} == \
        {q: [j for _, j in n] for q, n in want.items()}
    assert all(np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-14, atol=0)
               for q in want)


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (2.0, 0.9)])
def test_relaxed_pruning_visits_less_and_keeps_recall(factor, least):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 4
    vectors = np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 16))
    ids = np.arange(2000)
    tree = vptree.Tree(ids, vectors)
    seen = []
    real = vptree.distances
    vptree.distances = lambda q, v: (seen.append(len(q) * len(v)), real(q, v))[1]
    try:
        _, got = tree.search(ids[::100], vectors[::100], 10, factor)
    finally:
        vptree.distances = real
    want = brute(ids, vectors, 10)
    hits = sum(len({j for _, j in want[q]} & set(row.tolist()))
               for q, row in zip(ids[::100].tolist(), got, strict=True))
    assert hits >= least * 10 * len(want)
    assert sum(seen) < 0.7 * 20 * 2000


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, None, 0), (3, [], 0), (4, [0.0, 0.0], 0),
            (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (None, [1.0, 1.0], 0),
            (100, [1.0, 0.0], 0), (8, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0], 0), (200, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(vptree.search(df, df.where("vec_id % 100 = 0")))
    assert got == {0: [(0.0, 100), (2 ** 0.5, 1)], 100: [(0.0, 0), (2 ** 0.5, 1)]}


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vptree.search(df, df).count() == 0
    some = frame(spark, [1, 2], [[1, 2], [2, 1]])
    assert vptree.search(some, df).count() == 0 and vptree.search(df, some).count() == 0


def test_queries_go_only_to_cells_in_reach(spark):
    """Clusters far apart: a query's neighbours are all in cells near to its own."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(24, 6)) * 200
    vectors = np.repeat(centres, 100, axis=0) + rng.normal(size=(2400, 6))
    ids = rng.permutation(2400)
    df = frame(spark, ids, vectors)
    asked = df.where("vec_id % 100 = 0")
    sent = []
    real = vptree._meet
    vptree._meet = lambda trees, asking, *rest: (
        sent.append((trees.count(), asking.count())), real(trees, asking, *rest))[1]
    try:
        got = found(vptree.search(df, asked, 10, 1.0, shard_vectors=100))
    finally:
        vptree._meet = real
    want = brute(ids, vectors, 10)
    assert {q: [j for _, j in n] for q, n in got.items()} == \
        {q: [j for _, j in n] for q, n in want.items()}
    trees, home = sent[0]
    assert trees >= 24 and home == 24
    # All others of 24 cells would be 552 further searches.
    assert sent[1][1] < 120


def test_fewer_candidates_than_asked_for_are_found_in_all_cells(spark):
    df = frame(spark, [0, 1, 2, 3], [[0, 1], [500, 1], [1, 500], [900, 900]])
    got = found(vptree.search(df, df.where("vec_id = 0"), 10, shard_vectors=1))
    assert [j for _, j in got[0]] == [2, 1, 3]


def test_one_hot_cell_is_cut_into_shards(spark):
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.normal(size=(900, 4)) * 1e-3, rng.normal(size=(100, 4)) * 50])
    ids = np.arange(1000)
    df = frame(spark, ids, vectors)
    got = found(vptree.search(df, df.where("vec_id % 100 = 0"), 5, shard_vectors=60, query_block=2))
    want = brute(ids, vectors, 5)
    assert {q: [j for _, j in n] for q, n in got.items()} == \
        {q: [j for _, j in n] for q, n in want.items()}
