import random

import numpy as np

from townhall_spark.llm import shards

SCHEMA = "doc_id long, text string, shard string"


def test_differencing_keeps_bins_apart_and_beats_greedy():
    rng = np.random.default_rng(1)
    for k in (2, 4, 16):
        sizes = rng.integers(1, 10 ** 6, 400)
        sums = np.zeros((400, k), np.int64)
        sums[:, 0] = sizes
        to = shards.differencing(sums)
        assert all(sorted(row) == list(range(k)) for row in to)
        total = np.bincount(to[:, 0], sizes, k)
        greedy = np.zeros(k)
        for s in sorted(sizes, reverse=True):
            greedy[np.argmin(greedy)] += s
        assert np.ptp(total) <= np.ptp(greedy)


def test_two_bins_give_the_known_difference():
    sums = np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])
    total = np.bincount(shards.differencing(sums)[:, 0], sums[:, 0], 2)
    assert sorted(total) == [14, 16]


def test_groups_stay_whole_over_levels_of_buckets(spark):
    rng = random.Random(3)
    texts = ["x" * rng.randrange(1, 400) + str(rng.randrange(200)) for _ in range(900)]
    texts += ["hot"] * 450 + [None] * 5 + [""] * 3
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x")]
    got = shards.shard(spark.createDataFrame(rows, SCHEMA), 4, bucket_groups=40, fan_in=3,
                       slice_rows=50).collect()
    assert len(got) == len(rows)
    homes, sums = {}, [0] * 4
    for r in got:
        sums[r.shard] += r.size
        assert homes.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert max(sums) - min(sums) <= 0.02 * sum(sums) / 4
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(
            sum(r.shard == s for r in got)))
    assert sum(r.size for r in got) == sum(len(t or "") + 1 for _, t, _ in rows)


def test_one_very_long_text_and_an_empty_table(spark):
    rows = [(1, "y" * 2_000_000, "x"), (2, "a", "x"), (3, "b", "x")]
    got = {r.doc_id: r.shard for r in shards.shard(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got[2] == got[3] != got[1]
    assert shards.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_differencing_against_every_split():
    """Up to 11 groups in two bins: never better than the best, and mostly close to it."""
    rng = np.random.default_rng(8)
    exact = 0
    for _ in range(80):
        sizes = rng.integers(1, 1000, rng.integers(2, 12))
        signs = 2 * (np.arange(1 << len(sizes))[:, None] >> np.arange(len(sizes)) & 1) - 1
        best = int(np.abs(signs @ sizes).min())
        sums = np.stack([sizes, np.zeros_like(sizes)], axis=1)
        got = int(np.ptp(np.bincount(shards.differencing(sums)[:, 0], sizes, 2)))
        assert best <= got <= best + int(sizes.max())
        exact += got <= best + 0.05 * sizes.sum()
    assert exact >= 70
