import random

import numpy as np
import pytest
import xxhash
from test_ngram_join import corpus
from townhall_spark.llm import popcount_join
from townhall_spark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, print long, component string"


def print_of(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    own = [xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), seed=42)
           for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


def brute(rows, radius=4):
    """doc_id -> (fingerprint, smallest id reachable)."""
    prints = {d: print_of(t) for d, t in rows}
    label = {d: d for d in prints}
    links = [(a, b) for a in prints for b in prints
             if a < b and (prints[a] ^ prints[b]).bit_count() <= radius]
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {d: (prints[d], label[d]) for d in prints}


def found(df, radius=4):
    return {r.id: (r.print % (1 << 64), r.component)
            for r in popcount_join.join(df, radius=radius).collect()}


@pytest.mark.parametrize(("seed", "radius"), [(1, 4), (2, 4), (3, 2)])
def test_against_brute_force(spark, seed, radius):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \t ")]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], SCHEMA).repartition(4)
    assert found(df, radius) == brute(rows, radius)


def test_fingerprints_are_those_of_spark_s_own_hash(spark):
    text = "Über Wasser AND water over the board, again AND water over the board"
    row = spark.createDataFrame([(text.encode().lower().decode(),)], "t string").selectExpr(
        "split(t, ' ') AS w").selectExpr("transform(sequence(0, size(w) - 4), "
                                         "i -> xxhash64(concat_ws(' ', slice(w, i + 1, 4)))) AS h"
                                         ).first()
    bits = [sum(h % (1 << 64) >> b & 1 for h in row.h) for b in range(64)]
    assert popcount_join.fingerprint(text) == sum(
        1 << b for b in range(64) if 2 * bits[b] > len(row.h))


def groups(seed, n=400):
    """Fingerprints in dense groups, chains and alone."""
    rng = random.Random(seed)
    out = [0, (1 << 64) - 1]
    for _ in range(n):
        base = rng.choice(out) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(6)):
            base ^= 1 << rng.randrange(64)
        out.append(base)
    return np.unique(np.array(out, np.uint64))


def connected(prints, pairs):
    label = {int(p): int(p) for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in pairs:
        a, b = sorted((root(int(a)), root(int(b))))
        label[b] = a
    return {x: root(x) for x in label}


@pytest.mark.parametrize("small", [2, 8, 100])
def test_cells_lose_no_link(monkeypatch, small):
    monkeypatch.setattr(popcount_join, "SMALL_CELL", small)
    prints = groups(small)
    cell, place = popcount_join.cells(prints, True)
    order = np.argsort(cell, kind="stable")
    got = [p for a, b in popcount_join.links(cell[order], prints[place[order]], 4)
           for p in zip(a, b, strict=True)]
    near = [(a, b) for i, a in enumerate(prints) for b in prints[:i]
            if (int(a) ^ int(b)).bit_count() <= 4]
    assert connected(prints, got) == connected(prints, near)


def test_embedding_is_a_lower_bound():
    prints = groups(5)
    counts = popcount_join.embedding(prints).astype(int)
    i, j = np.triu_indices(len(prints), 1)
    assert (np.abs(counts[i] - counts[j]).sum(axis=1)
            <= np.bitwise_count(prints[i] ^ prints[j])).all()


def test_large_cells_in_slices_lose_no_link(spark, monkeypatch):
    prints = groups(6, 800)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    monkeypatch.setattr(popcount_join, "LARGE_CELL", 20)
    large = popcount_join._slices(df)
    assert large.count() > 0
    # Slices are of cells that have more members than a task takes, all of them.
    cell, _ = popcount_join.cells(prints, True)
    members = dict(zip(*np.unique(cell, return_counts=True), strict=True))
    sliced = {r.cell: r.slices for r in large.collect()}
    assert all(sliced.get(c, 1) * 20 >= n for c, n in members.items())
    met = popcount_join._meetings(df).repartition(4, "cell").sortWithinPartitions("cell")
    got = [tuple(np.array(r, np.int64).view(np.uint64)) for r in met.mapInArrow(
        popcount_join._link(4), "a long, b long").collect()]
    near = [(a, b) for i, a in enumerate(prints) for b in prints[:i]
            if (int(a) ^ int(b)).bit_count() <= 4]
    assert connected(prints, got) == connected(prints, near)


def test_a_cell_may_span_batches():
    import pyarrow as pa
    prints = groups(7, 100)
    cell = np.sort(np.random.default_rng(1).integers(0, 6, len(prints)))
    whole = [p for a, b in popcount_join.links(cell, prints, 4) for p in zip(a, b, strict=True)]
    for size in (1, 3, 50):
        parts = [pa.RecordBatch.from_arrays(
            [pa.array(cell[i:i + size]), pa.array(prints[i:i + size].view(np.int64))],
            ["cell", "print"]) for i in range(0, len(cell), size)]
        got = [r for b in popcount_join._link(4)(iter(parts)) for r in zip(
            *(c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns), strict=True)]
        assert connected(prints, got) == connected(prints, whole)


def test_rows_without_id_repeated_rows_and_one_very_long_text(spark):
    long = "flood plan vote board " * 200_000
    rows = [(5, long), (3, long + "x"), (3, long), (None, "only here"), (None, long), (7, "other")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    got = sorted(((r.id or 0, r.component) for r in popcount_join.join(df).collect()), key=repr)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (0, None), (0, 3), (7, 7)], key=repr)
    assert popcount_join.join(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        popcount_join.join(df, radius=5)


def test_query_over_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet")
            .select("doc_id", "text").collect()]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id)
           for r in QUERIES["op13_popcount_join"](spark, folder).collect()}
    assert got == brute(rows)
