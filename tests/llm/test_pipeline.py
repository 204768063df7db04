"""Each stage against brute force over what the stage before kept."""

import random

import corpus_pipeline
from test_ngram_join import brute
from townhall_spark.llm.words import words


def test_stages_are_those_asked_for_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]


def corpus(folder, spark):
    rng = random.Random(9)
    word = lambda: rng.choice("river board flood county meeting budget street water plan vote".split()) \
        + str(rng.randrange(40))
    item = " ".join(f"bench{i}" for i in range(20))
    rows = []
    for i in range(80):
        text = [word() for _ in range(40)]
        if i % 10 == 3:
            text = rows[-1][1].split()[:-1] + ["changed"]
        if i % 10 == 5:
            text[5:5] = item.split()
        if i % 10 == 7:
            text[8:8] = ["token", "=", f"q8Zr{i}LmXw02"]
        rows.append((i, " ".join(text) if i % 10 != 9 else "12 34 !", "en", "s0", 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return rows, item


def test_decisions_take_effect_and_clean_documents_stay(spark, tmp_path):
    rows, item = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [r for r in rows if any(c.isalpha() for c in r[1])]
    seen = []
    labels = brute([(r[0], r[1]) for r in want], 5, 80)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        seen.append(sorted(r.doc_id for r in docs.collect()))
    assert seen[0] == [r[0] for r in want]
    want = [r for r in want if labels[r[0]][1] == r[0]]
    assert seen[1] == [r[0] for r in want]
    want = [r for r in want if b" ".join(words(item)) not in b" ".join(words(r[1]))]
    assert seen[2] == [r[0] for r in want]
    want = [r for r in want if "token" not in r[1]]
    assert seen[3] == [r[0] for r in want]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({p.doc_id for p in packed}) == seen[3]
