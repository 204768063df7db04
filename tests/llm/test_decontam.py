import random
from collections import Counter

import numpy as np

from townhall_spark.llm import decontam
from townhall_spark.llm.common import WordHashes, combined
from townhall_spark.llm.words import words

SCHEMA = "doc_id long, text string, matches string"
ITEMS = "item_id long, text string"


def brute(items, text, least):
    """Items by the share of every window, without fingerprints."""
    seen, out = WordHashes(), {}
    hashes = seen.of(words(text))
    for item in items.items:
        width, best = item.width, 0.0
        all_ = combined(hashes, width).tolist()
        for start in range(max(1, len(hashes) - item.length + 1)):
            shared = Counter(all_[start:start + item.length - width + 1]) & item.shingles
            best = max(best, sum(items.weight[s] * c for s, c in shared.items()) / item.total)
        if best >= least - 1e-12:
            out[item.item_id] = best
    return out


def edited(rng, rows, word, trials):
    """Texts that hold items with a few words changed, put in or left out."""
    for _ in range(trials):
        text = [word() for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            part = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(3)):
                at, kind = rng.randrange(len(part)), rng.random()
                part[at:at + (kind < 0.8)] = [word()] * (kind < 0.5 or kind > 0.8)
                part = part or [word()]
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        yield " ".join(text)


def test_planted_and_edited_items_against_brute_force():
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(300)}"
    rows = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 16, 20, 33, 50, 120]))))
            for i in range(40)]
    index, seen = decontam.Index(rows), WordHashes()
    texts = list(edited(rng, rows, word, 700))
    wanted = hit = 0
    found = index.matches([seen.of(words(t)) for t in texts], decontam.LEAST)
    for text, got in zip(texts, found, strict=True):
        got = {m["item_id"]: m["similarity"] for m in got}
        want = brute(index, text, decontam.LEAST)
        # Nothing that is no match, and the best window of nearly all that are.
        assert all(got[k] <= want[k] + 1e-9 for k in got)
        wanted += len(want)
        hit += sum(abs(got.get(k, 0) - want[k]) < 1e-9 for k in want)
    assert wanted > 300 and hit >= 0.99 * wanted


def test_edits_down_to_the_threshold_in_given_texts_and_items(spark):
    """Given items in given texts, edited to shares from 0.8 to 0.95."""
    folder = "/root/testdata/sf0.001"
    read = lambda name: [r.text for r in
                         spark.read.parquet(f"{folder}/{name}.parquet").select("text").collect()]
    rng, seen = random.Random(5), WordHashes()
    pool = [w for w in map(words, read("documents")) if len(w) > 120]
    rows = list(enumerate(read("benchmark")))
    index = decontam.Index(rows)
    by_id = {i.item_id: i for i in index.items}
    cases = []
    for _ in range(1500):
        n, item = rng.choice(rows)
        part = words(item)
        for _ in range(rng.randrange(1, 4)):
            at, kind, new = rng.randrange(len(part)), rng.random(), rng.choice(rng.choice(pool))
            part[at:at + (kind < 0.8)] = [new] * (kind < 0.5 or kind > 0.8)
        around = rng.choice(pool)
        at = rng.randrange(len(around))
        cases.append((n, seen.of(around[:at] + part + around[at:])))
    found = index.matches([h for _, h in cases], decontam.LEAST)
    wanted = hit = 0
    for (n, hashes), got in zip(cases, found, strict=True):
        best = index._best(by_id[n], hashes, 0, len(hashes), decontam.LEAST)
        if best and best["similarity"] < 0.95:
            wanted += 1
            hit += any(m == best for m in got)
    assert wanted > 300 and hit >= 0.99 * wanted


def test_tables_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    asked = prints[rng.integers(0, 60, 400)].copy()
    for k in range(len(asked)):
        for b in rng.choice(64, rng.integers(0, 22), replace=False):
            asked[k] ^= np.uint64(1) << np.uint64(b)
    table = decontam.Table(list(range(60)), prints, 12)
    got = {(p, m) for place, member in table.look_up(asked)
           for p, m in zip(place.tolist(), member.tolist(), strict=True)}
    want = {(i, j) for i, a in enumerate(asked.tolist()) for j, b in enumerate(prints.tolist())
            if (a ^ b).bit_count() <= decontam.RADIUS}
    assert got == want and len(want) > 200


def test_only_the_tables_give_candidates(monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(30))) for i in range(20)]
    index, seen = decontam.Index(rows), WordHashes()
    documents = [seen.of(words(f"some words before {t} and after")) for _, t in rows]
    asked = []
    look_up = decontam.Table.look_up
    monkeypatch.setattr(decontam.Table, "look_up",
                        lambda self, prints: asked.append(len(prints)) or look_up(self, prints))
    assert [[m["item_id"] for m in f] for f in index.matches(documents, 0.8)] == [
        [i] for i, _ in rows]
    # Every window that starts at a step is looked up.
    step = 30 // decontam.STARTS
    assert sum(asked) >= sum(len(d) - 30 for d in documents) / step
    for table in index.tables:
        table.blocks = [(some & False, bounds, listed) for some, bounds, listed in table.blocks]
    assert index.matches(documents, 0.8) == [[]] * 20


def test_long_documents_are_cut_without_a_seam(monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(f"i{rng.randrange(500)}" for _ in range(n))) for i, n in
            enumerate((6, 25, 60))]
    index, seen = decontam.Index(rows), WordHashes()
    texts = [" ".join([f"x{k}" for k in range(at)] + [t for _, t in rows] + ["end"] * 9)
             for at in range(0, 130, 7)]
    documents = [seen.of(words(t)) for t in texts]
    whole = index.matches(documents, 0.8)
    assert all([m["item_id"] for m in f] == [0, 1, 2] for f in whole)
    monkeypatch.setattr(decontam, "STREAM", 50)
    assert index.matches(documents, 0.8) == whole


def test_running_sums():
    rng = np.random.default_rng(1)
    for n in (1, 2, 15, 16, 17, 40, 1000):
        rows = rng.integers(0, 256, (n, 64), dtype=np.uint8)
        want = np.cumsum(rows, axis=0, dtype=np.uint8)
        decontam._add_up(rows)
        assert (rows == want).all()


def test_a_document_shorter_than_the_item():
    rng = random.Random(9)
    item = [f"i{rng.randrange(500)}" for _ in range(50)]
    index, seen = decontam.Index([(1, " ".join(item))]), WordHashes()
    got = index.matches([seen.of(words(" ".join(part))) for part in (
        item[:44], item[3:], item[:20])] + [seen.of(words("other words " * 30))], 0.8)
    assert [len(g) for g in got] == [1, 1, 0, 0] and got[0][0]["n_words"] == 44


def test_case_punctuation_nulls_repeats_and_clashing_columns(spark):
    passage = "Which of the following best describes the role of the county board in a flood"
    schema = SCHEMA + ", row int, _matches int, item_id int"
    rows = [(1, f"before {passage.upper()}, after", "x"), (2, passage.replace(" ", "  -- "), "x"),
            (3, passage[:30], "x"), (4, None, "x"), (5, "", "x"), (1, f"before {passage} after", "x"),
            (6, "pad " * 60000 + passage, "x")]
    rows = [(*r, 1, 2, 3) for r in rows]
    items = spark.createDataFrame([(10, passage), (11, None), (12, "  "), (None, passage), (13, passage)],
                                  ITEMS)
    found = decontam.flagged(spark.createDataFrame(rows, schema), items).collect()
    assert sorted((r.row.doc_id, tuple(m.item_id for m in r.matches)) for r in found) == [
        (1, (10, 13)), (1, (10, 13)), (2, (10, 13)), (3, ()), (4, ()), (5, ()), (6, (10, 13))]
    kept = decontam.clean(spark.createDataFrame(rows, schema), items)
    assert kept.columns == ["doc_id", "text", "matches", "row", "_matches", "item_id"]
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_items_in_several_blocks_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h", "x"), (2, "i j k l m n o p", "x")], SCHEMA)
    items = spark.createDataFrame([(1, "a b c d e f"), (2, "i j k l m n"), (3, "c d e f g h")], ITEMS)
    monkeypatch.setattr(decontam, "ITEM_BYTES", 8)
    got = {r.row.doc_id: sorted(m.item_id for m in r.matches)
           for r in decontam.flagged(docs, items).collect()}
    assert got == {1: [1, 3], 2: [2]}
    # Weights are those of all items, however many indexes there are.
    apart = list(decontam._indexes(items, "item_id", "text"))
    monkeypatch.undo()
    together, = decontam._indexes(items, "item_id", "text")
    assert len(apart) > 1 and together.weight == decontam.Index(
        [(r.item_id, r.text) for r in items.collect()]).weight
    totals = {i.item_id: i.total for x in apart for i in x.items}
    assert totals == {i.item_id: i.total for i in together.items}
    none = spark.createDataFrame([], ITEMS)
    assert decontam.clean(docs, none).count() == 2
    assert decontam.flagged(spark.createDataFrame([], SCHEMA), items).count() == 0
