import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from townhall_spark.llm import packing

OWN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
FAST = packing.Encoder()
SCHEMA = "doc_id long, text string, length string"


def ids_of(text):
    return [*OWN.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(
    ["<|endoftext|>", "<|endof", " ", "\n\n", "'s", "abc", "123", "é", " ", "😀"])).map("".join))
def test_ids_are_those_of_the_tokenizer_file(text):
    assert FAST(text).tolist() == OWN.encode(text, add_special_tokens=False).ids


def test_texts_that_the_fast_reader_gives_up_on():
    text = "a" + " " * 1_500_000 + "b"
    assert FAST(text).tolist() == OWN.encode(text, add_special_tokens=False).ids
    assert FAST.own is not None


def test_capacities_hold_exactly_the_tokens():
    for n in (0, 1, 1023, 1024, 1025, 99999):
        room = packing.capacities(n)
        assert sum(room) == n and all(c == 1024 or c & (c - 1) == 0 for c in room)


@given(st.lists(st.integers(1, 3000), min_size=1, max_size=60))
def test_pieces_fill_sequences_and_cover_documents(lengths):
    pieces = packing.pack(np.array(lengths))
    docs, rows = defaultdict(list), defaultdict(list)
    for d, start, n, s, at in pieces:
        docs[d].append((start, n))
        rows[s].append((at, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, length in sorted(docs[d]):
            assert start == at and length > 0
            at += length
        assert at == n
    for s, room in enumerate(packing.capacities(sum(lengths))):
        at = 0
        for start, length in sorted(rows[s]):
            assert start == at
            at += length
        assert at == room


def test_cost_is_balanced():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 400, 2000)
    cost = defaultdict(float)
    for _, _, n, s, _ in packing.pack(lengths):
        cost[s] += n + packing.QUADRATIC * n * n
    full = np.array([cost[s] for s in range(int(lengths.sum()) // 1024)])
    assert full.std() < 0.1 * full.mean()


def test_nulls_repeats_long_texts_and_no_rows(spark):
    long = "some words and 12345 more. " * 20000
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, None, "x"), (2, "", "x"), (3, long, "x"),
            (4, "<|endoftext|>x", "x")]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).coalesce(1),
                                 group_tokens=5000).collect()
    tokens = {1: ids_of("a b c"), None: [0], 2: [0], 3: ids_of(long), 4: ids_of("<|endoftext|>x")}
    for r in got:
        own = tokens[r.doc_id]
        part = np.array(own[r.start:r.start + r.length], "<u4")
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(part.tobytes())
    by = defaultdict(int)
    for r in got:
        by[r.doc_id] += r.length
    assert by == {k: len(v) * (2 if k == 1 else 1) for k, v in tokens.items()}
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pieces_against_a_plain_packing():
    """Descending documents, each to the sequence of lowest cost that has room for it."""
    rng = np.random.default_rng(3)
    for trial in range(60):
        most = int(rng.choice([16, 64]))
        lengths = rng.integers(1, 2 * most, rng.integers(1, 40))
        sequences = [[size, 0.0, 0] for size in packing.capacities(int(lengths.sum()), most)]
        want, whole, parts = [], 0, []
        for doc, n in enumerate(lengths.tolist()):
            for start in range(0, n - n % most, most):
                want.append((doc, start, most, whole, 0))
                sequences[whole][2] = most
                whole += 1
            if n % most:
                parts.append((n % most, doc, n - n % most))
        for n, doc, start in sorted(parts, key=lambda p: (-p[0], p[1])):
            while n:
                free = [(s, at) for at, s in enumerate(sequences) if at >= whole]
                fits = [f for f in free if f[0][0] - f[0][2] >= n] or [
                    f for f in free if f[0][0] > f[0][2]]
                s, at = min(fits, key=lambda f: f[0][1])
                take = min(n, s[0] - s[2])
                want.append((doc, start, take, at, s[2]))
                s[1] += take + packing.QUADRATIC * take * take
                s[2] += take
                start, n = start + take, n - take
        assert packing.pack(lengths, most) == want, trial
        assert all(s[2] == s[0] for s in sequences)
