import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from townhall_spark.llm import periodic
from townhall_spark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, runs string, collapsed int, row string"


def brute(words, least=24, periods=3):
    """Every period against every stretch of words that are that far apart and equal."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, periods * q) and (i, length) not in seen:
                seen.add((i, length))
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


pieces = st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=7), st.integers(1, 9)),
                  max_size=6)


@settings(max_examples=400, deadline=None)
@given(pieces, st.sampled_from([(24, 3), (6, 3), (1, 2), (4, 4)]))
def test_runs_against_brute_force(parts, limits):
    words = [w for unit, times in parts for w in unit * times]
    assert periodic.runs(words, *limits) == brute(words, *limits)


@pytest.mark.parametrize("alphabet", [2, 5, 400])
def test_long_texts_with_long_periods(alphabet):
    rng = random.Random(alphabet)
    word = lambda: f"w{rng.randrange(alphabet)}"
    words = [word() for _ in range(150)]
    for period in (1, 7, 40, 90):
        unit = [word() for _ in range(period)]
        words += unit * 4 + unit[:period // 2] + [word() for _ in range(100)]
    assert periodic.runs(words) == brute(words)
    assert len(periodic.runs(words)) >= 3


def test_cutting_at_rare_words_changes_nothing(monkeypatch):
    rng = random.Random(8)
    words = [f"w{rng.randrange(60)}" for _ in range(300)] + ["x", "y", "z"] * 12 + ["q"]
    whole = periodic.runs(words)
    monkeypatch.setattr(periodic, "CUTS", 0)
    assert periodic.runs(words) == whole == [(300, 36, 3)]


def test_last_occurrences_against_a_scan():
    rng = random.Random(2)
    words = rng.choices("aab", k=80)
    length, link, prefixes = periodic.automaton(words)
    paths = periodic.LastOccurrences(link)
    for end, state in enumerate(prefixes):
        got = {(old, length[x]) for old, x in paths.access(state, end) if length[x]}
        want = {}
        for n in range(1, end + 1):
            ends = [e for e in range(n - 1, end)
                    if words[e - n + 1:e + 1] == words[end - n + 1:end + 1]]
            if ends:
                want[ends[-1]] = n
        assert got == set(want.items())


def test_rows_of_every_kind(spark):
    unit = "one two three"
    rows = [(1, None, "r", 1, "x"), (2, "", "r", 1, "x"), (3, " \t\n", "r", 1, "x"),
            (4, f"a  b {' '.join([unit] * 8)} c", "r", 1, "x"), (4, f"{unit} end", None, None, None),
            (None, "ja " * 100_000, "r", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.row.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed)
                  for r in periodic.collapse(df).collect()), key=repr)
    assert got == sorted([
        (1, [], ""), (2, [], ""), (3, [], ""), (4, [(2, 24, 3)], "a b one two three c"),
        (4, [], f"{unit} end"), (0, [(0, 100_000, 1)], "ja")], key=repr)
    assert periodic.collapse(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["a", "b", f"w{i}", "c"], k=rng.randrange(120))))
            for i in range(300)] + [(900, None), (901, ""), (None, "a " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    planted = 0
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    for doc_id, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = brute(words)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 10 and sum(r.n_runs > 0 for r in got.values()) > 10
