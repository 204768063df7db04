import hashlib
import re

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from townhall_spark.llm import secrets
from townhall_spark.llm.queries import QUERIES
from townhall_spark.llm.sql import ORACLES

SCHEMA = "doc_id long, text string, source string, found string"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    """Spans as the patterns say, with Python's own engine."""
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text)
              if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text)
              if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def without_judged(spans):
    return ",".join(s for s in spans.split(",") if s.split(":")[0] not in secrets.JUDGED)


def spans(spark, rows):
    df = spark.createDataFrame([(i, t, s, "x") for i, (t, s) in enumerate(rows)], SCHEMA)
    return {r.doc_id: r for r in secrets.digest(secrets.scan(df)).collect()}


PIECES = st.sampled_from(["password", "TOKEN", "api_key", "apikey", "secret", '"', "'", " ", "=", ":",
                          "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "😀", "\n", "x/+-",
                          "K", "ſ"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=60, max_size=60))
def test_spans_against_the_patterns(spark, texts):
    got = spans(spark, [(t, "s") for t in texts])
    assert {i: without_judged(got[i].spans) for i in got} == {
        i: base(t) for i, t in enumerate(texts)}
    assert all(got[i].base_sha256 == hashlib.sha256(base(t).encode()).hexdigest()
               for i, t in enumerate(texts))


def test_a_dropped_match_still_covers_its_text(spark):
    assert spans(spark, [("secret=token: abcdefgh", "s")])[0].spans == ""


def test_examples_and_live_credentials(spark):
    example, live, dull = "token = EXAMPLEkey123456", "token = q8Zr51LmXw02", "password = aaaaaaaa"
    rows = [(example, f"s{i}") for i in range(3)] + [(live, "s0"), (live, "s0"), (dull, "s1"),
                                                      (f"{example} {live}", None), (None, "s"), ("", "s")]
    got = spans(spark, rows)
    assert [(got[i].n_example, got[i].n_live) for i in range(9)] == [
        (1, 0), (1, 0), (1, 0), (0, 1), (0, 1), (0, 0), (1, 1), (0, 0), (0, 0)]
    df = spark.createDataFrame([(i, t, s, "x") for i, (t, s) in enumerate(rows)], SCHEMA)
    kept = secrets.without_live(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 5, 7, 8]


def test_one_owner_is_live_at_any_number_of_documents(spark):
    own, shared = "token = q8Zr51LmXw02", "token = EXAMPLEkey123456"
    rows = [(f"{own} {i}", "hot") for i in range(25)]
    rows += [(f"{shared} {i}", f"s{i % 2}") for i in range(secrets.EXAMPLE_REPOSITORIES)]
    got = spans(spark, rows)
    assert {(got[i].n_example, got[i].n_live) for i in range(25)} == {(0, 1)}
    assert {(got[i].n_example, got[i].n_live) for i in range(25, len(rows))} == {(1, 0)}
    df = spark.createDataFrame([(i, t, s, "x") for i, (t, s) in enumerate(rows)], SCHEMA)
    assert sorted(r.doc_id for r in secrets.without_live(df).collect()) == list(range(25, len(rows)))


def test_repeated_rows_null_ids_long_texts_and_no_rows(spark):
    long = "pad " * 100000 + "secret: 0a1b2c3d4e5f"
    rows = [(None, long, "a", "x"), (None, long, "a", "x"), (5, long, "a", "x")]
    got = secrets.digest(secrets.scan(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r.spans, r.n_live) for r in got] == [
        ("assign:400000:400020,live:400000:400020", 1)] * 3
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert secrets.without_live(spark.createDataFrame([], SCHEMA)).count() == 0


def test_judged_spans_stand_behind_their_candidates(spark):
    example, live = "token = EXAMPLEkey123456", "token = q8Zr51LmXw02"
    got = spans(spark, [(f"{example} {live}", "s0"), (example, "s1"), (example, "s2")])
    assert got[0].spans == "assign:0:24,example:0:24,assign:25:45,live:25:45"
    assert got[1].spans == "assign:0:24,example:0:24"


def test_limits_are_parameters(spark):
    rows = [(i, "token = EXAMPLEkey123456", f"s{i}", "x") for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.n_example for r in secrets.scan(df).collect()} == {1}
    assert {r.n_live for r in secrets.scan(df, example_owners=5).collect()} == {1}
    assert {r.n_example for r in secrets.scan(df, example_owners=9, example_repositories=4)
            .collect()} == {1}


def test_clean_rows_stay_whatever_columns_are_called(spark):
    live = "token = q8Zr51LmXw02"
    rows = [(1, live, "s", 1, 2, 3), (1, "clean", "s", 1, 2, 3), (None, "clean", "s", 1, 2, 3),
            (None, live, "s", 1, 2, 3), (2, None, "s", 1, 2, 3), (3, "clean", "s", 1, 2, 3)]
    names = "doc_id long, text string, source string, _live int, _key int, judged int"
    kept = secrets.without_live(spark.createDataFrame(rows, names))
    assert kept.columns == [c.split()[0] for c in names.split(", ")]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, [
        (1, "clean"), (None, "clean"), (2, None), (3, "clean")]))


def test_sql_says_the_same_where_owners_decide(spark, tmp_path):
    """Values of one, two and three owners, in few and in many documents."""
    rows = []
    for value, owners, docs in (("q8Zr51LmXw02", 1, 25), ("w9Zr51LmXw03", 2, 25),
                                ("e7Zr51LmXw04", 2, 5), ("r6Zr51LmXw05", 3, 3),
                                ("aaaaaaaa", 1, 2), ("bbbbbbbb", 4, 4)):
        rows += [(len(rows) + i, f"{i} secret: {value} and api_key='{value}'", f"o{i % owners}", "x")
                 for i in range(docs)]
    rows += [(None, None, None, "x"), (None, "password=zZ91kK82jJ", None, "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = duck.execute(ORACLES["op8_secret_scans"])
    columns = [c[0] for c in result.description]
    got = QUERIES["op8_secret_scans"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, result.fetchall()))
    assert {r.n_live for r in got if r.doc_id is not None and r.doc_id < 25} == {1}
