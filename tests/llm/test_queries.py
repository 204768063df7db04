"""Queries with SQL against DuckDB, and what must hold of all of them, over whole tables."""

import zlib

import duckdb
import pytest

import __spark_entry__ as driver
from townhall_spark.llm.queries import QUERIES
from townhall_spark.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(round(r[i], 12) if isinstance(r[i], float) else r[i] for i in order)
                  for r in records)


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(columns, result.fetchall()) and got


def test_all_thirteen_and_the_pipeline_are_registered():
    names = set(driver.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names}
    assert "pipeline" in names


def test_sharding_is_whole_balanced_and_gapless(spark, duck):
    got = QUERIES["op7_sharding"](spark, SF).toPandas()
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    assert sorted(got.doc_id) == sorted(texts)
    assert all(s == len(texts[d].encode()) + 1 for d, s in zip(got.doc_id, got["size"], strict=True))
    assert all(c == zlib.crc32(texts[d].encode())
               for d, c in zip(got.doc_id, got.text_crc32, strict=True))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() - sums.min() < 0.01 * sums.mean()
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    homes = {}
    for d, s in zip(got.doc_id, got.shard, strict=True):
        assert homes.setdefault(texts[d], s) == s


def test_languages_of_held_out_documents(spark, duck):
    got = QUERIES["op5_language_id"](spark, SF).toPandas()
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    out = got[got.held_out]
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1)
               for d, h in zip(got.doc_id, got.held_out, strict=True))
    right = [p == lang[d] for d, p in zip(out.doc_id, out.lang_pred, strict=True)]
    assert len(got) == len(lang) and sum(right) >= 0.95 * len(right)
    assert got.score.between(0, 1).all()


def test_every_page_has_a_text(spark, duck):
    got = QUERIES["op9_html_extraction"](spark, SF).toPandas()
    assert sorted(got.page_id) == sorted(
        r[0] for r in duck.execute("SELECT page_id FROM pages").fetchall())
    assert not got.text.str.contains("<script|track\\(|margin:0").any()
