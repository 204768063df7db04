"""The queries of this subpackage, each an operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townhall_spark.llm import (
    chat,
    decontam,
    divergence,
    html_text,
    langid,
    licenses,
    ngram_join,
    packing,
    periodic,
    popcount_join,
    secrets,
    shards,
    vptree,
)
from townhall_spark.llm.common import table, text_or_empty

# Pruning as the triangle inequality allows: exact.
FACTOR = 1.0
# A conversation whose texts are control strings.
CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"),
                 (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted text of each conversation says when it is read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(CONTROL_TURNS, turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(added)))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's component under 85 % overlap of 4-word shingles."""
    found = ngram_join.join(table(spark, sf_dir, "documents"), 4, 85)
    real = [F.when(F.col(c) < ngram_join.NO_ID, F.col(c)).alias(name)
            for c, name in (("id", "doc_id"), ("component", "component_id"))]
    return found.select(real[0], F.col("n").alias("n_shingles"), real[1])


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.search(vectors, vectors.where("vec_id % 100 = 0"), 10, FACTOR)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that each document holds and where."""
    places = F.transform("matches", lambda m: F.concat_ws(
        ":", m["license"], m["start_word"].cast("string"), m["end_word"].cast("string")))
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0))
        .alias("coverage"), F.array_join(places, ",").alias("places"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("row.doc_id", langid.held_out("row.doc_id").alias("held_out"),
                        "lang_pred", "score", "rejected")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with its best window."""
    found = decontam.flagged(table(spark, sf_dir, "documents").select("doc_id", "text"),
                             table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of almost equal bytes, equal texts together."""
    placed = shards.shard(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document and how many of them are examples or live."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source against the others of its language, and the terms it has more of."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten, by the CRC-32 of its id, repeats a part of itself."""
    held = docs.select("doc_id", text_or_empty().alias("text"),
                       F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = held.withColumn("w", F.when(F.expr("h % 10 = 0"), F.regexp_extract_all(
        "text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n = words.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
    start = n.withColumn("a", F.when(F.col("n") > 0, F.expr("g % greatest(n, 1)")))
    period = start.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("""array_join(transform(sequence(0, n - 1), i ->
        w[CAST(IF(i < a, i, a + (i - a) % p) AS INT)]), ' ')""")
    return period.select("doc_id", F.when(F.col("a").isNotNull(), planted)
                         .otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document and its text without their repetitions."""
    found = periodic.collapse(with_planted_runs(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    # Runs come by start and period, so of equal exponents the first stays.
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(
        r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.concat_ws("", F.transform(line, lambda t: F.concat(t, F.lit("\n")))), 256)
        .alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256",
        "collapsed_sha256")


def op13_popcount_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and its component under 4 differing bits."""
    found = popcount_join.join(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"),
                        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_license_scans": op4_license_scans,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_secret_scans": op8_secret_scans,
    "op9_html_extraction": op9_html_extraction,
    "op10_packing": op10_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_popcount_join": op13_popcount_join,
}
