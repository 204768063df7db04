"""Every query by name: the Spark plan and, beside it, the same query as SQL.

All queries run over whole tables and whole texts. A limit appears only where it
is the feature (bounded and seeded samples, label candidates).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from importlib.util import find_spec
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townhall_spark.functions import domains, fields, lexicon
from townhall_spark.functions.ids import canonical_id
from townhall_spark.operators import (
    evaluation,
    exposure,
    extraction,
    jurisdictions,
    labelling,
    linking,
    responses,
    sampling,
    segments,
    summaries,
)
from townhall_spark.plans import fixtures as fx
from townhall_spark.plans import oracles as sql
from townhall_spark.schemas import (
    ACTION,
    ACTION_CATEGORIES,
    CANONICAL_MEETING,
    GOLDEN,
    PLACE_TO_COUNTY,
)
from townhall_spark.sources import readers, sinks, specs

Plan = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    plan: Plan
    oracle: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, needs: tuple[str, ...] = (), select: str | None = None):
    """Registers a plan under ``name`` with its SQL."""
    def register(plan: Plan) -> Plan:
        CATALOG[name] = Query(plan, None if select is None else sql.with_ctes(needs, select))
        return plan
    return register


def _meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.meetings(fx.canonical(spark, sf_dir))


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_actions(fx.canonical(spark, sf_dir), fx.TEST_LEXICON,
                                      fx.TEST_VERSION, stamped=False)


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _meetings(spark, sf_dir), _actions(spark, sf_dir)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.meeting_counts(*_both(spark, sf_dir))


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [table.groupBy().agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("name"), "n") for name, table in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- scans -------------------------------------------------------------------

@query("scan_project", (), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_project(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("yearly_union", (), """
    SELECT o_orderkey, o_totalprice, year(o_orderdate) AS year FROM orders
    WHERE year(o_orderdate) BETWEEN 1993 AND 1996""")
def yearly_union(spark, sf_dir):
    """Requested years 1990 to 1996, of which 1993 onwards are known: a frame for each
    known year, of which the requested ones are read and joined."""
    day = F.col("o_orderdate")
    orders = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", day, F.year(day).alias("year"))

    def of(year: int) -> DataFrame:
        return orders.where((day >= F.lit(f"{year}-01-01").cast("timestamp_ntz"))
                            & (day < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))

    return readers.union_years({y: of(y) for y in range(1993, 1999)},
                               range(1990, 1997)).drop("o_orderdate")


@query("bounded_scan", (), "SELECT doc_id, source, text FROM documents ORDER BY doc_id LIMIT 200")
def bounded_scan(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return sampling.bounded(docs, sampling.SAMPLE_SIZE, "doc_id")


@query("slim_project", (), """
    SELECT CASE WHEN length(k) < 5 THEN lpad(k, 5, '0') ELSE k END AS STCOFIPS,
      c_mktsegment AS STATEABBRV, c_name AS COUNTY, CAST(c_nationkey AS VARCHAR) AS POPULATION,
      b AS RISK_SCORE, b AS IFLD_RISKS, b AS CFLD_RISKS, b AS WFIR_RISKS, b AS HWAV_RISKS,
      b AS DRGT_RISKS, b AS HRCN_RISKS
    FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS k, CAST(c_acctbal AS VARCHAR) AS b
          FROM customer)""")
def slim_project(spark, sf_dir):
    return exposure.slim_counties(fx.wide_counties(spark, sf_dir))


@query("places_last_entry", (), """
    SELECT CAST(c_nationkey AS VARCHAR) AS place_fips, CASE WHEN length(k) < 5
      THEN lpad(k, 5, '0') ELSE k END AS county_fips
    FROM (SELECT c_nationkey, CAST(max(c_custkey) AS VARCHAR) AS k FROM customer GROUP BY 1)""")
def places_last_entry(spark, sf_dir):
    """Of repeated places the last entry counts."""
    return exposure.last_county_of_place(fx.place_entries(spark, sf_dir)).select(
        F.col("_place").alias("place_fips"), F.col("_place_county").alias("county_fips"))


# ---- files: tables written to a scratch folder and read by the library's readers ----

@query("yearly_files", (), """
    SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) IN (1993, 1995)""")
def yearly_files(spark, sf_dir):
    """One parquet file a year; 1994 is not requested, 2001 not known."""
    root, day = sinks.scratch(spark), F.col("o_orderdate")
    orders = fx.table(spark, sf_dir, "orders")
    for year in (1993, 1994, 1995):
        sinks.write_parquet(
            orders.where((day >= F.lit(f"{year}-01-01").cast("timestamp_ntz"))
                         & (day < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz"))),
            f"{root}/meetings.{year}.parquet")
    return readers.read_years(spark, root, [1993, 1995, 2001], [1993, 1994, 1995],
                              ["o_orderkey", "o_totalprice"])


@query("jsonl_scan", ("canonical",), "SELECT * FROM canonical")
def jsonl_scan(spark, sf_dir):
    """Canonical records as JSON lines, read back with their schema and domains."""
    path = sinks.scratch(spark)
    records = fx.canonical(spark, sf_dir)
    sinks.write_jsonl(records.withColumn("ingested_at", F.current_timestamp()), path)
    return readers.read_canonical(spark, path)[0].select(*records.columns)


@query("canonical_rejects", ("canonical",), """
    SELECT ingest_seq, CASE ingest_seq % 7 WHEN 1 THEN 'line,meeting_type' ELSE 'meeting_type' END
      AS violations, CASE ingest_seq % 7 WHEN 1 THEN 'word' END AS word
    FROM canonical WHERE ingest_seq % 7 IN (1, 2)""")
def canonical_rejects(spark, sf_dir):
    """Canonical records as JSON lines, of which some have an unknown meeting type, some a word
    for a number as well: those are rejected, the latter with their whole line."""
    path = sinks.scratch(spark)
    kind, records = F.col("ingest_seq") % 7, fx.canonical(spark, sf_dir)
    spoiled = records.withColumn("meeting_type", F.when(kind.isin(1, 2), "party").otherwise(
        F.col("meeting_type"))).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    lines = F.to_json(F.struct(*CANONICAL_MEETING.names), {"ignoreNullFields": "false"})
    spoiled.select(F.when(kind == 1, F.regexp_replace(
        lines, r'("transcript_chars"):(\d+)', '$1:"word"')).otherwise(lines)).write.text(path)
    rejects = readers.read_canonical(spark, path)[1]
    return rejects.select("ingest_seq", F.array_join("violations", ",").alias("violations"),
                          F.get_json_object("line", "$.transcript_chars").alias("word"))


@query("jsonl_untyped", ("label_responses",), "SELECT doc_id, raw FROM label_responses")
def jsonl_untyped(spark, sf_dir):
    """JSON lines without a schema."""
    path = sinks.scratch(spark)
    sinks.write_jsonl(fx.label_responses(spark, sf_dir), path)
    return readers.read_jsonl(spark, path).select("doc_id", "raw")


@query("jsonl_rejects", ("label_responses",), r"""
    SELECT regexp_replace(raw, '[\n\r]', ' ', 'g') AS line FROM label_responses
    WHERE doc_id % 5 IN (3, 4)""")
def jsonl_rejects(spark, sf_dir):
    """Responses as lines of a file, of which some are no JSON and some have a word for a
    number: those lines, verbatim."""
    path = sinks.scratch(spark)
    lines = fx.label_responses(spark, sf_dir).select(F.regexp_replace("raw", r"[\n\r]", " "))
    lines.write.text(path)
    return readers.jsonl_rejects(spark, path, ACTION).select("line")


@query("csv_counties", ("counties",), """
    SELECT STCOFIPS, STATEABBRV, COUNTY, n AS POPULATION, RISK_SCORE, IFLD_RISKS, CFLD_RISKS,
      WFIR_RISKS, HWAV_RISKS, DRGT_RISKS, HRCN_RISKS
    FROM counties LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1)
      ON k = CAST(STCOFIPS AS BIGINT) - 1""")
def csv_counties(spark, sf_dir):
    """The county table as a wide CSV with other columns; codes stay text."""
    path = sinks.scratch(spark)
    counties = fx.counties(spark, sf_dir)
    counties.withColumn("OTHER", F.lit("x")).write.option("header", True).csv(path)
    return readers.read_counties(spark, path).select(*counties.columns)


@query("csv_places", (), """
    SELECT ' ' || c_nationkey AS place_fips, CAST(c_custkey AS VARCHAR) AS county_fips
    FROM customer""")
def csv_places(spark, sf_dir):
    """An optional table: the first path that exists; another one is missing and empty."""
    root = sinks.scratch(spark)
    places = fx.place_entries(spark, sf_dir).select("place_fips", "county_fips")
    places.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(f"{root}/b")
    found = readers.read_or_empty(spark, [f"{root}/a", f"{root}/b"], PLACE_TO_COUNTY, "csv")
    empty = readers.read_or_empty(spark, f"{root}/a", PLACE_TO_COUNTY, "csv")
    return found.select("place_fips", "county_fips").unionByName(empty)


@query("segment_files", ("segment_records",), """
    SELECT * EXCLUDE (ingest_seq) REPLACE ('segments' AS source) FROM segment_records""")
def segment_files(spark, sf_dir):
    """Raw segments in several JSON files without an order column: files and rows in turn."""
    root = sinks.scratch(spark)
    raw = fx.raw_segments(spark, sf_dir)
    sinks.write_jsonl(raw.repartitionByRange(4, "ingest_seq").sortWithinPartitions("ingest_seq")
                      .select("uid", "transcript"), f"{root}/segments/sample.jsonl")
    spec = specs.SourceSpec.from_mapping("segments", {
        "loader": {"type": "huggingface_streaming"}, "mapper": {"type": "meetingbank_segments"},
        "source_url": fx.SEGMENT_SPEC.source_url})
    return specs.run_source(spark, spec, root).drop("ingest_seq")


@query("label_files", ("golden_latest", "golden"), """
    SELECT action_text, action_category, hazard_type, label_source FROM (
      SELECT action_text, action_category, hazard_type, 'first' AS label_source
      FROM golden_latest WHERE action_text NOT IN (SELECT action_text FROM golden
        WHERE action_category = 'mitigation')
      UNION ALL
      SELECT action_text, 'both', 'storm', 'second' FROM (SELECT DISTINCT action_text FROM golden
        WHERE action_category = 'mitigation'))""")
def label_files(spark, sf_dir):
    """Labels appended to a golden set in two runs; the last label of a text wins."""
    path = sinks.scratch(spark)
    golden = fx.golden(spark, sf_dir)
    columns = ("canonical_id", "action_text", "action_category", "hazard_type", "label_source")
    first = golden.withColumn("label_source", F.lit("first"))
    again = (golden.where("action_category = 'mitigation'")
             .withColumn("action_category", F.lit("both")).withColumn("hazard_type", F.lit("storm"))
             .withColumn("label_source", F.lit("second")))
    sinks.append_labels(first.repartitionByRange(4, "seq").sortWithinPartitions("seq")
                        .select(*columns), path)
    sinks.append_labels(again.select(*columns), path)
    stored = readers.read_jsonl_in_order(spark, path, GOLDEN, "line")
    # Two runs may stamp their labels alike only within one instant.
    return evaluation.golden_latest(
        stored.withColumn("seq", F.struct("labelled_at", "line")).drop("labelled_at", "line")
    ).select("action_text", "action_category", "hazard_type", "label_source")


@query("label_retry", ("golden",), """
    SELECT '20240101T000000Z' AS run, count(*) AS n, count(DISTINCT action_text) AS texts FROM golden
    UNION ALL SELECT '20240102T000000Z', count(*), count(DISTINCT action_text) FROM golden
    WHERE action_category = 'mitigation'""")
def label_retry(spark, sf_dir):
    """Two runs of labels, the second of them tried twice: it is there once."""
    path = sinks.scratch(spark)
    golden = fx.golden(spark, sf_dir)
    sinks.append_labels(golden, path, "20240101T000000Z")
    for _ in range(2):
        sinks.append_labels(golden.where("action_category = 'mitigation'"), path,
                            "20240102T000000Z")
    return spark.read.schema("action_text string, run string").json(path).groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("action_text").alias("texts"))


# ---- field mapping -----------------------------------------------------------

@query("map_fields", ("canonical",), "SELECT * FROM canonical")
def map_fields(spark, sf_dir):
    return fx.canonical(spark, sf_dir)


@query("map_constants", ("raw_tabular",), """
    SELECT trim(vid_id) AS source_record_id, 'other' AS meeting_type, 'GU' AS state
    FROM raw_tabular""")
def map_constants(spark, sf_dir):
    raw = fx.raw_tabular(spark, sf_dir)
    return raw.select(*[c.alias(n) for n, c in fields.compile_map(
        fx.CONST_MAP, raw.schema).items()])


@query("nan_to_null", (), """
    SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer""")
def nan_to_null(spark, sf_dir):
    """Negative balances stand for NaN."""
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("double"))
    return domains.nan_to_null(fx.table(spark, sf_dir, "customer").select(
        "c_custkey", F.coalesce(balance, F.lit(float("nan"))).alias("balance")))


@query("in_scope", ("raw_tabular",), f"""
    SELECT vid_id, place_govt FROM raw_tabular
    WHERE {sql.govt_type('place_govt')} IS NOT NULL""")
def in_scope(spark, sf_dir):
    return specs.in_scope(fx.raw_tabular(spark, sf_dir), fx.TABULAR_SPEC).select(
        "vid_id", "place_govt")


@query("state_abbrev", ("raw_tabular",), f"""
    SELECT vid_id, {sql.case_map(sql.strip('state_name'), sql.STATE_CODES, "''")} AS state
    FROM raw_tabular""")
def state_abbrev(spark, sf_dir):
    raw = fx.raw_tabular(spark, sf_dir)
    state = fields.compile_spec({"state_abbrev": "state_name"}, raw.schema)
    return raw.select("vid_id", state.alias("state"))


@query("summary_tier", ("mapped",), """
    SELECT source_record_id, CASE WHEN length(transcript) > 0 THEN CASE
        WHEN length(transcript) % 4 = 1 THEN 'summary' ELSE 'full_text' END
      ELSE 'metadata_only' END AS transcript_quality
    FROM mapped WHERE jurisdiction_fips <> '' AND meeting_type IS NOT NULL
      AND meeting_date IS NOT NULL""")
def summary_tier(spark, sf_dir):
    """A source that says of some transcripts that they are summaries."""
    raw = fx.raw_tabular(spark, sf_dir)
    text = fields.compile_spec(fx.TABULAR_SPEC.field_map["transcript"], raw.schema)
    told = raw.withColumn("tier", F.when(F.length(text) % 4 == 1, "summary").otherwise("full_text"))
    spec = replace(fx.TABULAR_SPEC, field_map={**fx.TABULAR_SPEC.field_map,
                                               "transcript_quality": {"copy": "tier"}})
    return specs.canonical_of(told, spec).select("source_record_id", "transcript_quality")


@query("govt_type", ("raw_tabular",), f"""
    SELECT vid_id, {sql.govt_type('place_govt')} AS meeting_type FROM raw_tabular""")
def govt_type(spark, sf_dir):
    return fx.raw_tabular(spark, sf_dir).select(
        "vid_id", fields.meeting_type_from_govt(F.col("place_govt")).alias("meeting_type"))


@query("parse_dates", ("raw_tabular",), """
    SELECT vid_id, CAST(try_strptime(meeting_date, '%Y-%m-%d') AS DATE) AS iso_date,
      CAST(try_strptime(meeting_date, '%Y-%m-%d') AS DATE) AS us_date
    FROM raw_tabular""")
def parse_dates(spark, sf_dir):
    day = F.col("meeting_date")
    us = F.concat(F.substring(day, 6, 2), F.substring(day, 9, 2), F.substring(day, 1, 4))
    return fx.raw_tabular(spark, sf_dir).select(
        "vid_id", fields.parse_date(day).alias("iso_date"),
        fields.parse_date(us, "mmddyyyy").alias("us_date"))


@query("clean_text", ("mapped",), """
    SELECT source_record_id AS vid_id, transcript FROM mapped""")
def clean_text(spark, sf_dir):
    raw = fx.raw_tabular(spark, sf_dir)
    text = fields.compile_spec(fx.TABULAR_SPEC.field_map["transcript"], raw.schema)
    return raw.select("vid_id", text.alias("transcript"))


@query("canonical_id", ("raw_tabular",), f"""
    SELECT vid_id, {sql.meeting_id('st_fips', "DATE '2006-01-01' + CAST(ingest_seq % 6000 AS INTEGER)",
                                   'place_govt')} AS canonical_id FROM raw_tabular""")
def canonical_ids(spark, sf_dir):
    day = F.date_add(F.lit("2006-01-01").cast("date"), (F.col("ingest_seq") % 6000).cast("int"))
    return fx.raw_tabular(spark, sf_dir).select(
        "vid_id", canonical_id(F.col("st_fips"), day, F.col("place_govt")).alias("canonical_id"))


@query("domain_check", ("mapped",), """
    SELECT source_record_id, concat_ws(',', CASE WHEN meeting_date IS NULL THEN 'meeting_date' END,
      CASE WHEN meeting_type IS NULL THEN 'meeting_type' END) AS violations
    FROM mapped WHERE meeting_date IS NULL OR meeting_type IS NULL""")
def domain_check(spark, sf_dir):
    raw = fx.raw_tabular(spark, sf_dir)
    mapped = raw.select(*[c.alias(n) for n, c in fields.compile_map(
        {k: v for k, v in fx.TABULAR_SPEC.field_map.items() if k != "transcript"},
        raw.schema).items()])
    rules = {name: rule for name, rule in domains.MEETING_RULES.items()
             if name in mapped.columns}
    _, rejects = domains.check_domain(mapped, rules)
    return rejects.select("source_record_id", F.concat_ws(",", "violations").alias("violations"))


# ---- ingestion ---------------------------------------------------------------

@query("parse_uid", ("raw_segments", "parsed_segments"), """
    SELECT uid, fips, state, name, meeting_date, meeting_type, meeting_uid
    FROM parsed_segments""")
def parse_uid(spark, sf_dir):
    raw = fx.raw_segments(spark, sf_dir)
    return (raw.select("uid", segments.parse_uid(F.col("uid")).alias("p"))
            .where(F.col("p").isNotNull()).select("uid", "p.*"))


@query("segments_to_meetings", ("segment_records",), "SELECT * FROM segment_records")
def segments_to_meetings(spark, sf_dir):
    return fx.segment_records(spark, sf_dir)


def _all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.union_sources([fx.canonical(spark, sf_dir), fx.segment_records(spark, sf_dir)])


@query("ingest_all", ("all_records",), "SELECT * FROM all_records")
def ingest_all(spark, sf_dir):
    return _all_records(spark, sf_dir)


@query("ingest_counts", ("all_records",), """
    SELECT source, count(*) AS kept FROM all_records GROUP BY source""")
def ingest_counts(spark, sf_dir):
    return specs.ingest_counts(_all_records(spark, sf_dir))


@query("source_jurisdiction_counts", ("all_records",), """
    SELECT source, jurisdiction_name, count(*) AS n FROM all_records GROUP BY ALL""")
def source_jurisdiction_counts(spark, sf_dir):
    return summaries.source_jurisdiction_counts(_all_records(spark, sf_dir))


# ---- linking -----------------------------------------------------------------

@query("primaries", ("meetings",), "SELECT * FROM meetings")
def primaries(spark, sf_dir):
    return linking.primaries(fx.canonical(spark, sf_dir))


@query("meeting_table", ("meetings", "canonical"), """
    SELECT m.* EXCLUDE (transcript), transcript IS NOT NULL AS has_transcript, first_seq
    FROM meetings m JOIN (SELECT canonical_id, min(ingest_seq) AS first_seq FROM canonical
      GROUP BY 1) USING (canonical_id)""")
def meeting_table(spark, sf_dir):
    return _meetings(spark, sf_dir)


@query("merged_transcripts", ("merged",), "SELECT canonical_id, transcript FROM merged")
def merged_transcripts(spark, sf_dir):
    return linking.merged_transcripts(fx.canonical(spark, sf_dir))


_PARTS = """
    SELECT canonical_id, part, total, text,
      CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY canonical_id ORDER BY part
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM (SELECT canonical_id, text, row_number() OVER (PARTITION BY canonical_id ORDER BY place) - 1
        AS part, CAST(sum(length(text) + 2) OVER (PARTITION BY canonical_id) - 2 AS BIGINT) AS total
      FROM ({texts}))"""


@query("transcript_parts", ("ranked",), _PARTS.format(texts=f"""
    SELECT canonical_id, text, min(rn) AS place
    FROM (SELECT canonical_id, rn, {sql.strip('transcript')} AS text FROM ranked)
    WHERE text <> '' GROUP BY canonical_id, text"""))
def transcript_parts(spark, sf_dir):
    return linking.transcript_parts(fx.canonical(spark, sf_dir))


@query("segment_parts", ("parsed_segments",), _PARTS.format(texts=f"""
    SELECT {sql.meeting_id('fips', 'meeting_date', 'meeting_type')} AS canonical_id,
      transcript AS text, ingest_seq AS place FROM parsed_segments WHERE transcript <> ''"""))
def segment_parts(spark, sf_dir):
    return segments.segment_parts(fx.raw_segments(spark, sf_dir))


@query("provenance", ("ranked",), """
    SELECT canonical_id, source, source_record_id, source_url, transcript_quality,
      rn = 1 AS is_primary FROM ranked""")
def provenance(spark, sf_dir):
    return linking.provenance(fx.canonical(spark, sf_dir))


@query("conflicts", ("conflicts",), """
    SELECT *, CAST(NULL AS VARCHAR) AS resolved_value, CAST(NULL AS VARCHAR) AS note
    FROM conflicts""")
def conflicts(spark, sf_dir):
    return linking.conflicts(fx.canonical(spark, sf_dir))


@query("conflicts_resolved", ("conflicts", "ranked"), """
    WITH votes AS (
      SELECT canonical_id, field, value, count(*) AS n, min(ingest_seq) AS first, max(CASE
        transcript_quality WHEN 'full_text' THEN 3 WHEN 'summary' THEN 2 ELSE 1 END) AS rank
      FROM (SELECT canonical_id, ingest_seq, transcript_quality, 'jurisdiction_name' AS field,
          jurisdiction_name AS value FROM ranked UNION ALL
        SELECT canonical_id, ingest_seq, transcript_quality, 'state', state FROM ranked)
      WHERE value <> '' GROUP BY ALL),
    chosen AS (SELECT *, count(*) OVER w AS n_values, CAST(sum(n) OVER w AS BIGINT) AS total,
        row_number() OVER (PARTITION BY canonical_id, field ORDER BY rank DESC, n DESC, first) AS k
      FROM votes WINDOW w AS (PARTITION BY canonical_id, field))
    SELECT c.*, CASE WHEN n_values > 1 THEN value END AS resolved_value, CASE WHEN n_values > 1
      THEN format('{} of {} records, quality {}, {} values', n, total, rank, n_values) END AS note
    FROM conflicts c LEFT JOIN (SELECT * FROM chosen WHERE k = 1) USING (canonical_id, field)""")
def conflicts_resolved(spark, sf_dir):
    return linking.conflicts_resolved(fx.canonical(spark, sf_dir))


@query("conflicts_none", ("canonical",), """
    SELECT count(*) AS records, CAST(0 AS BIGINT) AS conflicts FROM canonical WHERE canonical_id IN
      (SELECT canonical_id FROM canonical GROUP BY 1 HAVING count(*) = 1)""")
def conflicts_none(spark, sf_dir):
    """Meetings of one record have an empty conflict table."""
    records = fx.canonical(spark, sf_dir)
    alone = records.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    records = records.join(alone, "canonical_id", "left_semi")
    return linking.overlap_stats(records, linking.conflicts(records)).select("records", "conflicts")


@query("overlap_stats", ("canonical", "conflicts"), """
    SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS meetings,
      count(*) FILTER (WHERE n > 1) AS linked, count(*) FILTER (WHERE s > 1) AS cross_source,
      (SELECT count(*) FROM conflicts) AS conflicts
    FROM (SELECT count(*) AS n, count(DISTINCT source) AS s FROM canonical
          GROUP BY canonical_id)""")
def overlap_stats(spark, sf_dir):
    records = fx.canonical(spark, sf_dir)
    return linking.overlap_stats(records.select("canonical_id", "source"),
                                 linking.conflicts(records))


@query("resolve_tables", ("canonical", "meetings", "conflicts"), """
    SELECT 'meetings' AS name, count(*) AS n FROM meetings UNION ALL
    SELECT 'links', count(*) FROM canonical UNION ALL
    SELECT 'conflicts', count(*) FROM conflicts""")
def resolve_tables(spark, sf_dir):
    """Rows of each table that linking gives."""
    return _sizes(linking.resolve(fx.canonical(spark, sf_dir))._asdict())


@query("resolve_jurisdiction", ("canonical",), f"""
    WITH listed AS (SELECT 'nation_' || n_nationkey AS name,
        {sql.pick([sql.STATE_CODES.get(n, 'GU') for n in fx.STATE_NAMES], 'n_nationkey % 10')}
          AS state, lpad(CAST(n_nationkey + 1 AS VARCHAR), 7, '0') AS fips FROM nation),
      names AS (SELECT DISTINCT jurisdiction_name, state, lower(jurisdiction_name) AS key
                FROM canonical),
      near AS (SELECT jurisdiction_name, n.state, fips, levenshtein(key, name) AS edits,
          greatest(length(key), length(name)) AS longer, name
        FROM names n JOIN listed l ON n.state = l.state)
    SELECT jurisdiction_name, state, fips,
      CASE WHEN edits = 0 THEN 'exact' WHEN edits IS NOT NULL THEN 'close' END AS match
    FROM (SELECT DISTINCT jurisdiction_name, state FROM names)
    LEFT JOIN (SELECT * FROM near WHERE 1.0 - edits / longer >= 0.8
      QUALIFY row_number() OVER (PARTITION BY jurisdiction_name, state
        ORDER BY edits, name) = 1) USING (jurisdiction_name, state)""")
def resolve_jurisdiction(spark, sf_dir):
    return jurisdictions.resolve_jurisdictions(fx.canonical(spark, sf_dir),
                                               fx.crosswalk(spark, sf_dir))


# ---- lexicon -----------------------------------------------------------------

@query("split_sentences", (), f"""
    SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence
    FROM (SELECT doc_id, {sql.sentence_list('text')} AS l FROM documents)""")
def split_sentences(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    return (extraction.split_sentences(docs, ["doc_id"], "text")
            .withColumn("pos", F.col("pos").cast("long")))


@query("term_hits", (), "SELECT doc_id, " + ", ".join(
    f"{sql.hits('lower(text)', words)} AS {name}" for name, words in (
        ("adaptation", fx.TEST_LEXICON.adaptation_strong),
        ("mitigation", fx.TEST_LEXICON.mitigation_strong),
        ("generic", fx.TEST_LEXICON.climate_generic),
        ("weak", fx.TEST_LEXICON.weak_context),
        ("procedural", fx.TEST_LEXICON.procedural))) + " FROM documents")
def term_hits(spark, sf_dir):
    lex = fx.TEST_LEXICON
    return fx.documents(spark, sf_dir).select("doc_id", *[
        F.size(lexicon.term_hits(F.col("text"), words)).cast("long").alias(name)
        for name, words in (("adaptation", lex.adaptation_strong),
                            ("mitigation", lex.mitigation_strong),
                            ("generic", lex.climate_generic),
                            ("weak", lex.weak_context), ("procedural", lex.procedural))])


@query("hazard_tag", (), f"""
    SELECT doc_id, {sql.hazard('lower(text)', fx.TEST_LEXICON)} AS hazard FROM documents""")
def hazard_tag(spark, sf_dir):
    return fx.documents(spark, sf_dir).select(
        "doc_id", lexicon.hazard_tag(F.col("text"), fx.TEST_LEXICON).alias("hazard"))


@query("classify_text", (), f"""
    WITH s AS (SELECT doc_id, unnest({sql.sentence_list('text')}) AS sentence FROM documents),
      c AS ({sql.classified('s', 'sentence')})
    SELECT doc_id, sentence, category, hazard, confidence FROM c""")
def classify_text(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    labelled = extraction.split_sentences(docs, ["doc_id"], "text").select(
        "doc_id", "sentence",
        lexicon.classify(F.col("sentence"), fx.TEST_LEXICON).alias("label"))
    return labelled.select("doc_id", "sentence", "label.*")


def _register_shipped_lexicon() -> None:
    shipped = lexicon.load_lexicon()
    terms = fx.lexicon_terms(shipped)

    @query("shipped_lexicon", (), f"""
        WITH s AS (SELECT doc_id, unnest({sql.sentence_list(sql.planted(terms))}) AS sentence
          FROM documents),
          c AS ({sql.classified('s', 'sentence', shipped)})
        SELECT category, hazard, confidence, count(*) AS n FROM c GROUP BY ALL""")
    def shipped_lexicon(spark, sf_dir):
        """Sentences per label under the lexicon file of the library, whose terms each
        document has two of."""
        docs = fx.documents(spark, sf_dir).select("doc_id", fx.planted(terms).alias("text"))
        label = lexicon.classify(F.col("sentence"), shipped)
        return (extraction.split_sentences(docs, ["doc_id"], "text").select(label.alias("label"))
                .groupBy("label.category", "label.hazard", "label.confidence")
                .agg(F.count(F.lit(1)).alias("n")))

    @query("shipped_terms", (), f"""
        SELECT term, count(*) AS n FROM (SELECT unnest(list_filter({sql.text_list(terms)},
          lambda t: contains(lower({sql.planted(terms)}), t))) AS term FROM documents)
        GROUP BY term""")
    def shipped_terms(spark, sf_dir):
        """How many documents hold each term of the lexicon file, in one pass over a text."""
        docs = fx.documents(spark, sf_dir).select(fx.planted(terms).alias("text"))
        return (docs.select(F.explode(lexicon.term_hits(F.col("text"), terms)).alias("term"))
                .groupBy("term").agg(F.count(F.lit(1)).alias("n")))


if find_spec("yaml"):  # the lexicon file is YAML
    _register_shipped_lexicon()


@query("extract_actions", ("actions",), "SELECT * FROM actions")
def extract_actions(spark, sf_dir):
    return _actions(spark, sf_dir)


@query("default_stamps", ("canonical", "actions"), """
    SELECT 'records' AS name, count(*) AS n, count(*) AS stamped, CAST(1 AS BIGINT) AS instants
    FROM canonical UNION ALL SELECT 'actions', count(*), count(*), 1 FROM actions""")
def default_stamps(spark, sf_dir):
    """Records and actions without a time get that of their run."""
    records = specs.stamped(fx.canonical(spark, sf_dir))
    actions = extraction.extract_actions(fx.canonical(spark, sf_dir), fx.TEST_LEXICON,
                                         fx.TEST_VERSION)

    def of(name: str, table: DataFrame, stamp: str) -> DataFrame:
        return table.agg(F.count(F.lit(1)).alias("n"), F.count(stamp).alias("stamped"),
                         F.count_distinct(stamp).alias("instants")).select(
            F.lit(name).alias("name"), "n", "stamped", "instants")

    return of("records", records, "ingested_at").unionByName(of("actions", actions, "extracted_at"))


@query("category_counts", ("actions",), """
    SELECT action_category, count(*) AS actions FROM actions GROUP BY ALL""")
def category_counts(spark, sf_dir):
    return summaries.category_counts(_actions(spark, sf_dir))


# ---- model responses ---------------------------------------------------------

@query("prompt_table", ("merged",), f"""
    SELECT canonical_id, CAST(w AS INTEGER) AS window_seq,
      '{extraction.EXTRACTION_PROMPT}' || chr(10) || chr(10)
      || '## Transcript excerpt' || chr(10) || chr(10) || substr(transcript, w * 5800 + 1, 6000)
      || chr(10) AS prompt
    FROM (SELECT *, unnest(range(0, 1 + CAST(ceil(greatest(length(transcript) - 6000, 0)
      / 5800.0) AS BIGINT))) AS w FROM merged)""")
def prompt_table(spark, sf_dir):
    return extraction.prompt_windows(linking.transcript_parts(fx.canonical(spark, sf_dir)))


_ITEM_FIELDS = ", ".join(
    f"json_extract_string(item, '$.{f}') AS {f}"
    for f in ("action_text", "action_category", "hazard_type", "confidence"))


@query("parse_responses", ("responses",), f"""
    SELECT canonical_id, {sql.strip('action_text')} AS action_text, action_category,
      CASE WHEN hazard_type IN {sql.HAZARD_LIST} THEN hazard_type END AS hazard_type,
      greatest(0.0::DOUBLE, least(1.0::DOUBLE,
        coalesce(TRY_CAST(confidence AS DOUBLE), 0.0))) AS confidence,
      'model:test' AS model_version
    FROM (SELECT canonical_id, {_ITEM_FIELDS} FROM (
      SELECT canonical_id, unnest(json_extract(j, '$.actions[*]')) AS item
      FROM (SELECT canonical_id, CASE WHEN json_valid(raw) THEN raw END AS j FROM responses)
      WHERE json_type(j, '$.actions') = 'ARRAY') WHERE json_type(item) = 'OBJECT')
    WHERE action_category IN {sql.CATEGORY_LIST} AND {sql.strip('action_text')} <> ''""")
def parse_responses(spark, sf_dir):
    return responses.parse_responses(fx.responses(spark, sf_dir),
                                     extraction.model_version("model", "test"))


@query("response_rejects", ("responses",), """
    SELECT canonical_id, reason FROM (
      SELECT canonical_id, CASE WHEN j IS NULL THEN 'not_json'
        WHEN json_type(j, '$.actions') <> 'ARRAY' THEN 'actions_not_array' END AS reason
      FROM (SELECT canonical_id, CASE WHEN json_valid(raw) THEN raw END AS j FROM responses))
    WHERE reason IS NOT NULL""")
def response_rejects(spark, sf_dir):
    return responses.response_rejects(fx.responses(spark, sf_dir))


@query("parse_label_response", ("label_responses",), f"""
    SELECT doc_id, CASE WHEN ok THEN c ELSE 'unrelated' END AS category,
      CASE WHEN ok AND h IN {sql.HAZARD_LIST} THEN h ELSE 'none' END AS hazard,
      CASE WHEN ok THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE,
        coalesce(TRY_CAST(f AS DOUBLE), 0.0))) ELSE 0.0::DOUBLE END AS confidence
    FROM (SELECT doc_id, c, h, f, coalesce(c IN {sql.CATEGORY_LIST}, false) AS ok FROM (
      SELECT doc_id, json_extract_string(j, '$.action_category') AS c,
        json_extract_string(j, '$.hazard_type') AS h,
        json_extract_string(j, '$.confidence') AS f
      FROM (SELECT doc_id, CASE WHEN json_valid(raw) THEN raw END AS j FROM label_responses)))
    """)
def parse_label_response(spark, sf_dir):
    raw = fx.label_responses(spark, sf_dir)
    return raw.select("doc_id", responses.parse_label_response(F.col("raw")).alias("label")
                      ).select("doc_id", "label.*")


# ---- summaries ---------------------------------------------------------------

@query("region_rollup", ("placed",), """
    SELECT region, count(*) AS meetings FROM placed GROUP BY region""")
def region_rollup(spark, sf_dir):
    return summaries.region_rollup(_meetings(spark, sf_dir))


@query("division_rollup", ("meetings",), f"""
    SELECT {sql.division('state')} AS division, count(*) AS meetings FROM meetings GROUP BY ALL""")
def division_rollup(spark, sf_dir):
    return summaries.division_rollup(_meetings(spark, sf_dir))


@query("actions_enriched", ("enriched",), "SELECT * FROM enriched")
def actions_enriched(spark, sf_dir):
    return summaries.actions_enriched(*_both(spark, sf_dir))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE action_category = '{c}') AS {c}"
                    for c in ("adaptation", "mitigation", "both"))


@query("category_pivot", ("enriched",), f"""
    SELECT region, {_COUNTS} FROM enriched GROUP BY region""")
def category_pivot(spark, sf_dir):
    return summaries.category_pivot(
        summaries.actions_enriched(*_both(spark, sf_dir)), "region")


def _intensity_sql(keys: str, join: str, extra: str = "") -> str:
    return f"""
    SELECT *, adaptation + mitigation + "both" AS climate_actions,
      round_even((adaptation + mitigation + "both") / meetings, 3) AS actions_per_meeting
    FROM (SELECT b.*, coalesce(adaptation, 0) AS adaptation, coalesce(mitigation, 0)
        AS mitigation, coalesce("both", 0) AS "both"
      FROM (SELECT {keys}, count(DISTINCT canonical_id) AS meetings {extra}
            FROM placed GROUP BY ALL) b
      LEFT JOIN (SELECT {join}, {_COUNTS.replace('AS both', 'AS "both"')}
                 FROM enriched GROUP BY ALL) c USING ({join}))"""


@query("by_region", ("placed", "enriched"), _intensity_sql(
    "region", "region", ", count(DISTINCT jurisdiction_fips) AS jurisdictions"))
def by_region(spark, sf_dir):
    return summaries.by_region(_counts(spark, sf_dir))


@query("by_state", ("placed", "enriched"), _intensity_sql("state, region", "state"))
def by_state(spark, sf_dir):
    return summaries.by_state(_counts(spark, sf_dir))


@query("by_time", ("placed", "enriched"), _intensity_sql("CAST(year AS INTEGER) AS year", "year"))
def by_time(spark, sf_dir):
    return summaries.by_time(_counts(spark, sf_dir))


@query("by_hazard", ("actions",), """
    SELECT hazard_type, count(*) AS actions FROM actions
    WHERE action_category IN ('adaptation', 'both') GROUP BY ALL
    ORDER BY actions DESC, hazard_type""")
def by_hazard(spark, sf_dir):
    return summaries.by_hazard(_actions(spark, sf_dir))


@query("hazard_by_region", ("enriched",), """
    SELECT region, hazard_type, count(*) AS actions FROM enriched
    WHERE action_category IN ('adaptation', 'both') GROUP BY ALL
    ORDER BY region, actions DESC, hazard_type""")
def hazard_by_region(spark, sf_dir):
    return summaries.hazard_by_region(*_both(spark, sf_dir))


_COVERAGE = """
    SELECT region, source, count(DISTINCT canonical_id) AS meetings,
      count(DISTINCT jurisdiction_fips) AS jurisdictions,
      round_even(100.0::DOUBLE * avg(CASE WHEN transcript IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE),
                 1) AS pct_with_transcript
    FROM placed GROUP BY ALL"""


@query("coverage", ("placed",), _COVERAGE)
def coverage(spark, sf_dir):
    return summaries.coverage(_meetings(spark, sf_dir))


_PER_SOURCE = ", ".join(f"count(DISTINCT canonical_id) FILTER (WHERE source = '{s}') AS {s}"
                        for s in fx.SOURCES)


@query("coverage_pivot", ("placed",), f"SELECT region, {_PER_SOURCE} FROM placed GROUP BY region")
def coverage_pivot(spark, sf_dir):
    """A column for every source of the data's domain; listed, they take no pass to find."""
    return summaries.coverage_pivot(summaries.coverage(_meetings(spark, sf_dir)), fx.SOURCES)


@query("overview", ("meetings",), """
    SELECT count(*) AS meetings, count(DISTINCT jurisdiction_fips) AS jurisdictions,
      count(DISTINCT state) AS states, count(DISTINCT source) AS sources FROM meetings""")
def overview(spark, sf_dir):
    return summaries.overview(_meetings(spark, sf_dir))


# ---- exposure ----------------------------------------------------------------

def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.with_county_names(_meetings(spark, sf_dir))


def _exposure(spark: SparkSession, sf_dir: str, meetings: DataFrame) -> DataFrame:
    return exposure.enrich(fx.with_county_names(meetings), fx.counties(spark, sf_dir),
                           fx.place_to_county(spark), fx.FIXED_COUNTY)


@query("county_name_match", ("name_keyed",), """
    SELECT canonical_id, name_key FROM name_keyed""")
def county_name_match(spark, sf_dir):
    return _named(spark, sf_dir).select("canonical_id", exposure.county_name_key(
        F.col("jurisdiction_name"), F.col("state")).alias("name_key"))


@query("resolve_county", ("resolved",), "SELECT canonical_id, county_fips FROM resolved")
def resolve_county(spark, sf_dir):
    return exposure.resolve_county(
        _named(spark, sf_dir), fx.counties(spark, sf_dir), fx.place_to_county(spark),
        fx.FIXED_COUNTY).select("canonical_id", "county_fips")


@query("exposure_enrich", ("exposure",), "SELECT * FROM exposure")
def exposure_enrich(spark, sf_dir):
    return _exposure(spark, sf_dir, _meetings(spark, sf_dir))


@query("exposure_coverage", ("exposure",), """
    SELECT count(county_fips) AS resolved, count(*) AS meetings FROM exposure""")
def exposure_coverage(spark, sf_dir):
    return exposure.exposure_coverage(_exposure(spark, sf_dir, _meetings(spark, sf_dir)))


def _per_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    meetings, actions = _both(spark, sf_dir)
    return summaries.exposure_jurisdictions(actions, _exposure(spark, sf_dir, meetings))


@query("exposure_jurisdictions", ("per_county",), "SELECT * FROM per_county")
def exposure_jurisdictions(spark, sf_dir):
    return _per_county(spark, sf_dir)


@query("exposure_alignment", ("alignment",), "SELECT * FROM alignment")
def exposure_alignment(spark, sf_dir):
    return summaries.exposure_alignment(_per_county(spark, sf_dir))


@query("alignment_display", ("alignment",), """
    SELECT * FROM alignment WHERE pearson_r_risk_vs_action IS NOT NULL""")
def alignment_display(spark, sf_dir):
    return summaries.alignment_display(summaries.exposure_alignment(_per_county(spark, sf_dir)))


@query("build_all", ("placed", "actions", "enriched", "per_county", "alignment"), """
    SELECT 'by_region' AS name, count(DISTINCT region) AS n FROM placed UNION ALL
    SELECT 'by_state', count(DISTINCT state) FROM placed UNION ALL
    SELECT 'by_time', count(DISTINCT year) FROM placed UNION ALL
    SELECT 'by_hazard', count(DISTINCT hazard_type) FROM actions
      WHERE action_category IN ('adaptation', 'both') UNION ALL
    SELECT 'hazard_by_region', count(*) FROM (SELECT DISTINCT region, hazard_type FROM enriched
      WHERE action_category IN ('adaptation', 'both') AND hazard_type IS NOT NULL) UNION ALL
    SELECT 'coverage', count(*) FROM (SELECT DISTINCT region, source FROM placed) UNION ALL
    SELECT 'exposure_jurisdictions', count(*) FROM per_county UNION ALL
    SELECT 'exposure_alignment', count(*) FROM alignment""")
def build_all(spark, sf_dir):
    """Rows of each summary table, over actions and counts that are stored once."""
    meetings = _meetings(spark, sf_dir)
    actions = sinks.stored(_actions(spark, sf_dir))
    counts = sinks.stored(summaries.meeting_counts(meetings, actions))
    return _sizes(summaries.build_all(meetings, actions, _exposure(spark, sf_dir, meetings),
                                      counts))


# ---- evaluation --------------------------------------------------------------

def _classifier(lex):
    return lambda text: lexicon.classify(text, lex)


def _cube(spark: SparkSession, sf_dir: str, lex=fx.TEST_LEXICON) -> DataFrame:
    latest = evaluation.golden_latest(fx.golden(spark, sf_dir))
    return evaluation.score_cube(evaluation.eval_pairs(latest, _classifier(lex)))


@query("golden_latest", ("golden_latest",), "SELECT * FROM golden_latest")
def golden_latest(spark, sf_dir):
    return evaluation.golden_latest(fx.golden(spark, sf_dir))


@query("eval_pairs", ("scored",), """
    SELECT seq, action_category AS y_true, coalesce(hazard_type, 'none') AS haz_true,
      category AS y_pred, hazard AS haz_pred, confidence FROM scored""")
def eval_pairs(spark, sf_dir):
    return evaluation.eval_pairs(evaluation.golden_latest(fx.golden(spark, sf_dir)),
                                 _classifier(fx.TEST_LEXICON), ("seq",))


def _f1_sql(source: str) -> str:
    return f"""
    SELECT category, CASE WHEN p = 0 THEN 0.0 ELSE tp::DOUBLE / p END AS "precision",
      CASE WHEN t = 0 THEN 0.0 ELSE tp::DOUBLE / t END AS recall,
      CASE WHEN p + t = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (p + t) END AS f1, t AS support
    FROM (SELECT c.category,
        count(*) FILTER (WHERE s.category = c.category AND action_category = c.category) AS tp,
        count(*) FILTER (WHERE s.category = c.category) AS p,
        count(*) FILTER (WHERE action_category = c.category) AS t
      FROM (VALUES ('adaptation'), ('mitigation'), ('both'), ('unrelated')) c(category)
      CROSS JOIN {source} s GROUP BY c.category)"""


def _per_category_sql(source: str) -> str:
    return f"""SELECT 'lexicon' AS method, category,
      round_even("precision", 3) AS "precision", round_even(recall, 3) AS recall,
      round_even(f1, 3) AS f1, support FROM ({_f1_sql(source)})"""


_OVERALL_SQL = f"""
    SELECT 'lexicon' AS method, golden_items, round_even(macro, 3) AS macro_f1,
      round_even(po, 3) AS accuracy, round_even((po - pe) / (1.0 - pe), 3) AS kappa
    FROM (SELECT count(*) AS golden_items,
        count(*) FILTER (WHERE category = action_category)::DOUBLE / count(*) AS po,
        (SELECT avg(f1) FROM ({_f1_sql('scored')})) AS macro,
        (SELECT sum(t::DOUBLE * p) FROM (SELECT
            count(*) FILTER (WHERE action_category = l.label) AS t,
            count(*) FILTER (WHERE category = l.label) AS p
          FROM (SELECT action_category AS label FROM scored UNION SELECT category FROM scored) l
          CROSS JOIN scored GROUP BY l.label)) / (count(*)::DOUBLE * count(*)) AS pe
      FROM scored)"""

_CALIBRATION_SQL = """
    SELECT 'lexicon' AS method, CASE WHEN confidence < 0.5 THEN '0.0-0.5'
        WHEN confidence < 0.7 THEN '0.5-0.7' WHEN confidence < 0.9 THEN '0.7-0.9'
        ELSE '0.9-1.0' END AS bin, count(*) AS n,
      round_even(count(*) FILTER (WHERE category = action_category)::DOUBLE / count(*), 3)
        AS empirical_accuracy
    FROM scored GROUP BY ALL"""

_HAZARD_SQL = """
    SELECT 'lexicon' AS method, coalesce(hazard_type, 'none') AS hazard_type,
      count(*) FILTER (WHERE hazard = coalesce(hazard_type, 'none')) AS correct,
      count(*) AS support,
      round_even(count(*) FILTER (WHERE hazard = coalesce(hazard_type, 'none'))::DOUBLE
                 / count(*), 3) AS accuracy
    FROM scored WHERE action_category = 'adaptation' GROUP BY coalesce(hazard_type, 'none')"""


@query("eval_per_category", ("scored",), _per_category_sql("scored"))
def eval_per_category(spark, sf_dir):
    return evaluation.per_category(_cube(spark, sf_dir), "lexicon")


@query("eval_overall", ("scored",), _OVERALL_SQL)
def eval_overall(spark, sf_dir):
    return evaluation.overall(_cube(spark, sf_dir), "lexicon")


def _python_rules(texts: pd.Series) -> pd.DataFrame:
    """The test lexicon's decision as a Python function over a batch of texts."""
    low, lex = texts.str.lower(), fx.TEST_LEXICON

    def hits(words: tuple[str, ...]) -> pd.Series:
        return low.map(lambda text: sum(word in text for word in words))

    adapt, mitig = hits(lex.adaptation_strong), hits(lex.mitigation_strong)
    generic, weak = hits(lex.climate_generic) > 0, hits(lex.weak_context) > 0
    procedural, strong = hits(lex.procedural) > 0, adapt + mitig
    category = np.select([(adapt > 0) & (mitig > 0), adapt > 0, mitig > 0, generic & weak],
                         ["both", "adaptation", "mitigation", "both"], "unrelated")
    hazard = np.select([hits(words) > 0 for _, words in lex.hazards],
                       [name for name, _ in lex.hazards], "other")
    nothing = (strong == 0) & ~generic
    confidence = np.select([nothing & (procedural | ~weak), nothing, strong >= 2, strong == 1],
                           [0.5, 0.45, 0.9, 0.75], 0.6)
    return pd.DataFrame({
        "category": category, "confidence": confidence,
        "hazard": np.where(np.isin(category, ["adaptation", "both"]), hazard, "none")})


@query("eval_python_classifier", ("scored",), """
    SELECT seq, action_category AS y_true, coalesce(hazard_type, 'none') AS haz_true,
      category AS y_pred, hazard AS haz_pred, confidence FROM scored""")
def eval_python_classifier(spark, sf_dir):
    """Golden labels next to those of a classifier written in Python."""
    return evaluation.eval_pairs(evaluation.golden_latest(fx.golden(spark, sf_dir)),
                                 evaluation.from_python(_python_rules), ("seq",))


@query("eval_scored", ("scored",), """
    SELECT action_category AS y_true, coalesce(hazard_type, 'none') AS haz_true,
      CASE WHEN known THEN category ELSE 'unrelated' END AS y_pred,
      CASE WHEN known THEN hazard ELSE 'none' END AS haz_pred,
      CASE WHEN known THEN confidence ELSE 0.0::DOUBLE END AS confidence
    FROM (SELECT *, length(action_text) % 3 <> 0 AS known FROM scored)""")
def eval_scored(spark, sf_dir):
    """Golden labels next to predictions that were made elsewhere, for two texts in three."""
    golden = evaluation.golden_latest(fx.golden(spark, sf_dir))
    scored = golden.where(F.length("action_text") % 3 != 0).select(
        "action_text", lexicon.classify(F.col("action_text"), fx.TEST_LEXICON).alias("l")).select(
        "action_text", "l.*")
    return evaluation.eval_pairs_scored(golden, scored)


@query("eval_empty", ("golden",), f"""
    SELECT 'lexicon' AS method, count(*) AS golden_items, 'golden set is empty' AS note,
      CAST({len(ACTION_CATEGORIES)} AS BIGINT) AS categories FROM golden WHERE action_category = 'none'""")
def eval_empty(spark, sf_dir):
    """The report of a golden set that has no item left."""
    golden = evaluation.golden_latest(fx.golden(spark, sf_dir).where("action_category = 'none'"))
    tables = evaluation.evaluate(golden, _classifier(fx.TEST_LEXICON), "lexicon")
    report = evaluation.report_document(tables, "lexicon")
    return report.select(
        "method", F.get_json_object("report", "$.golden_items").cast("long").alias("golden_items"),
        F.get_json_object("report", "$.note").alias("note"), F.size(F.json_object_keys(
            F.get_json_object("report", "$.per_category"))).cast("long").alias("categories"))


@query("eval_calibration", ("scored",), _CALIBRATION_SQL)
def eval_calibration(spark, sf_dir):
    return evaluation.calibration(_cube(spark, sf_dir), "lexicon")


@query("eval_hazard", ("scored",), _HAZARD_SQL)
def eval_hazard(spark, sf_dir):
    return evaluation.hazard_accuracy(_cube(spark, sf_dir), "lexicon")


@query("method_compare", ("scored", "scored_strict"), f"""
    SELECT category, a.f1 AS lexicon, b.f1 AS strict
    FROM ({_per_category_sql('scored')}) a FULL JOIN ({_per_category_sql('scored_strict')}) b
    USING (category)""")
def method_compare(spark, sf_dir):
    first = evaluation.per_category(_cube(spark, sf_dir), "lexicon")
    second = evaluation.per_category(_cube(spark, sf_dir, fx.STRICT_LEXICON), "strict")
    return evaluation.method_compare(first, second, ("lexicon", "strict"))


def _json_entry(columns: tuple[str, ...]) -> str:
    return "json_object(" + ", ".join(f"'{c}', \"{c}\"" for c in columns) + ")"


def _json_list(select: str, key: str, columns: tuple[str, ...]) -> str:
    return f"(SELECT list({_json_entry((key, *columns))} ORDER BY {key}) FROM ({select}))"


def _json_by_name(select: str, key: str, columns: tuple[str, ...]) -> str:
    return (f"(SELECT CAST('{{' || string_agg('\"' || {key} || '\":' || CAST({_json_entry(columns)} "
            f"AS VARCHAR), ',' ORDER BY {key}) || '}}' AS JSON) FROM ({select}))")


@query("eval_report", ("scored",), f"""
    SELECT method, CAST(json_object('method', method, 'golden_items', golden_items,
      'per_category', {_json_by_name(_per_category_sql('scored'), 'category',
                                     ('precision', 'recall', 'f1', 'support'))},
      'macro_f1', macro_f1, 'accuracy', accuracy, 'human_vs_model_cohen_kappa', kappa,
      'kappa_note', '{evaluation.KAPPA_NOTE}', 'confidence_calibration',
      {_json_list(_CALIBRATION_SQL, 'bin', ('n', 'empirical_accuracy'))},
      'hazard_accuracy_exploratory', {_json_by_name(
          _HAZARD_SQL, 'hazard_type', ('correct', 'support', 'accuracy'))},
      'hazard_note', '{evaluation.HAZARD_NOTE}') AS VARCHAR) AS report
    FROM ({_OVERALL_SQL})""")
def eval_report(spark, sf_dir):
    """From one stored pass over the golden set."""
    tables = evaluation.evaluate_cube(sinks.stored(_cube(spark, sf_dir)), "lexicon")
    return evaluation.report_document(tables, "lexicon")


@query("report_files", ("scored",), f"""
    SELECT method, '20240102T000000Z' AS run_ts, macro_f1 FROM ({_OVERALL_SQL})""")
def report_files(spark, sf_dir):
    """Reports of two runs, one written twice; the newest counts."""
    root = sinks.scratch(spark)
    tables = evaluation.evaluate_cube(sinks.stored(_cube(spark, sf_dir)), "lexicon")
    report = evaluation.report_document(tables, "lexicon")
    for stamp in ("20240101T000000Z", "20240102T000000Z", "20240102T000000Z"):
        sinks.write_report(report, root, stamp)
    return sinks.latest_reports(spark, root).select(
        "method", "run_ts", F.get_json_object("report", "$.macro_f1").cast("double")
        .alias("macro_f1"))


# ---- sampling and labelling --------------------------------------------------

@query("group_sample", ("raw_tabular",), """
    SELECT r.vid_id, r.st_fips, r.meeting_date, r.place_govt FROM (
      SELECT *, st_fips || '|' || meeting_date || '|' || place_govt AS k FROM raw_tabular) r
    JOIN (
      SELECT k FROM (
        SELECT *, coalesce(sum(n) FILTER (WHERE n > 1) OVER (), 0) AS kept FROM (
          SELECT *, row_number() OVER (PARTITION BY n > 1 ORDER BY sha1('42|' || k), k) AS rk
          FROM (SELECT st_fips || '|' || meeting_date || '|' || place_govt AS k, count(*) AS n
                FROM raw_tabular GROUP BY 1))
        WHERE n = 1 OR rk <= 40)
      WHERE n > 1 OR rk <= greatest(200 - kept, 0)) USING (k)""")
def group_sample(spark, sf_dir):
    return sampling.group_preserving_sample(
        fx.raw_tabular(spark, sf_dir), ["st_fips", "meeting_date", "place_govt"]).select(
        "vid_id", "st_fips", "meeting_date", "place_govt")


_STRATA = """
    SELECT * FROM actions QUALIFY row_number() OVER (PARTITION BY action_category
      ORDER BY sha1('42|' || canonical_id || '|' || action_text)) <= 20"""


@query("stratified_sample", ("actions",), _STRATA)
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(_actions(spark, sf_dir), 80)


@query("label_candidates", ("actions", "golden"), f"""
    SELECT action_text, canonical_id, action_category, hazard_type, confidence
    FROM ({_STRATA}) WHERE action_text NOT IN (SELECT action_text FROM golden)
    QUALIFY row_number() OVER (PARTITION BY action_text ORDER BY canonical_id) = 1""")
def label_candidates(spark, sf_dir):
    return labelling.label_candidates(_actions(spark, sf_dir), fx.golden(spark, sf_dir), 80)


@query("label_codes", ("actions",), f"""
    SELECT canonical_id, action_text,
      {sql.case_map("lower(trim(substr(action_text, 1, 1)))", labelling.CATEGORY_CODES,
                    'action_category')} AS action_category,
      {sql.case_map("lower(trim(substr(action_text, 2, 1)))", labelling.HAZARD_CODES,
                    "coalesce(hazard_type, 'none')")} AS hazard_type,
      'tester' AS label_source
    FROM actions""")
def label_codes(spark, sf_dir):
    """The first two letters of an action stand in for the typed codes."""
    text = F.col("action_text")
    return labelling.label(_actions(spark, sf_dir), F.substring(text, 1, 1),
                           F.substring(text, 2, 1), "tester")
