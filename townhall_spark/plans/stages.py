"""The stages as jobs that hand tables over through a work directory.

Each stage reads the tables of the one before it, so lineage is cut by a
written table, a lost executor costs tasks and not stages, and later stages
read only the columns they need. Every stage replaces its own output; tables that
belong together are published as one set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townhall_spark.functions.domains import (
    ACTION_RULES,
    MEETING_RULES,
    check_domain,
    nan_to_null,
)
from townhall_spark.functions.lexicon import LEXICON_VERSION, Lexicon
from townhall_spark.operators import (
    evaluation,
    exposure,
    extraction,
    linking,
    responses,
    sampling,
    summaries,
    text_parts,
)
from townhall_spark.schemas import CANONICAL_MEETING, COUNTY_RISK, GOLDEN
from townhall_spark.sources import readers, sinks, specs


def ingest(spark: SparkSession, sources: Sequence[specs.SourceSpec], raw_dir: str,
           work_dir: str, jsonl: bool = False) -> DataFrame:
    """Writes ``canonical``, ``canonical_rejects`` (records out of their domains) and
    ``line_rejects`` (lines that could not be parsed); returns kept rows per source."""
    records = specs.stamped(specs.ingest(spark, sources, raw_dir))
    sinks.write_parquet(records.select(*CANONICAL_MEETING.names), f"{work_dir}/canonical")
    stored = spark.read.parquet(f"{work_dir}/canonical")
    _, rejects = check_domain(stored, MEETING_RULES)
    sinks.write_parquet(rejects, f"{work_dir}/canonical_rejects")
    sinks.write_parquet(specs.line_rejects(spark, sources, raw_dir), f"{work_dir}/line_rejects")
    if jsonl:
        sinks.write_jsonl(stored, f"{work_dir}/canonical_jsonl")
    return specs.ingest_counts(stored)


def link(spark: SparkSession, work_dir: str, resolve_conflicts: bool = False) -> DataFrame:
    """Publishes ``meetings``, ``provenance`` and ``conflicts`` as one set; returns the overlap
    statistics. Conflicts may be resolved by vote."""
    records = _records(spark, work_dir)
    resolved = linking.resolve(records)
    if resolve_conflicts:
        resolved = resolved._replace(conflicts=linking.conflicts_resolved(records))
    tables = sinks.publish(spark, {
        "meetings": resolved.meetings, "provenance": resolved.links,
        "conflicts": resolved.conflicts}, f"{work_dir}/linked")
    return linking.overlap_stats(tables["provenance"], tables["conflicts"])


def linked(spark: SparkSession, work_dir: str) -> dict[str, DataFrame]:
    """The tables of the last run of :func:`link` that came to its end."""
    return sinks.published(spark, f"{work_dir}/linked")


def _records(spark: SparkSession, work_dir: str, limit: int = 0) -> DataFrame:
    """Valid canonical records; with ``limit``, those of the meetings that appear first."""
    records, _ = check_domain(spark.read.parquet(f"{work_dir}/canonical"), MEETING_RULES)
    if not limit:
        return records
    first = sampling.bounded(linked(spark, work_dir)["meetings"], limit, "first_seq")
    return records.join(first.select(linking.KEY), linking.KEY, "left_semi")


def extract(spark: SparkSession, work_dir: str, lexicon: Lexicon,
            version: str = LEXICON_VERSION, limit: int = 0) -> DataFrame:
    """Writes ``actions``; returns their number per category."""
    sinks.write_parquet(
        extraction.extract_actions(_records(spark, work_dir, limit), lexicon, version),
        f"{work_dir}/actions")
    return summaries.category_counts(spark.read.parquet(f"{work_dir}/actions"))


def transcript_parts(spark: SparkSession, work_dir: str, limit: int = 0) -> DataFrame:
    """Writes ``transcript_parts``, the ordered texts of every meeting, and returns them."""
    sinks.write_parquet(linking.transcript_parts(_records(spark, work_dir, limit)),
                        f"{work_dir}/transcript_parts")
    return spark.read.parquet(f"{work_dir}/transcript_parts")


def transcripts(spark: SparkSession, work_dir: str, limit: int = 0) -> DataFrame:
    """Writes ``transcripts``, the merged text of every meeting with text, joined from
    ``transcript_parts``, and returns it."""
    parts = transcript_parts(spark, work_dir, limit)
    sinks.write_parquet(text_parts.joined(parts, [linking.KEY]).withColumnRenamed(
        "text", "transcript"), f"{work_dir}/transcripts")
    return spark.read.parquet(f"{work_dir}/transcripts")


def prompts(spark: SparkSession, work_dir: str, limit: int = 0) -> DataFrame:
    """Writes ``prompts`` for an external model, windows over all text, and returns them."""
    sinks.write_parquet(extraction.prompt_windows(transcript_parts(spark, work_dir, limit)),
                        f"{work_dir}/prompts")
    return spark.read.parquet(f"{work_dir}/prompts")


def collect_responses(spark: SparkSession, answered: DataFrame, work_dir: str,
                      version: str) -> DataFrame:
    """Writes ``actions_model``, ``action_rejects`` (actions outside of their domains) and
    ``response_rejects`` of (canonical_id, raw) rows."""
    actions, rejects = check_domain(
        nan_to_null(responses.parse_responses(answered, version)), ACTION_RULES)
    sinks.write_tables({
        "actions_model": actions.withColumn("extracted_at", F.current_timestamp()),
        "action_rejects": rejects,
        "response_rejects": responses.response_rejects(answered)}, work_dir)
    return summaries.category_counts(spark.read.parquet(f"{work_dir}/actions_model"))


def build_county_table(spark: SparkSession, wide_csv: str, out_csv: str) -> DataFrame:
    """Writes the used columns of the wide county file; fails when it is missing."""
    wide = spark.read.option("header", True).csv(wide_csv)
    (exposure.slim_counties(wide).write.mode("overwrite").option("header", True)
     .csv(out_csv))
    return readers.read_counties(spark, out_csv)


def analyze(spark: SparkSession, work_dir: str, counties_csv: str | None = None,
            places_csv: str | None = None,
            fixed: Mapping[str, str] = exposure.CITY_COUNTY) -> dict[str, DataFrame]:
    """Publishes the summary tables as one set under ``analysis``, with exposure when the
    county table exists; returns them as stored. What they are computed from, the exposure
    of meetings and counts a meeting, is published with them."""
    meetings = linked(spark, work_dir)["meetings"]
    actions = spark.read.parquet(f"{work_dir}/actions")
    with sinks.Publication(spark, f"{work_dir}/analysis") as out:
        exposed = None
        if counties_csv and readers.exists(spark, counties_csv, "text"):
            counties = readers.read_csv(spark, counties_csv, COUNTY_RISK)
            places = readers.read_place_to_county(spark, places_csv) if places_csv else None
            exposed = out.write("exposure", exposure.enrich(meetings, counties, places, fixed))
        counts = out.write("meeting_counts", summaries.meeting_counts(meetings, actions))
        tables = summaries.build_all(meetings, actions, exposed, counts)
        return {name: out.write(name, table) for name, table in tables.items()}


def evaluate(spark: SparkSession, golden_jsonl: str, classifier: evaluation.Classifier,
             method: str, reports_dir: str, run_ts: str) -> dict[str, DataFrame]:
    """Scores a classifier, adds its report to the report table, returns the tables.

    Golden rows are classified once, into a small stored cube that every table
    is computed from. A missing golden set scores as an empty one.
    """
    if readers.exists(spark, golden_jsonl, "text"):
        golden = readers.read_jsonl_in_order(spark, golden_jsonl, GOLDEN, "_line")
    else:
        golden = readers.read_or_empty(spark, [], GOLDEN).withColumn(
            "_line", F.lit(None).cast("long"))
    golden = golden.withColumn("seq", F.struct("labelled_at", "_line")).drop("_line")
    pairs = evaluation.eval_pairs(evaluation.golden_latest(golden), classifier)
    cube_path = f"{reports_dir}_cubes/{method}/{run_ts}"
    sinks.write_parquet(evaluation.score_cube(pairs), cube_path)
    tables = evaluation.evaluate_cube(spark.read.parquet(cube_path), method)
    sinks.write_report(evaluation.report_document(tables, method), reports_dir, run_ts)
    return tables
