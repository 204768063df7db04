"""Declarative sources: a loader, a mapper and, for tabular sources, a field map.

A new tabular source is a YAML file (or a mapping), not code. ``source`` is an
open domain.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townhall_spark.functions.fields import compile_map, compile_spec
from townhall_spark.functions.ids import canonical_id
from townhall_spark.functions.text import has_text
from townhall_spark.operators import sampling
from townhall_spark.operators.segments import segments_to_meetings
from townhall_spark.schemas import RAW_SEGMENT
from townhall_spark.sources.readers import (
    jsonl_rejects,
    read_jsonl,
    read_jsonl_in_order,
    read_years,
)

SOURCES_DIR = Path(__file__).resolve().parents[1] / "config" / "sources"

# The column of arrival numbers.
SEQ = "ingest_seq"

# Arrival numbers of the i-th source start at i * 2^56.
SOURCE_SHIFT = 56


@dataclass(frozen=True)
class SourceSpec:
    """One source. ``order_column`` names a unique number that gives the arrival
    order; without it, the order of files, by path, and of their rows is used."""

    name: str
    loader: Mapping[str, Any]
    mapper: str
    field_map: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    sample: Mapping[str, Any] = field(default_factory=dict)
    source_url: str = ""
    order_column: str | None = None
    source_column: str | None = None

    @classmethod
    def from_mapping(cls, name: str, data: Mapping[str, Any]) -> SourceSpec:
        return cls(
            name=name, loader=data["loader"], mapper=data["mapper"]["type"],
            field_map=data.get("field_map", {}), sample=data.get("sample", {}),
            source_url=data.get("source_url", ""), order_column=data.get("order_column"),
            source_column=data.get("source_column"))


def load_spec(name: str, directory: str | Path = SOURCES_DIR) -> SourceSpec:
    """Spec of a YAML file."""
    import yaml

    text = (Path(directory) / f"{name}.yaml").read_text(encoding="utf-8")
    return SourceSpec.from_mapping(name, yaml.safe_load(text))


def available_sources(directory: str | Path = SOURCES_DIR) -> list[str]:
    """Names of the source files, sorted."""
    return sorted(p.stem for p in Path(directory).glob("*.yaml"))


def _load_years(spark: SparkSession, spec: SourceSpec, raw_dir: str) -> DataFrame:
    cfg = spec.loader
    return read_years(spark, f"{raw_dir}/{spec.name}", cfg["years"], cfg["known_years"],
                      cfg.get("columns"), arrival=None if spec.order_column else SEQ)


def _rows_path(spec: SourceSpec, raw_dir: str) -> str:
    return f"{raw_dir}/{spec.name}/sample.jsonl"


def _load_rows(spark: SparkSession, spec: SourceSpec, raw_dir: str) -> DataFrame:
    """Segment rows of files that are in place, whole; a sample is the spec's to ask for."""
    path, columns = _rows_path(spec, raw_dir), [f.name for f in RAW_SEGMENT]
    if spec.order_column and spec.order_column not in columns:
        schema = T.StructType([*RAW_SEGMENT, T.StructField(spec.order_column, T.LongType())])
        return read_jsonl(spark, path, schema)
    return read_jsonl_in_order(spark, path, RAW_SEGMENT, SEQ)


# Loaders read files that are already in place; they do not download.
LOADERS: dict[str, Callable[[SparkSession, SourceSpec, str], DataFrame]] = {
    "dataverse_parquet": _load_years,
    "huggingface_streaming": _load_rows,
}


def line_rejects(spark: SparkSession, specs: Sequence[SourceSpec], raw_dir: str) -> DataFrame:
    """(source, file, ingest_seq, line): lines of JSON sources that could not be parsed."""
    out = spark.createDataFrame([], "source string, file string, ingest_seq long, line string")
    for spec in specs:
        if LOADERS[spec.loader["type"]] is _load_rows:
            broken = jsonl_rejects(spark, _rows_path(spec, raw_dir), RAW_SEGMENT, SEQ)
            out = out.unionByName(broken.withColumn("source", F.lit(spec.name)))
    return out


def arrival(raw: DataFrame, spec: SourceSpec) -> Column:
    """Arrival number of a row within its source: the order column, else what the loader
    numbered, else the order of the frame's partitions."""
    if spec.order_column:
        return F.col(spec.order_column).cast("long")
    return F.col(SEQ) if SEQ in raw.columns else F.monotonically_increasing_id()


def in_scope(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    """Rows whose governing body is in scope; applied before any sampling."""
    return raw.where(compile_spec(spec.field_map["meeting_type"], raw.schema).isNotNull())


def map_fields(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    """Canonical records of raw rows: one projection, plus dropping unidentifiable rows."""
    fields = compile_map(spec.field_map, raw.schema)
    none = F.lit(None).cast("string")
    source = F.col(spec.source_column) if spec.source_column else F.lit(spec.name)

    def text(name: str) -> Column:
        return F.coalesce(fields.get(name, none).cast("string"), F.lit(""))

    mapped = raw.select(
        text("jurisdiction_name").alias("jurisdiction_name"),
        text("jurisdiction_fips").alias("jurisdiction_fips"),
        text("state").alias("state"),
        fields["meeting_date"].alias("meeting_date"),
        fields["meeting_type"].alias("meeting_type"),
        fields.get("transcript", none).alias("transcript"),
        fields.get("transcript_quality", none).cast("string").alias("tier"),
        source.alias("source"), text("source_url").alias("source_url"),
        text("source_record_id").alias("source_record_id"),
        F.col("ingest_seq").cast("long").alias("ingest_seq"))
    identified = mapped.where(
        (F.col("jurisdiction_fips") != "") & F.col("meeting_type").isNotNull()
        & F.col("meeting_date").isNotNull())
    return identified.select(
        canonical_id(F.col("jurisdiction_fips"), F.col("meeting_date"), F.col("meeting_type"))
        .alias("canonical_id"),
        "jurisdiction_name", "jurisdiction_fips", "state", "meeting_date", "meeting_type",
        "transcript",
        # A source may say that its text is a summary; without text there is none.
        F.when(~has_text(F.col("transcript")), "metadata_only")
        .when(F.col("tier") == "summary", "summary").otherwise("full_text")
        .alias("transcript_quality"),
        "source", "source_url", "source_record_id", "ingest_seq",
        F.coalesce(F.length("transcript"), F.lit(0)).cast("long").alias("transcript_chars"))


def map_tabular(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    """Scope filter, then sample, then field map."""
    rows = in_scope(raw, spec)
    sample = spec.sample
    if sample.get("strategy") == "group_preserving":
        rows = sampling.group_preserving_sample(
            rows, sample["group_keys"], sample.get("size", sampling.SAMPLE_SIZE),
            sample.get("seed", sampling.SAMPLE_SEED))
    elif sample.get("size"):
        rows = sampling.bounded(rows, sample["size"])
    return map_fields(rows, spec)


def map_segments(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    """Agenda segments, a sample of them if asked for, grouped into meetings."""
    if spec.sample.get("size"):
        raw = sampling.bounded(raw, spec.sample["size"])
    return segments_to_meetings(raw, spec.name, spec.source_url)


MAPPERS: dict[str, Callable[[DataFrame, SourceSpec], DataFrame]] = {
    "generic_tabular": map_tabular,
    "meetingbank_segments": map_segments,
}


def canonical_of(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    """Canonical records of raw rows that are already loaded."""
    return MAPPERS[spec.mapper](raw.withColumn(SEQ, arrival(raw, spec)), spec)


def run_source(spark: SparkSession, spec: SourceSpec, raw_dir: str) -> DataFrame:
    """Load and map one source."""
    return canonical_of(LOADERS[spec.loader["type"]](spark, spec, raw_dir), spec)


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Canonical records of several sources; earlier sources arrive first."""
    out = None
    for i, frame in enumerate(frames):
        shifted = frame.withColumn(
            "ingest_seq", F.col("ingest_seq") + F.lit(i << SOURCE_SHIFT).cast("long"))
        out = shifted if out is None else out.unionByName(shifted)
    if out is None:
        raise ValueError("no sources given")
    return out


def stamped(records: DataFrame) -> DataFrame:
    """Records with the time of their ingestion, the same for all of a run."""
    return records.withColumn("ingested_at", F.current_timestamp())


def ingest(spark: SparkSession, specs: Sequence[SourceSpec], raw_dir: str) -> DataFrame:
    """Canonical records of all given sources."""
    return union_sources([run_source(spark, s, raw_dir) for s in specs])


def ingest_counts(records: DataFrame) -> DataFrame:
    """Kept records per source."""
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
