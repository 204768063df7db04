"""Readers with explicit schemas; Spark does the scanning and pruning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townhall_spark.functions.domains import MEETING_RULES, check_domain
from townhall_spark.functions.text import ustrip
from townhall_spark.operators.ordering import numbered
from townhall_spark.schemas import CANONICAL_MEETING, COUNTY_RISK, PLACE_TO_COUNTY, ROW_ORDER
from townhall_spark.sources.sinks import stored

# Files, or blocks of files, whose numbers are sent to all tasks: some 100 bytes each.
SENT_FILES = 1 << 20

# Slashes after a scheme come in different numbers.
_SCHEME = r"^(\w+):/+"


def nullable(schema: T.StructType) -> T.StructType:
    """The schema with every field nullable, as files may hold anything."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def read_columns(spark: SparkSession, path: str | Sequence[str],
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table, only the given columns."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; without a schema Spark infers one from all lines."""
    reader = spark.read if schema is None else spark.read.schema(nullable(schema))
    return reader.json(path)


# A line that its schema does not fit.
_BROKEN = "_broken"


def _parsed(line: Column, schema: T.StructType) -> Column:
    """A JSON line as a struct of the schema and ``_broken``, the line if it does not fit.

    It is generated, as a row of its own: filters on its fields stay behind it, and a line
    is parsed once.

    Every field is parsed, whichever are used later: a reader of files would parse only
    those, and a line be broken or not by what is selected. The parser stops behind the
    object; what follows it makes the line a broken one.
    """
    fields = T.StructType([*nullable(schema), T.StructField(_BROKEN, T.StringType())])
    return F.explode(F.array(F.when(F.endswith(ustrip(line), F.lit("}")), F.from_json(
        line, fields, {"columnNameOfCorruptRecord": _BROKEN})).otherwise(
        F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields.fields[:-1]],
                 line.alias(_BROKEN)))))


def read_canonical(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) canonical records of a JSONL file.

    Rejected ones have their ``violations``, and a line that is no JSON object of the
    schema, which counts as one (``line``), verbatim as ``line``.
    """
    records = spark.read.text(path).where(F.trim("value") != "").select(
        _parsed(F.col("value"), CANONICAL_MEETING).alias("r")).select("r.*")
    rules = {"line": lambda: F.col(_BROKEN).isNotNull(), **MEETING_RULES}
    valid, rejects = check_domain(records, rules)
    return valid.drop(_BROKEN), rejects.withColumnRenamed(_BROKEN, "line")


def _starts(sizes: DataFrame) -> DataFrame:
    """(_frame, _file, _start): the first number of each file, by frame and path.

    ``sizes`` (_frame, _file, _size) may list any number of files; they are ranked and
    summed in slices, and none comes to the driver.
    """
    return stored(numbered(sizes, [], ["_frame", "_file"], "_size").select(
        "_frame", "_file", F.col("_before").alias("_start")))


def _sent(table: DataFrame) -> DataFrame:
    """A stored table of files or blocks, sent to all tasks if it has few enough rows.

    Beyond that, Spark joins by shuffling the rows that were read.
    """
    return F.broadcast(table) if table.count() <= SENT_FILES else table


def in_file_order(frames: Sequence[DataFrame], name: str = "ingest_seq") -> list[DataFrame]:
    """Parquet frames with the arrival number of each row: the rows before it.

    Files count in the order of the frames and, inside a frame, of their paths. The
    order does not depend on how Spark packs files into tasks. Counting a file's rows
    reads no column.
    """
    place = F.col("_metadata.row_index")
    sizes = None
    for i, frame in enumerate(frames):
        rows = frame.select(_file().alias("_file"), place.alias("_place")).groupBy("_file").agg(
            (F.max("_place") + 1).alias("_size")).select(F.lit(i).alias("_frame"), "_file", "_size")
        sizes = rows if sizes is None else sizes.unionByName(rows)
    if sizes is None:
        return []
    starts = _starts(sizes)
    return [frame.select("*", _file().alias("_file"), place.alias("_place"))
            .join(_sent(starts.where(F.col("_frame") == i).drop("_frame")), "_file")
            .withColumn(name, F.col("_start") + F.col("_place"))
            .drop("_file", "_place", "_start") for i, frame in enumerate(frames)]


def _file() -> Column:
    """A row's file, spelled the same by every reader."""
    return F.regexp_replace("_metadata.file_path", _SCHEME, "$1:/")


def _lines(spark: SparkSession, path: str, schema: T.StructType, name: str) -> DataFrame:
    """(_row, _file, _raw_line, name): every line that is not blank, parsed, with its number.

    A line's place in its file is where its block of the file starts plus its place in
    the block, which rises along the file however Spark cuts it.
    """
    lines = spark.read.text(path).select(
        "value", _file().alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))
    blocks = stored(lines.groupBy("_file", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")))
    starts = _starts(blocks.groupBy("_file").agg(
        F.max(F.col("_block") + F.col("_rows")).alias("_size"))
        .select(F.lit(0).alias("_frame"), "_file", "_size")).drop("_frame")
    places = stored(blocks.drop("_rows").join(starts, "_file"))
    number = F.col("_start") + F.col("_block") + F.col("_id") - F.col("_first")
    parsed = _parsed(F.col("value"), schema)
    return (lines.join(_sent(places), ["_file", "_block"])
            .where(F.trim("value") != "")
            .select(parsed.alias("_row"), "_file", F.col("value").alias("_raw_line"),
                    number.alias(name)))


def read_jsonl_in_order(spark: SparkSession, path: str, schema: T.StructType,
                        name: str = "ingest_seq") -> DataFrame:
    """JSON lines of a declared schema with the arrival number of each line.

    Numbers rise by file and line and may have gaps. Blank lines are left out, and so
    are broken ones, which :func:`jsonl_rejects` returns.
    """
    return (_lines(spark, path, schema, name).where(F.col(f"_row.{_BROKEN}").isNull())
            .select(*[F.col(f"_row.`{f}`").alias(f) for f in schema.names], name))


def jsonl_rejects(spark: SparkSession, path: str, schema: T.StructType,
                  name: str = "ingest_seq") -> DataFrame:
    """(file, ``name``, line): the lines that are no JSON object of the schema, or have more
    text behind it, verbatim, each with its file and the arrival number it would have had."""
    return (_lines(spark, path, schema, name).where(F.col(f"_row.{_BROKEN}").isNotNull())
            .select(F.col("_file").alias("file"), name, F.col("_raw_line").alias("line")))


def union_years(frames: Mapping[int, DataFrame], years: Sequence[int | str]) -> DataFrame:
    """The frames of the requested years that there are, in the order of the request."""
    found = [frames[int(y)] for y in years if int(y) in frames]
    if not found:
        raise ValueError(f"no known year among {list(years)}")
    out = found[0]
    for frame in found[1:]:
        out = out.unionByName(frame)
    return out


def read_years(spark: SparkSession, root: str, years: Sequence[int | str],
               known: Sequence[int | str], columns: Sequence[str] | None = None,
               pattern: str = "meetings.{year}.parquet", arrival: str | None = None) -> DataFrame:
    """Yearly parquet files of the requested years that are known.

    Only the files of requested years are listed. ``arrival`` names a column for the
    rows' arrival numbers, in the order of years, files and rows.
    """
    wanted = [int(y) for y in years if int(y) in {int(k) for k in known}]
    frames = [spark.read.parquet(f"{root}/{pattern.format(year=y)}") for y in wanted]
    if arrival:
        frames = in_file_order(frames, arrival)
    if columns:
        frames = [f.select(*columns, *[arrival] * bool(arrival)) for f in frames]
    return union_years(dict(zip(wanted, frames, strict=True)), years)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; the schema's columns are found by name, others are not parsed.

    ``row_order`` is a sortable place of each row, by path, block and row.
    """
    header = spark.read.option("header", True).csv(path)
    columns = []
    for field in schema.fields:
        if field.name in header.columns:
            column = F.col(f"`{field.name}`").try_cast(field.dataType)
        else:
            column = F.lit(None).cast(field.dataType)
        columns.append(column.alias(field.name))
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                     F.monotonically_increasing_id().alias("row"))
    return header.select(*columns, order.alias(ROW_ORDER))


def read_counties(spark: SparkSession, path: str) -> DataFrame:
    """County risk table; county codes stay text."""
    return read_csv(spark, path, COUNTY_RISK)


def exists(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """Whether a table can be opened at ``path``."""
    try:
        spark.read.format(fmt).load(path)
    except AnalysisException:
        return False
    return True


def read_or_empty(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType,
                  fmt: str = "parquet") -> DataFrame:
    """The first of the paths that exists, else an empty table of the same schema."""
    for path in [paths] if isinstance(paths, str) else paths:
        if exists(spark, path, "text" if fmt == "csv" else fmt):
            if fmt == "csv":
                return read_csv(spark, path, schema)
            reader = spark.read.format(fmt)
            if fmt == "json":
                reader = reader.schema(nullable(schema))
            return reader.load(path)
    return spark.createDataFrame([], nullable(schema))


def read_place_to_county(spark: SparkSession, path: str) -> DataFrame:
    """Optional place-to-county table, all text; empty when there is no file."""
    return read_or_empty(spark, path, PLACE_TO_COUNTY, "csv")
