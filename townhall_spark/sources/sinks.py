"""Sinks. Overwrites and runs are idempotent; sets of tables are published at once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """A path and its file system, whatever store it is in."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Writes beside ``path`` and then takes its place, so that a run that fails while it
    writes leaves what was there, and the frame may read it.

    Where renaming a folder is one step, as on HDFS, the new table is there at once; on an
    object store it is a copy, and a :class:`Publication` does without.
    """
    path, mark = path.rstrip("/"), uuid.uuid4().hex
    new, fs = _path(spark, f"{path}.new-{mark}")
    target, old = _path(spark, path)[0], _path(spark, f"{path}.old-{mark}")[0]
    try:
        write(f"{path}.new-{mark}")
    except BaseException:
        fs.delete(new, True)
        raise
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(new, target):
        raise OSError(f"cannot move {new.toString()} to {path}")
    fs.delete(old, True)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """One parquet table, in place of the one that is there."""
    _replace(df.sparkSession, path, lambda to: df.write.partitionBy(*partition_by).parquet(to))


# Scratch folders made by this process, by application.
_MADE: dict[str, list[str]] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is missing a temporary folder does on a local master; on a
    cluster that would be one machine's disk, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="townhall-")
    path = f"{base.rstrip('/')}/townhall-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the scratch folders that this application has made; returns their number.

    Tables that were read from them cannot be read any more, so write what is wanted
    first. It works in any store that Spark writes to.
    """
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        folder, fs = _path(spark, path)
        fs.delete(folder, True)
    return len(made)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to a scratch folder and read back: lineage ends here.

    What reads it later is not computed again, and a lost executor costs only the
    tasks that read it. The write runs when this is called.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, in place of those that are there; null fields are written, not dropped."""
    _replace(df.sparkSession, path,
             lambda to: df.write.option("ignoreNullFields", False).json(to))


def write_tables(tables: Mapping[str, DataFrame], root: str) -> None:
    """One parquet table per name."""
    for name, table in tables.items():
        write_parquet(table, f"{root}/{name}")


def new_run() -> str:
    """A run's or version's name: names of later ones sort behind."""
    return f"{datetime.now(UTC):%Y%m%dT%H%M%S%fZ}-{uuid.uuid4().hex[:8]}"


class Publication:
    """A set of tables that readers see all at once, or not at all.

    Tables go to a folder of a new version. Only when the block ends without an error is
    the version named in the manifest, by one file that Spark moves into place; readers
    follow the newest name. A run that fails leaves the last set readable, and a reader
    never sees half of one. ::

        with Publication(spark, root) as out:
            counts = out.write("counts", df)    # stored, and read back
    """

    def __init__(self, spark: SparkSession, root: str, version: str | None = None):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version or new_run()
        self.names: list[str] = []

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/versions/{self.version}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Publication:
        return self

    def __exit__(self, error: type[BaseException] | None, *_: object) -> None:
        if error is None:
            names = F.array(*map(F.lit, self.names))
            (self.spark.range(1, numPartitions=1)
             .select(F.lit(self.version).alias("version"), names.alias("names"))
             .write.mode("append").json(f"{self.root}/manifest"))


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], root: str,
            version: str | None = None) -> dict[str, DataFrame]:
    """The tables as one set, as stored."""
    with Publication(spark, root, version) as out:
        return {name: out.write(name, table) for name, table in tables.items()}


def published(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """The newest published set, or that of a version, by name."""
    manifest = spark.read.schema("version string, names array<string>").json(
        f"{root.rstrip('/')}/manifest")
    if version:
        manifest = manifest.where(F.col("version") == version)
    newest = manifest.agg(F.max(F.struct("version", "names")).alias("s")).first().s
    if newest is None:
        raise ValueError(f"no published tables at {root}")
    return {name: spark.read.parquet(f"{root.rstrip('/')}/versions/{newest.version}/{name}")
            for name in newest.names}


def append_labels(labels: DataFrame, path: str, run: str | None = None,
                  skip_known: bool = False) -> None:
    """Add golden labels, stamped with their run, to a JSONL golden set.

    A run has a partition of its own and replaces it, so a run that is tried again adds
    nothing twice; without ``run`` every call is a new one. Names of later runs must sort
    behind, as those of :func:`new_run` do: files are read by path, so labels come by
    run. ``labelled_at`` is the time in the run's name, else the present one. With
    ``skip_known`` texts that other runs have labelled are left out.
    """
    spark, run = labels.sparkSession, run or new_run()
    if skip_known and exists_json(spark, path):
        known = (spark.read.schema("action_text string, run string").json(path)
                 .where(F.col("run") != run).select("action_text").distinct())
        labels = labels.join(known, "action_text", "left_anti").select(*labels.columns)
    named = F.try_to_timestamp(F.lit(run[:15]), F.lit("yyyyMMdd'T'HHmmss"))
    (labels.withColumn("labelled_at", F.coalesce(named, F.current_timestamp()))
     .withColumn("run", F.lit(run)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False)
     .partitionBy("run").json(path))


def exists_json(spark: SparkSession, path: str) -> bool:
    """Whether JSON lines can be opened at ``path``."""
    try:
        spark.read.schema("run string").json(path)
    except AnalysisException:
        return False
    return True


def write_report(report: DataFrame, root: str, run_ts: str) -> None:
    """Put a run's (method, report) rows into the report table.

    A run replaces its own earlier rows and no others.
    """
    (report.withColumn("run_ts", F.lit(run_ts))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("method", "run_ts").json(root))


def reports(spark: SparkSession, root: str) -> DataFrame:
    """(report, method, run_ts) of every run."""
    return spark.read.schema("report string, method string, run_ts string").json(root)


def newest_report(spark: SparkSession, root: str) -> DataFrame:
    """The newest report of any method."""
    return reports(spark, root).orderBy(F.desc("run_ts"), "method").limit(1)


def latest_reports(spark: SparkSession, root: str) -> DataFrame:
    """(method, run_ts, report): the newest report of every method."""
    return reports(spark, root).groupBy("method").agg(
        F.max("run_ts").alias("run_ts"), F.max_by("report", "run_ts").alias("report"))
