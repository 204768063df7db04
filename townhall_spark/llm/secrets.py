"""Secret scans: candidate credentials, told apart by who else holds them.

Every text is searched for three kinds of candidates. A candidate's value, kept
only as a hash, is then counted over the whole corpus by distinct repositories and
owners. A value that several owners hold is an example that people copy
(documentation, test keys); a value of one owner that looks random is a live
credential of that owner, however many of its repositories hold it. DataFrame
functions only.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.llm.common import stored, text_or_empty


class Kind(NamedTuple):
    """A kind of candidate; ``group`` of the pattern holds its value."""

    name: str
    pattern: str
    group: int
    least: int


# The kinds, in the order in which they are listed at equal starts.
# For hex and access the least length is in the pattern: a longest run that is too
# short holds no other match. For assign it is not, as a dropped match still covers
# the text that it spans.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                   r"""([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)
# A value of so many owners is an example, and one of so many repositories that have
# at least SHARED_OWNERS owners. A value of one owner never is.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 20
SHARED_OWNERS = 2
# What a value is judged to be; spans of these follow those of the kinds.
JUDGED = ("example", "live")
# Distinct characters from which a value looks random.
RANDOM_CHARACTERS = 8

_SPAN = "struct<start:bigint,place:int,end:bigint,kind:string,value:string,random:boolean>"


def _spans(text: Column, kind: Kind, place: int) -> Column:
    """Array of a kind's spans: what lies between matches gives their positions."""
    between = F.split(text, kind.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = (F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
             if kind.group else whole)
    start = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.expr(f"cast(array() as array<{_SPAN}>)").alias("found"))

    def step(state: Column, match: Column) -> Column:
        begin = state["at"] + F.length(match["b"])
        end = begin + F.length(match["w"])
        distinct = F.size(F.array_distinct(F.split(match["v"], "", -1)))
        span = F.struct(begin.cast("bigint").alias("start"), F.lit(place).alias("place"),
                        end.cast("bigint").alias("end"), F.lit(kind.name).alias("kind"),
                        F.sha2(match["v"], 256).alias("value"),
                        (distinct >= RANDOM_CHARACTERS).alias("random"))
        keep = F.length(match["v"]) >= kind.least
        return F.struct(end.cast("bigint").alias("at"),
                        F.when(keep, F.concat(state["found"], F.array(span)))
                        .otherwise(state["found"]).alias("found"))

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("b"),
                         whole.alias("w"), value.alias("v"))
    found = F.aggregate(pairs, start, step, lambda s: s["found"])
    return F.when(text.rlike(kind.pattern), found).otherwise(
        F.expr(f"cast(array() as array<{_SPAN}>)"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``found``: its spans in order.

    A span has start and end in code points, kind, the SHA-256 of its value and
    whether the value looks random. Null and empty texts have no spans.
    """
    spans = F.concat(*[_spans(F.col("_text"), k, i) for i, k in enumerate(KINDS)])
    return (docs.withColumn("_text", text_or_empty(text)).drop(text)
            .withColumn("found", F.array_sort(spans)).drop("_text"))


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """(value, n_repositories, n_owners) over all candidates of the corpus.

    Each count is made in steps that combine before the shuffle, so a value that a
    third of all rows hold adds at most one row per task and owner. Null owners
    and repositories count as one each.
    """
    holders = found.select(
        F.explode(F.array_distinct(F.transform("found", lambda s: s["value"]))).alias("value"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"))
    return (holders.groupBy("value", "owner", "repository").agg(F.lit(1).alias("_one"))
            .groupBy("value", "owner").agg(F.count(F.lit(1)).alias("_repositories"))
            .groupBy("value").agg(F.sum("_repositories").alias("n_repositories"),
                                  F.count(F.lit(1)).alias("n_owners")))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source",
         key: str = "doc_id", text: str = "text", example_owners: int = EXAMPLE_OWNERS,
         shared_owners: int = SHARED_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES
         ) -> DataFrame:
    """One row per document: ``key``, ``found``, ``judged``, ``n_example``, ``n_live``.

    A value is an example if it has ``example_owners`` owners, or ``shared_owners`` and
    ``example_repositories`` repositories; else it is live if it looks random.
    ``n_example`` and ``n_live`` count the document's distinct values of each kind;
    ``judged`` has their spans, of kind ``example`` or ``live``. Null and empty texts have
    none. Rows of an empty table give an empty table; repeated rows each give a row; other
    columns are not read, whatever they are called.
    """
    light = docs.select(F.col(key).alias("_key"), F.col(owner).alias("_owner"),
                        F.col(repository).alias("_repository"), F.col(text).alias("_scanned"))
    found = stored(candidates(light, "_scanned"))
    some = found.where(F.size("found") > 0).withColumn(
        "_id", F.sha2(F.to_json(F.struct("_key", "found")), 256))
    counts = ownership(some, "_repository", "_owner")
    example = ((F.col("n_owners") >= example_owners)
               | ((F.col("n_owners") >= shared_owners)
                  & (F.col("n_repositories") >= example_repositories)))
    values = (some.select("_id", F.explode("found").alias("s"))
              .groupBy("_id", F.col("s.value").alias("value"))
              .agg(F.max("s.random").alias("random")))
    labelled = values.join(counts, "value").withColumn(
        "label", F.when(example, JUDGED[0]).when(F.col("random"), JUDGED[1]))

    def of(name: str) -> Column:
        return F.sum((F.coalesce("label", F.lit("")) == name).cast("long"))

    # A document's own distinct values: no more than the document has spans.
    names = F.map_from_entries(F.collect_list(F.when(
        F.col("label").isNotNull(), F.struct("value", "label"))))
    judged = labelled.groupBy("_id").agg(
        of(JUDGED[0]).alias("n_example"), of(JUDGED[1]).alias("n_live"), names.alias("labels"))

    def label(s: Column) -> Column:
        return F.element_at("labels", s["value"])

    spans = F.transform(F.filter("found", lambda s: label(s).isNotNull()), lambda s: F.struct(
        s["start"].alias("start"),
        (F.lit(len(KINDS)) + (label(s) == JUDGED[1]).cast("int")).alias("place"),
        s["end"].alias("end"), label(s).alias("kind"), s["value"].alias("value"),
        s["random"].alias("random")))
    zero = F.lit(0).cast("long")
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    return (some.join(judged, "_id")
            .select("_key", "found", spans.alias("judged"), "n_example", "n_live")
            .unionByName(found.where(F.size("found") == 0).select(
                "_key", "found", none.alias("judged"), zero.alias("n_example"),
                zero.alias("n_live")))
            .withColumnRenamed("_key", key))


def without_live(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 **options: str | int) -> DataFrame:
    """The documents that hold no live-looking credential, whole and unchanged.

    Rows are told apart by key and text, so a clean row stays although another of its
    key, or another without key, goes. Rows without text stay; repeated rows stay or go
    together; an empty table stays empty; other columns may have any name.
    """
    row = f"_{uuid.uuid4().hex}"
    told = docs.withColumn(row, F.struct(
        F.col(key).alias("key"), F.md5(text_or_empty(text)).alias("text")))
    options = {"repository": key} | options
    live = stored(scan(told, key=row, text=text, **options).where("n_live > 0")
                  .select(row).distinct())
    return told.join(live, told[row].eqNullSafe(live[row]), "left_anti").drop(row)


def digest(scanned: DataFrame) -> DataFrame:
    """The scan's result with spans as strings ``kind:start:end``, comma-joined; ``spans`` has
    the judged ones as well, each behind the candidates that start with it."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    kinds = F.transform("found", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k.name))).cast("long")
              .alias(f"n_{k.name}") for k in KINDS]
    return scanned.select("doc_id", *counts, F.sha2(joined(F.col("found")), 256)
                          .alias("base_sha256"),
                          joined(F.array_sort(F.concat("found", "judged"))).alias("spans"),
                          "n_example", "n_live")
