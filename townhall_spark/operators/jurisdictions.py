"""Free-text jurisdiction names to FIPS codes: exact, then close spelling in the state.

Two names are close when their edits are at most a fifth of the longer one. Close
spellings are found without comparing every pair of a state: a listed name of n
letters has no more than e = n // 4 edits to any close name, so of its e + 1 pieces
one is left whole, and at nearly the same place. An equi-join on (state, length,
piece number, piece) finds every such pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.functions.text import ustrip

MIN_SIMILARITY = 0.8

# Of a listed name of n letters: its most edits, and where its piece i starts.
_EDITS = "CAST(floor({n} / 4) AS INT)"
_START = "CAST(floor({i} * {n} / ({e} + 1)) AS INT)"
_PIECE = "substring({name}, {at} + 1, {end} - {start})"


def _pieces(name: str) -> Column:
    """The pieces of a listed name."""
    n = f"length({name})"
    e = _EDITS.format(n=n)
    start, end = _START.format(i="i", n=n, e=e), _START.format(i="(i + 1)", n=n, e=e)
    piece = _PIECE.format(name=name, at=start, start=start, end=end)
    return F.expr(f"transform(sequence(0, {e}), i -> struct({n} AS len, i AS part, "
                  f"{piece} AS piece))")


def _probes(name: str) -> Column:
    """Every piece that a close listed name could share with ``name``.

    Among the whole pieces there is one with at most i edits before it and at most
    e - i behind it (more before it would leave another whole piece further on), so
    its place moves by no more than that, counted from either end.
    """
    e = _EDITS.format(n="n")
    start, end = _START.format(i="i", n="n", e=e), _START.format(i="(i + 1)", n="n", e=e)
    piece = _PIECE.format(name=name, at=f"{start} + shift", start=start, end=end)
    delta = f"length({name}) - n"
    shifts = (f"filter(sequence(-{e}, {e}), s -> {start} + s >= 0 AND abs(s) <= i "
              f"AND abs(s - ({delta})) <= {e} - i)")
    longest = f"CAST(floor(length({name}) / {MIN_SIMILARITY}) AS INT)"
    shortest = f"CAST(ceil(length({name}) * {MIN_SIMILARITY}) AS INT)"
    lengths = f"filter(sequence({shortest}, {longest}), l -> l > 0)"
    return F.expr(
        f"array_distinct(flatten(flatten(transform({lengths}, n -> transform(sequence(0, {e}), "
        f"i -> transform({shifts}, shift -> struct(n AS len, i AS part, {piece} AS piece)))))))")


def _key(name: Column) -> Column:
    return F.lower(ustrip(name))


def _close(unresolved: DataFrame, listed: DataFrame) -> DataFrame:
    """Best listed name within the limits, per (name, state)."""
    probes = unresolved.select("jurisdiction_name", "state", "_key",
                               F.explode(_probes("_key")).alias("p"))
    pieces = listed.select("state", "_listed", "fips", F.explode(_pieces("_listed")).alias("p"))
    candidates = probes.join(pieces, ["state", "p"]).select(
        "jurisdiction_name", "state", "_key", "_listed", "fips").distinct()
    distance = F.levenshtein("_key", "_listed")
    longer = F.greatest(F.length("_key"), F.length("_listed"))
    return (candidates.withColumn("edits", distance)
            .where(F.lit(1.0) - F.col("edits") / longer >= MIN_SIMILARITY)
            .groupBy("jurisdiction_name", "state")
            .agg(F.min(F.struct("edits", "_listed", "fips")).alias("best"))
            .select("jurisdiction_name", "state", F.col("best.fips").alias("_close")))


def resolve_jurisdictions(records: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(jurisdiction_name, state, fips, match) for each distinct name and state.

    ``match`` is ``exact``, ``close`` or null; a name that is not confidently
    the same stays unresolved. The state keeps equal names apart.
    """
    names = records.select("jurisdiction_name", "state").distinct().withColumn(
        "_key", _key(F.col("jurisdiction_name")))
    listed = crosswalk.groupBy(_key(F.col("jurisdiction_name")).alias("_listed"), "state").agg(
        F.min("fips").alias("fips"))
    exact = listed.select(F.col("_listed").alias("_key"), "state", F.col("fips").alias("_exact"))
    found = names.join(exact, ["_key", "state"], "left")
    close = _close(found.where(F.col("_exact").isNull()), listed)
    return found.join(close, ["jurisdiction_name", "state"], "left").select(
        "jurisdiction_name", "state", F.coalesce("_exact", "_close").alias("fips"),
        F.when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_close").isNotNull(), "close").alias("match"))
