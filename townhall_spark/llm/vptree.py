"""Approximate nearest neighbours with vantage-point trees.

Vectors are dealt to the nearest of some pivots, and each pivot's cell to shards of
bounded size. A shard's tree splits its vectors, node by node, at the median distance to
a vantage point. A query skips the side of a node that the triangle inequality shows to
be too far: beyond ``1 / factor`` of the distance of its worst neighbour so far. With
factor 1 nothing that could be nearer is skipped and the search is exact; larger
factors skip more.

A query first searches the cell of its own pivot. What it finds there bounds how far its
neighbours can be, and it goes on only to cells whose distances from their pivot are
within that reach, by the same inequality. The trees are written once; they meet
queries in blocks of bounded size, those of a cell only.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townhall_spark.llm.common import stored
from townhall_spark.operators.skew import top_k_per_group

SHARD_VECTORS = 4096
QUERY_BLOCK = 2048
LEAF = 64
# Cells at most; their pivots go to every task.
PIVOTS = 1024


class Node(NamedTuple):
    """Vectors ``low`` to ``high``: a leaf, or a vantage point first, then near, then far."""

    low: int
    high: int
    middle: int
    radius: float
    near: int
    far: int


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed in the order of components."""
    out = np.zeros((len(queries), len(vectors)))
    for c in range(queries.shape[1]):
        gap = queries[:, c, None] - vectors[None, :, c]
        gap *= gap
        out += gap
    return np.sqrt(out)


class Tree:
    """A vantage-point tree over the vectors of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 11):
        self.ids, self.vectors = ids, vectors
        self.nodes: list[Node] = []
        rng = np.random.default_rng(seed)
        place = np.arange(len(ids))
        self._split(place, 0, len(ids), rng)
        self.ids, self.vectors = self.ids[place], self.vectors[place]

    def _split(self, place: np.ndarray, low: int, high: int, rng: np.random.Generator) -> int:
        node = len(self.nodes)
        self.nodes.append(Node(low, high, high, 0.0, -1, -1))
        if high - low <= LEAF:
            return node
        pick = int(rng.integers(low, high))
        place[low], place[pick] = place[pick], place[low]
        rest = place[low + 1:high]
        d = distances(self.vectors[place[low]][None], self.vectors[rest])[0]
        rest[:] = rest[np.argsort(d, kind="stable")]
        d.sort()
        middle = low + 1 + len(rest) // 2
        radius = float(d[len(rest) // 2])
        near = self._split(place, low + 1, middle, rng)
        far = self._split(place, middle, high, rng)
        self.nodes[node] = Node(low, high, middle, radius, near, far)
        return node

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float,
               bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of each query's nearest, its own id left out; inf where fewer.

        With ``bounds`` nothing farther than a query's bound is looked for.
        """
        if bounds is None:
            bounds = np.full(len(queries), np.inf)
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), np.iinfo(np.int64).max)

        def offer(rows: np.ndarray, low: int, high: int) -> np.ndarray:
            d = distances(queries[rows], self.vectors[low:high])
            ids = np.broadcast_to(self.ids[low:high], d.shape)
            every = np.hstack([best[rows], np.where(ids == query_ids[rows, None], np.inf, d)])
            named = np.hstack([found[rows], ids])
            order = np.lexsort((named, every), axis=1)[:, :k]
            best[rows] = np.take_along_axis(every, order, 1)
            found[rows] = np.take_along_axis(named, order, 1)
            return d[:, 0]

        def visit(at: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            node = self.nodes[at]
            if node.near < 0:
                offer(rows, node.low, node.high)
                return
            d = offer(rows, node.low, node.low + 1)
            inside = d < node.radius
            visit(node.near, rows[inside])
            visit(node.far, rows[~inside])
            reach = np.minimum(best[rows, -1], bounds[rows]) / factor
            visit(node.far, rows[inside & (d + reach >= node.radius)])
            visit(node.near, rows[~inside & (d - reach <= node.radius)])

        visit(0, np.arange(len(queries)))
        return best, found


def _usable(vector: str) -> Column:
    """Whether a vector has components, all finite, and is not zero."""
    return (F.col(vector).isNotNull() & (F.size(vector) > 0)
            & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                       & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(vector, lambda x: x != 0))


def _unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and bounds, by id and then by components."""
    ids = np.array(rows.column("id").to_pylist(), np.int64)
    vectors = np.array(rows.column("vector").to_pylist(), np.float64)
    order = np.lexsort((*vectors.T[::-1], ids))
    return ids[order], vectors[order], rows.column("bound").to_numpy()[order]


def _blob(key: tuple, names: list[str], value: object) -> pa.Table:
    numbers = [pa.array([k.as_py()], pa.int32()) for k in key]
    return pa.table([*numbers, pa.array([pickle.dumps(value)], pa.binary())], names=names)


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    ids, vectors, _ = _unpack(rows)
    return _blob(key, ["dim", "cell", "shard", "tree"], Tree(ids, vectors))


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    return _blob(key, ["dim", "cell", "block", "queries"], _unpack(rows))


def _search(k: int, factor: float):
    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        columns = ([], [], [])
        if len(shard) and len(block):
            tree = pickle.loads(shard.column("tree")[0].as_py())
            query_ids, queries, bounds = pickle.loads(block.column("queries")[0].as_py())
            best, found = tree.search(query_ids, queries, k, factor, bounds)
            real = np.isfinite(best)
            columns = (np.repeat(query_ids, real.sum(axis=1)), found[real], best[real])
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                         pa.array(columns[2], pa.float64())],
                        names=["query_id", "vec_id", "score"])
    return run


class Pivots(NamedTuple):
    """Per dimension the vectors that cells are around; at most ``PIVOTS``, or one a dimension."""

    of: dict[int, np.ndarray]

    def home(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, vector, dim, bound) with their cell and distance to its pivot."""
        of = self.of

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column(2).to_numpy()
                cells, gaps = np.zeros(len(dims), np.int32), np.zeros(len(dims))
                vectors = batch.column(1).to_pylist()
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    far = distances(np.array([vectors[i] for i in at]), of[int(dim)])
                    cells[at] = far.argmin(axis=1)
                    gaps[at] = far.min(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cells), pa.array(gaps)],
                    ["id", "vector", "dim", "bound", "cell", "gap"])
        return rows.mapInArrow(run, f"{_ROW}, cell int, gap double")

    def reached(self, rows: DataFrame, balls: dict[int, np.ndarray], factor: float) -> DataFrame:
        """``rows`` once for each cell, other than their own, that may hold what is nearer than
        their bound. ``balls`` has the least and the largest distance in each cell."""
        of = self.of

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, vector in enumerate(batch.column(1).to_pylist()):
                    dim, bound, home = (batch.column(c)[i].as_py() for c in (2, 3, 4))
                    far = distances(np.array([vector]), of[dim])[0]
                    low, high = balls[dim].T
                    # Rounding must not lose a cell at the very edge.
                    slack = 1e-9 * (1 + far)
                    near = np.maximum(far - high, low - far) <= bound / factor + slack
                    near[home] = False
                    cells = np.flatnonzero(near & (high >= low)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array([batch.column(c)[i].as_py()] * len(cells), batch.column(c).type)
                           for c in range(4)], pa.array(cells)],
                        ["id", "vector", "dim", "bound", "cell"])
        return rows.mapInArrow(run, f"{_ROW}, cell int")


_ROW = "id long, vector array<double>, dim int, bound double"


def _pivots(rows: DataFrame, most: int) -> Pivots:
    """The vectors of least hash of each dimension; the sample is bounded by ``most``."""
    sizes = rows.groupBy("dim").count().count()
    each = max(1, most // max(1, sizes))
    chosen = top_k_per_group(rows, ["dim"], [F.xxhash64("vector"), F.col("id")], each, F.col("id"))
    found: dict[int, list] = {}
    for r in chosen.select("dim", "vector").collect():
        found.setdefault(r["dim"], []).append(r["vector"])
    return Pivots({dim: np.unique(np.array(v), axis=0) for dim, v in found.items()})


def _dealt(rows: DataFrame, name: str, size: int) -> DataFrame:
    """``rows`` with the part of their cell, of about ``size`` rows, as column ``name``."""
    parts = rows.groupBy("dim", "cell").agg(
        F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    return rows.join(F.broadcast(parts), ["dim", "cell"]).withColumn(
        name, F.pmod(F.xxhash64("id", "vector"), F.col("parts")).cast("int"))


def _meet(trees: DataFrame, asking: DataFrame, k: int, factor: float, query_block: int) -> DataFrame:
    """(query_id, vec_id, score): queries against all trees of the cells they ask, by blocks."""
    packed = stored(_dealt(asking, "block", query_block).groupBy("dim", "cell", "block")
                    .applyInArrow(_pack, "dim int, cell int, block int, queries binary"))
    # One tree and one block meet in a task; only those of one cell are paired.
    keys = ["dim", "cell", "shard", "block"]
    left = trees.join(packed.select("dim", "cell", "block"), ["dim", "cell"]).select(*keys, "tree")
    right = packed.join(trees.select("dim", "cell", "shard"), ["dim", "cell"]).select(
        *[F.col(c).alias(c) for c in [*keys, "queries"]])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _search(k, factor), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0,
           key: str = "vec_id", vector: str = "embedding",
           shard_vectors: int = SHARD_VECTORS, query_block: int = QUERY_BLOCK,
           pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest among ``vectors``.

    Nearest first, ties to the smaller id; rows of the query's id are no candidates.
    Rows without id and vectors that are null, empty, zero or not finite take no
    part, and vectors meet those of their own dimension. Equal rows count once. An
    empty table gives an empty table; other columns are not read. ``pivots`` bounds the
    cells, of which there is one for each ``shard_vectors`` vectors up to that. The first
    of the two searches runs when the operator is called.
    """
    def usable(df: DataFrame) -> DataFrame:
        return df.where(F.col(key).isNotNull() & _usable(vector)).select(
            F.col(key).cast("long").alias("id"),
            F.col(vector).cast("array<double>").alias("vector"),
            F.size(vector).alias("dim"), F.lit(float("inf")).alias("bound")).distinct()

    rows, asked = stored(usable(vectors)), stored(usable(queries))
    chosen = _pivots(rows, min(pivots, math.ceil(rows.count() / shard_vectors)))
    # Vectors of a dimension without candidates have nothing to find.
    known = [int(d) for d in chosen.of]
    placed = stored(chosen.home(rows))
    trees = stored(_dealt(placed, "shard", shard_vectors).groupBy("dim", "cell", "shard")
                   .applyInArrow(_build, "dim int, cell int, shard int, tree binary"))
    home = stored(chosen.home(asked.where(F.col("dim").isin(known))))
    first = stored(_meet(trees, home, k, factor, query_block))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    bounds = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").alias("worst"))
    bounded = home.drop("bound", "gap").join(bounds, "id", "left").select(
        "id", "vector", "dim", F.coalesce("worst", F.lit(float("inf"))).alias("bound"), "cell")
    balls = {dim: np.tile([np.inf, -np.inf], (len(p), 1)) for dim, p in chosen.of.items()}
    for r in placed.groupBy("dim", "cell").agg(F.min("gap").alias("low"),
                                               F.max("gap").alias("high")).collect():
        balls[r["dim"]][r["cell"]] = r["low"], r["high"]
    further = stored(chosen.reached(bounded, balls, factor))
    found = first.unionByName(_meet(trees, further, k, factor, query_block))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
