"""Points in cells around centroids, so that a search opens only those that can hold one of its hits.

Centroids are fitted on a bounded sample; every point goes to the nearest. A cell is a folder, and the manifest has its centroid, the
least and the greatest angle of its points to it, and their number. By the triangle inequality no point of a cell is nearer
to a query than its own angle to the centroid less that range allows, so a cell whose best possible score is under
the k-th score found so far is not opened. Results are exactly those of the scan; how much is left out depends on
how well the points cluster, and on spread vectors it is nothing. With `probes`, only so many cells are looked at for each query, and a hit can be missed.

Points without a vector, or with one of another dimension or with nulls, are not indexed. Zero vectors have a score of 0 with all, and a cell of their own.
"""

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..sources import manifest
from .joins import settled, small_or_not
from .search import BLOCK, _matrix, _ranked, groups, product, top_k

#: Cells at most; points that a cell has on average, at least; vectors at most that centroids are fitted on.
CELLS, POINTS_A_CELL, SAMPLE = 512, 4096, 20_000
#: Groups that a large cell is dealt into at least; cells are units of work by themselves.
CELL_GROUPS = 2
#: Angles are right to about the root of a double's precision.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """Where the points lie, and of each cell the centroid, its points' least and greatest angle, and their number. The last cell has the
    zero vectors."""

    path: str
    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def angles(self, x: np.ndarray) -> np.ndarray:
        """Of rows of length 1 or 0 to every cell; a zero row or cell is at a right angle."""
        return np.arccos(np.clip(np.hstack([x @ self.centroids.T, np.zeros((len(x), 1))]), -1, 1))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The best score that a point of each cell can have."""
        angle = self.angles(x)
        apart = np.maximum(0, np.maximum(angle - self.high, self.low - angle) - SLACK)
        best = np.where(self.n > 0, np.cos(apart), -2.0)
        best[:, -1] = np.where(self.n[-1] > 0, 0.0, -2.0)
        best[~x.any(axis=1)] = np.where(self.n > 0, 0.0, -2.0)
        return best

    def first(self, x: np.ndarray, points: int = 0, cells: int = 0) -> np.ndarray:
        """For each row the nearest cells that have so many points together, or so many cells."""
        angle = np.where(self.n > 0, self.angles(x), np.inf)
        order = np.argsort(angle, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        near = np.broadcast_to(np.arange(order.shape[1]) < cells, order.shape) if cells else before < points
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, near, axis=1)
        return out & (self.n > 0)


def centroids_of(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means over rows of length 1, from rows that lie apart."""
    n = min(n, len(x))
    r = np.random.default_rng(0)
    c = x[r.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def _places(centroids: np.ndarray):
    """The cell and the angle to its centroid."""
    dim, none = centroids.shape[1], len(centroids)

    @F.arrow_udf("struct<cell: int, angle: double>")
    def place(vectors: pa.Array) -> pa.Array:
        x = _matrix(vectors, dim)
        score = x @ centroids.T
        own = np.argmax(score, axis=1)
        zero = ~x.any(axis=1)
        angle = np.where(zero, 0.0, np.arccos(np.clip(score[np.arange(len(x)), own], -1, 1)))
        return pa.StructArray.from_arrays([pa.array(np.where(zero, none, own), "i4"), pa.array(angle)], ["cell", "angle"])

    return place


def build(points: DataFrame, path: str, n_cells: int | None = None, sample: int = SAMPLE) -> Index:
    """Write points(id, vector, ...) by cell. Cells are cut by ranges of (cell, angle, id), so that one with most of the points, or
    of equal ones, is many tasks' work."""
    spark = points.sparkSession
    alike = points.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    dims = alike.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n = (dims["dim"], dims["n"]) if dims else (1, 0)
    alike = alike.filter(F.size("vector") == dim)
    some = alike.select("vector").filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n))) < sample).limit(2 * sample).toArrow()
    x = _matrix(some.column("vector").combine_chunks(), dim) if some.num_rows else np.zeros((0, dim))
    x = x[x.any(axis=1)]
    centroids = centroids_of(x, n_cells or int(np.clip(n // POINTS_A_CELL, 1, CELLS))) if len(x) else np.eye(1, dim)
    placed = alike.withColumn("__place", _places(centroids)("vector")).select(*points.columns, "__place.cell", "__place.angle")
    order = ["cell", "angle", "id"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("cell").parquet(f"{path}/rows")
    k = len(centroids) + 1
    low, high, held = np.zeros(k), np.zeros(k), np.zeros(k, "i8")
    if n:
        for r in spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).collect():
            low[r["cell"]], high[r["cell"]], held[r["cell"]] = r["low"], r["high"], r["n"]
    body = {"schema": placed.schema.json(), "centroids": centroids.tolist(), "low": low.tolist(), "high": high.tolist(), "n": held.tolist()}
    manifest.put(spark, path, 1, body)
    return Index(path, centroids, low, high, held)


def opened(spark: SparkSession, path: str) -> Index:
    """An index that build() has written."""
    found = manifest.newest(spark, path)
    if found is None:
        raise ValueError(f"no index at {path}")
    return Index(path, *(np.array(found[1][k]) for k in ("centroids", "low", "high", "n")))


def rows(spark: SparkSession, index: Index, cells: np.ndarray | None = None) -> DataFrame:
    """The points, of some cells if they are named (a mask): only their folders are listed and read."""
    schema = T.StructType.fromJson(json.loads(manifest.newest(spark, index.path)[1]["schema"]))
    named = np.flatnonzero((index.n > 0) if cells is None else (index.n > 0) & cells)
    at = f"{index.path}/rows"
    return spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/cell={c}" for c in named]) if len(named) else spark.createDataFrame([], schema)


def nearest(spark: SparkSession, index: Index, query: list[float], limit: int = 10, where: Column | None = None, probes: int | None = None) -> DataFrame:
    """The best `limit` points, as top_k() gives them from all points that meet the condition.

    The nearest cells give a k-th score first; then only cells that can hold a better or an equal one are read.
    """
    x = _matrix(pa.array([query], pa.list_(pa.float64())), index.dim)
    among = lambda cells: rows(spark, index, cells) if where is None else rows(spark, index, cells).filter(where)
    cells = index.first(x, points=4 * limit, cells=probes or 0)[0]
    if probes is None:
        scores = [r["score"] for r in top_k(among(cells), query, limit).select("score").collect()]
        cells = index.bounds(x)[0] >= (scores[-1] - SLACK if len(scores) == limit else -1.0)
    return top_k(among(cells), query, limit).drop("cell", "angle")


def _targets(index: Index, first: dict, floor: bool):
    """The cells that a vector's search looks into: the nearest ones, or, with a score to beat, the others that can hold one."""

    def chosen(x: np.ndarray, least: np.ndarray | None) -> pa.Array:
        near = index.first(x, **first)
        cells = near if least is None else (index.bounds(x) >= least[:, None] - SLACK) & ~near
        at, cell = np.nonzero(cells)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(x)))]), "i4"), pa.array(cell, "i4"))

    if floor:

        @F.arrow_udf("array<int>")
        def others(vectors: pa.Array, least: pa.Array) -> pa.Array:
            return chosen(_matrix(vectors, index.dim), least.to_numpy(zero_copy_only=False))

        return others

    @F.arrow_udf("array<int>")
    def nearest_cells(vectors: pa.Array) -> pa.Array:
        return chosen(_matrix(vectors, index.dim), None)

    return nearest_cells


def _scored(asked: DataFrame, points: DataFrame, index: Index, limit: int, exclude_self: bool, block: int) -> DataFrame:
    """(query_id, id, score) from products of blocks: asked(query_id, vector, cell, targets) with the points of their targets.

    A cell of more than `block` points is dealt into groups (`search.groups`) by the ids' hash, whoever's cell it is. Points go only where a
    query of a group asks for their cell; products are made tile by tile.
    """
    spark = asked.sparkSession
    blocks = [(c, groups(int(k), index.dim, block, CELL_GROUPS)) for c, k in enumerate(index.n)]
    sizes = F.broadcast(spark.createDataFrame(blocks, "c int, blocks int"))  # a row for each cell
    own = asked.join(sizes.withColumnRenamed("c", "cell"), "cell").select("query_id", "vector", "cell", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("i"), F.explode("targets").alias("target"))
    wanted = settled(own.select("cell", "i", "target").distinct())  # a row for each block of queries and cell
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    left = own.join(sizes.withColumnRenamed("c", "target"), "target").select(F.col("query_id").alias("key"), "vector", F.lit(0).alias("side"), "cell", "i", "target", every)
    here = points.join(sizes.withColumnRenamed("c", "cell"), "cell").select(F.col("id").alias("key"), "vector", F.col("cell").alias("target"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("j"))
    asking = small_or_not(wanted.groupBy("target").agg(F.collect_list(F.struct("cell", "i")).alias("from")), wanted.count())  # lists of blocks, not of points
    right = here.join(asking, "target").select("key", "vector", F.lit(1).alias("side"), F.explode("from").alias("f"), "target", "j").select("key", "vector", "side", "f.cell", "f.i", "target", "j")
    out = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, score double"
    return left.union(right).groupBy("cell", "i", "target", "j").applyInArrow(product(index.dim, limit, exclude_self), out)


def _own_targets(spark: SparkSession, index: Index, limit: int, probes: int | None) -> tuple[DataFrame, dict]:
    points = rows(spark, index).select("id", "vector", "cell")
    return points, {"cells": probes} if probes else {"points": 4 * (limit + 1)}


def all_nearest(spark: SparkSession, index: Index, limit: int = 5, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the nearest others of every point, exactly; with `probes` among so many cells' points only.

    Each point first meets the nearest cells. Its k-th score there is one to beat: of the other cells it meets those
    that can hold a better or an equal one.
    """
    points, first = _own_targets(spark, index, limit, probes)
    asked = points.withColumnRenamed("id", "query_id")
    near = _scored(asked.withColumn("targets", _targets(index, first, False)("vector")), points, index, limit, True, block)
    if probes:
        return _ranked(near, limit)
    near = settled(_ranked(near, limit).drop("rank"))
    least = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    least = least.select("query_id", F.when(F.col("n") == limit, F.col("least")).otherwise(-1.0).alias("least"))
    rest = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
    far = _scored(rest.withColumn("targets", _targets(index, first, True)("vector", "least")).filter(F.size("targets") > 0), points, index, limit, True, block)
    return _ranked(near.unionByName(far), limit)


def share_read(spark: SparkSession, index: Index, found: DataFrame, limit: int = 5) -> float:
    """Of all pairs of points, the share whose score all_nearest() works out; found is its result."""
    points, first = _own_targets(spark, index, limit, None)
    least = found.groupBy("query_id").agg(F.min("score").alias("least"))
    # the score to beat is at least what the nearest cells gave, so this counts no more than is read
    sizes = F.array(*[F.lit(int(k)) for k in index.n])
    one = points.join(least, F.col("id") == F.col("query_id")).select(F.concat(_targets(index, first, False)("vector"), _targets(index, first, True)("vector", "least")).alias("targets"))
    total = one.select(F.aggregate("targets", F.lit(0), lambda s, t: s + F.get(sizes, t)).alias("n")).agg(F.sum("n").alias("n")).first()["n"]
    return (total or 0) / max(1, int(index.n.sum()) ** 2)
