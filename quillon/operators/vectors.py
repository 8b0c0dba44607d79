"""Nearest vectors by cosine, exactly: an inverted file whose cells are pruned by bounds on angles.

Centroids are fitted on a bounded sample and only order the work; every vector is indexed, in the cell of its nearest
centroid and there in a ring of like angles to it. By the triangle inequality of angles, a query at angle t from a centroid
is at least max(t - high, low - t) away from all of a ring [low, high]. Each query first searches its nearest rings, which
gives a bound on its k-th similarity, and then only the rings that may hold a vector as near. How much is pruned depends on
the vectors: where they are spread evenly over many dimensions no exact method prunes, and the search is a product of blocks.

A ring is compared with its queries in blocks of bounded size on either side, as matrices; a block gives k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.registry import Registry
from quillon.session import table
from quillon.sources.shared import staged

registry = Registry()


@dataclass(frozen=True)
class Search:
    k: int = 10
    #: Cells at most, vectors a cell at least on average, and rings a cell.
    cells: int = 64
    cell: int = 2048
    rings: int = 16
    #: Values (vectors times their length) of the sample that centroids are fitted on.
    sample: int = 1 << 20
    #: Vectors and queries of a block.
    base_block: int = 16_384
    query_block: int = 4096
    #: Digits to which similarities are compared; then ids decide.
    digits: int = 9
    seed: int = 7


#: Added to bounds on angles, far above the error of an arc cosine of doubles.
_SLACK = 1e-6
_ROW = "id long, v array<double>"


def unit(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v): vectors at length one. Rows of a null id, and null, empty, zero or non-finite vectors, are left out."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                size = np.linalg.norm(x, axis=1)
                good = np.isfinite(size) & (size > 0)
                yield _rows(batch.column(0).filter(pa.array(good)), x[good] / size[good, None])

    d = df.select(df[id_column].cast("long").alias("id"), df[vector].cast("array<double>").alias("v"))
    return d.where("id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)").mapInArrow(scale, _ROW)


def _matrix(v: pa.Array) -> np.ndarray:
    """The vectors as rows; all must have one length."""
    flat = v.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % len(v) or len(set(np.diff(v.offsets.to_numpy()))) > 1:
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(v), -1)


def _rows(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, x.ravel())], names=["id", "v"])


def centroids(base: DataFrame, rows: int, setting: Search) -> np.ndarray:
    """Directions of the cells, by some rounds of spherical k-means on the sample."""
    first = base.select("v").head()
    size = max(1, min(rows, setting.sample // len(first.v)))
    sample = np.array([r.v for r in base.orderBy(F.xxhash64("id"), "id").limit(size).select("v").toLocalIterator()])
    k = max(1, min(setting.cells, rows // setting.cell, len(sample)))
    found = sample[np.random.default_rng(setting.seed).choice(len(sample), k, replace=False)]
    for _ in range(8):
        owner = (sample @ found.T).argmax(1)
        total = np.zeros_like(found)
        np.add.at(total, owner, sample)
        size = np.linalg.norm(total, axis=1)
        found = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], found)
    return found


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def _placed(base: DataFrame, centres: np.ndarray, setting: Search) -> DataFrame:
    """(id, v, ring, angle): ring numbers the cells' rings."""
    rings = setting.rings

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_matrix(batch.column(1)), centres)
                cell = angles.argmin(1)
                angle = angles[np.arange(len(cell)), cell]
                ring = cell * rings + np.minimum((angle * rings / np.pi).astype(np.int64), rings - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ring), pa.array(angle)], names=["id", "v", "ring", "angle"])

    return base.mapInArrow(place, f"{_ROW}, ring long, angle double")


def _routes(queries: DataFrame, centres: np.ndarray, bounds: np.ndarray, setting: Search, first: bool) -> DataFrame:
    """(id, v, ring): where each query (id, v, least) is searched, first in its nearest rings, then in all others that may matter.

    bounds: ring, low, high and number of vectors of each ring; least: the similarity that a vector must have to matter.
    """
    centre = (bounds[:, 0] // setting.rings).astype(int)
    low, high, many = bounds[:, 1], bounds[:, 2], bounds[:, 3]
    wanted = setting.k + 1  # the query itself may be among them

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angle = _angles(_matrix(batch.column(1)), centres)[:, centre]
            away = np.maximum(0, np.maximum(angle - high, low - angle) - _SLACK)
            order = np.argsort(away, axis=1, kind="stable")
            before = np.cumsum(many[order], axis=1) - many[order]
            near = np.zeros(away.shape, dtype=bool)
            np.put_along_axis(near, order, before < wanted, axis=1)
            go = near if first else ~near & (np.cos(away) >= batch.column(2).to_numpy(zero_copy_only=False)[:, None] - 10.0**-setting.digits)
            query, ring = np.nonzero(go)
            taken = batch.select([0, 1]).take(pa.array(query))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(bounds[ring, 0].astype(np.int64))], names=["id", "v", "ring"])

    return queries.select("id", "v", "least").mapInArrow(route, f"{_ROW}, ring long")


def _nearest(placed: DataFrame, routed: DataFrame, setting: Search, same: bool) -> DataFrame:
    """(query_id, neighbour_id, similarity): the k best of each block of a ring, for each query that is sent to it."""
    k, digits = setting.k, setting.digits
    blocks = lambda d, size: F.ceil(F.count(F.lit(1)) / size).alias(d)
    # counts of rings, of which there are cells times rings at most
    many = placed.groupBy("ring").agg(blocks("bases", setting.base_block)).join(routed.groupBy("ring").agg(blocks("queries", setting.query_block)), "ring")
    many = F.broadcast(many)
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = routed.join(many, "ring").select("id", "v", "ring", spot("queries").alias("q"), each("bases").alias("b"))
    right = placed.select("id", "v", "ring").join(many, "ring").select("id", "v", "ring", each("queries").alias("q"), spot("bases").alias("b"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [], [], []
        if a.num_rows and b.num_rows:
            a, b = a.combine_chunks(), b.combine_chunks()
            ids, own = b.column("id").to_numpy(), a.column("id").to_numpy()
            x, y = (_matrix(t.column("v").combine_chunks()) for t in (a, b))
            for at in range(0, len(x), 256):
                found = np.round(x[at : at + 256] @ y.T, digits)
                if not same:
                    found[own[at : at + 256, None] == ids[None, :]] = -np.inf
                for i, row in enumerate(found):
                    at_least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -2
                    best = np.flatnonzero((row >= at_least) & (row > -np.inf))
                    best = best[np.lexsort((ids[best], -row[best]))][:k]
                    out[0].append(np.full(len(best), own[at + i]))
                    out[1].append(ids[best])
                    out[2].append(row[best])
        flat = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, ("i8", "i8", "f8"), strict=True)]
        return pa.table(dict(zip(("query_id", "neighbour_id", "similarity"), flat, strict=True)))

    keys = ("ring", "q", "b")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, neighbour_id long, similarity double")


def cosine_top_k(base: DataFrame, queries: DataFrame, id_column: str, vector: str, setting: Search = Search(), same: bool = False) -> DataFrame:
    """(query_id, neighbour_id, similarity, place): the k vectors of base most similar to each query.

    Similarities are rounded to `digits`; of equal ones smaller ids come first. A vector is not its own neighbour, by id,
    unless `same`. Rows without a direction (null, empty, zero, non-finite) or an id are in no result; vectors of different
    lengths are an error.
    """
    spark = base.sparkSession
    every = staged(unit(base, id_column, vector), "vectors")
    asked = staged(unit(queries, id_column, vector), "queries")
    empty = spark.createDataFrame([], "query_id long, neighbour_id long, similarity double, place int")
    rows = every.count()
    if not rows or asked.isEmpty():
        return empty
    centres = centroids(every, rows, setting)
    placed = staged(_placed(every, centres, setting), "placed")
    # a row a ring
    bounds = placed.groupBy("ring").agg(F.min("angle"), F.max("angle"), F.count(F.lit(1))).orderBy("ring").collect()
    bounds = np.array([tuple(r) for r in bounds], dtype=float)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    best = lambda d: d.withColumn("place", F.row_number().over(order)).where(F.col("place") <= setting.k)
    near = _routes(asked.withColumn("least", F.lit(-2.0)), centres, bounds, setting, first=True)
    found = staged(_nearest(placed, staged(near, "routes"), setting, same), "near")
    least = best(found).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == setting.k, F.min("similarity")).alias("least"))
    left = asked.join(least, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("least", F.lit(-2.0)).alias("least"))
    far = staged(_routes(left, centres, bounds, setting, first=False), "routes")
    return best(found.unionAll(_nearest(placed, far, setting, same)))


@registry.query(
    """SELECT * FROM (SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity,
              CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS INTEGER) AS place
       FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0) WHERE place <= 10"""
)
def vectors_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to each query, a query being a vector whose id is divisible by 50."""
    base = table(spark, sf_dir, "embeddings")
    return cosine_top_k(base, base.where("vec_id % 50 = 0"), "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))
