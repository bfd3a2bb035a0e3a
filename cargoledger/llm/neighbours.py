"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are projected on a few Gaussian directions. The projected distance of two vectors at distance d,
squared and divided by d squared, is chi-square distributed with as many degrees of freedom as
directions. So a vector at distance at most d is projected within ``d * sqrt(q)`` of the query with
probability ``confidence``, where q is that quantile of the distribution. A query visits
projected neighbours from near to far, verifies each by its true distance, and stops when the next one
lies beyond that bound for the k-th best distance found so far.

The kd-tree over the projections has two levels. Its upper cells are split at medians of a bounded sample
and every vector is assigned to one; cells are cut into blocks of a bounded number of vectors. The lower
tree is built in the task that holds a block, over all its vectors. A first round searches the query's own
cell and so bounds the k-th distance; a second visits the cells that reach inside the bound.

Copies of one vector, of which there may be very many, are represented by the k + 1 smallest ids: no
other copy can be among the k nearest of anything, since ties go to smaller ids. Queries with one vector
are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoledger.llm.common import spread_join, written

DIRECTIONS = 8
CONFIDENCE = 0.98
# Vectors per block, and the most cells and sampled vectors of the upper tree.
BLOCK_ROWS = 4096
MAX_CELLS = 1024
SAMPLE_ROWS = 20_000
LEAF_ROWS = 64


def chi_square_quantile(share: float, degrees: int) -> float:
    """Quantile of the chi-square distribution for an even number of degrees of freedom."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    low, high = 0.0, 1.0
    while below(high) < share:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


def median_splits(points: np.ndarray, rows: np.ndarray, leaf_rows: int, box: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Leaves (rows, box) of a kd-tree that splits the widest side at the median; equal points share a leaf."""
    spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(points.shape[1])
    side = int(np.argmax(spread))
    if len(rows) <= leaf_rows or spread[side] == 0:
        return [(rows, box)]
    values = points[rows, side]
    cut = np.median(values)
    left = values < cut
    if not left.any():
        cut = values[values > cut].min()
        left = values < cut
    lower, upper = box.copy(), box.copy()
    lower[1, side], upper[0, side] = cut, cut
    return median_splits(points, rows[left], leaf_rows, lower) + median_splits(points, rows[~left], leaf_rows, upper)


def box_distances(point: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Smallest distance of a point to boxes (n, 2, sides)."""
    outside = np.maximum(np.maximum(boxes[:, 0] - point, point - boxes[:, 1]), 0)
    return np.sqrt((outside**2).sum(axis=1))


def valid_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part: an id, and a finite non-zero vector of the usual length."""
    vector = F.transform(F.col(vector_column), lambda x: x.cast("double") + F.lit(0.0))
    rows = table.select(F.col(id_column).cast("bigint").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull()
        & (F.size("vector") > 0)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), "length").limit(1)
    return rows.join(F.broadcast(usual.select("length")), F.size("vector") == F.col("length")).select("vec_id", "vector")


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _search_block(
    points: np.ndarray, vectors: np.ndarray, ids: np.ndarray, leaves: list, boxes: np.ndarray, query: np.ndarray, low: np.ndarray, k: int, reach: float, bound: float
) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of one block: projected neighbours leaf by leaf, until the stopping test holds."""
    gaps = box_distances(low, boxes)
    best_ids, best = np.zeros(0, np.int64), np.zeros(0)
    for leaf in np.argsort(gaps, kind="stable"):
        if gaps[leaf] > reach * bound:
            break
        rows = leaves[leaf][0]
        near = rows[((points[rows] - low) ** 2).sum(axis=1) <= (reach * bound) ** 2] if math.isfinite(bound) else rows
        if not len(near):
            continue
        distance = np.sqrt(((vectors[near] - query) ** 2).sum(axis=1))
        best, best_ids = np.concatenate((best, distance)), np.concatenate((best_ids, ids[near]))
        order = np.lexsort((best_ids, best))[:k]
        best, best_ids = best[order], best_ids[order]
        if len(best) == k:
            bound = min(bound, best[-1])
    return best_ids, best


def nearest(
    table: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    seed: int = 7,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """The k nearest other vectors of every query: ``query_id, rank, vec_id, score``.

    ``queries`` holds ids of rows of ``table`` in a column named as ``id_column``. Nearness is the Euclidean
    distance of the original vectors in double precision, ties going to smaller ids; with fewer than k
    candidates all are returned. Rows without an id, and vectors that are null, empty, zero or hold null
    or non-finite components, take no part, nor do vectors of another length than the most
    frequent one. Rows that repeat an id and its vector count once. An empty table gives no rows. Each
    true neighbour is found with about the probability ``confidence``; every vector is indexed.
    """
    spark = table.sparkSession
    rows = valid_vectors(table, id_column, vector_column).distinct()
    copies = W.partitionBy("vector").orderBy("vec_id")
    candidates = written(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("vec_id", "vector"), "vectors")
    asked = queries.select(F.col(id_column).cast("bigint").alias("vec_id")).distinct()
    asking = rows.join(asked, "vec_id", "left_semi")
    searched = written(asking.groupBy("vector").agg(F.min("vec_id").alias("probe")), "probes")

    n = candidates.count()
    sample = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").toArrow()
    found_schema = "probe bigint, vec_id bigint, distance double"
    sampled = _matrix(sample.column("vector").combine_chunks()) if n else np.zeros((0, 1))
    directions = np.random.default_rng(seed).standard_normal((sampled.shape[1], DIRECTIONS))
    cells = min(MAX_CELLS, max(1, -(-n // BLOCK_ROWS)))
    parts = max(1, -(-n // (cells * BLOCK_ROWS)))
    everywhere = np.stack((np.full(DIRECTIONS, -np.inf), np.full(DIRECTIONS, np.inf)))
    leaves = median_splits(sampled @ directions, np.arange(len(sampled)), -(-len(sampled) // cells), everywhere)
    index = spark.sparkContext.broadcast((directions, np.stack([box for _, box in leaves])))
    reach = math.sqrt(chi_square_quantile(confidence, DIRECTIONS))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, boxes = index.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                low = _matrix(part.column("vector")) @ matrix
                # Boxes are closed below and open above, so every point lies in one.
                inside = ((low[:, None, :] >= boxes[None, :, 0]) & (low[:, None, :] < boxes[None, :, 1])).all(axis=2)
                cell = pa.array(inside.argmax(axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, cell], names=[*part.schema.names, "cell"])

    def reachable(own_only: bool):
        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, boxes = index.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                low = _matrix(batch.column("vector")) @ matrix
                bound = np.asarray(batch.column("bound"), dtype=np.float64)
                visits = []
                for point, b in zip(low, bound, strict=True):
                    gaps = box_distances(point, boxes)
                    visits.append((np.flatnonzero((point >= boxes[:, 0]).all(axis=1) & (point < boxes[:, 1]).all(axis=1)) if own_only else np.flatnonzero(gaps <= reach * b)).tolist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

        return visit

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            matrix, _boxes = index.value
            vectors, ids = _matrix(left.column("vector").combine_chunks()), np.asarray(left.column("vec_id"))
            points = vectors @ matrix
            inner = median_splits(points, np.arange(len(ids)), LEAF_ROWS, everywhere)
            boxes = np.stack([np.stack((points[rows].min(axis=0), points[rows].max(axis=0))) for rows, _ in inner])
            asked_vectors = _matrix(right.column("vector").combine_chunks())
            lows, bounds = asked_vectors @ matrix, np.asarray(right.column("bound"), dtype=np.float64)
            for probe, query, low, bound in zip(right.column("probe").to_pylist(), asked_vectors, lows, bounds, strict=True):
                best_ids, best = _search_block(points, vectors, ids, inner, boxes, query, low, k + 1, reach, bound)
                out[0] += [probe] * len(best)
                out[1] += best_ids.tolist()
                out[2] += best.tolist()
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["probe", "vec_id", "distance"])

    block = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    indexed = written(candidates.mapInArrow(assign, "vec_id bigint, vector array<double>, cell int").withColumn("part", block), "cells")
    top = W.partitionBy("probe").orderBy("distance", "vec_id")

    def round_of(probes: DataFrame, own_only: bool) -> DataFrame:
        sent = (
            probes.mapInArrow(reachable(own_only), "probe bigint, vector array<double>, bound double, cells array<int>")
            .withColumn("cell", F.explode("cells"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            .drop("cells")
        )
        found = indexed.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part")).applyInArrow(search, found_schema)
        return found.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1)

    first = round_of(searched.select("probe", "vector", F.lit(float("inf")).alias("bound")), own_only=True)
    bounds = first.where(F.col("n") == k + 1).select("probe", F.col("distance").alias("bound"))
    bounded = searched.join(bounds, "probe", "left").select("probe", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    best = written(round_of(bounded, own_only=False).select("probe", "vec_id", "distance"), "nearest")

    lists = best.groupBy("probe").agg(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))).alias("found"))
    probes = asking.select(F.col("vec_id").alias("query_id"), "vector")
    answered = spread_join(spread_join(probes, searched, "vector", ["query_id"], "inner").drop("vector"), lists, "probe", ["query_id"], "inner")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.distance").alias("score")
    )
