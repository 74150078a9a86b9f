"""Nearest neighbours by a block matrix join over int8 tiles with error bounds.

Vectors are dealt into slices and queries into blocks, both by hash; each pair of a slice and a block is one
tile.  In a tile, vectors are rounded to int8 with a scale each, and one integer matrix product gives the
distances of the rounded vectors.  By the triangle inequality a true distance differs by at most the two
rounding errors, which are known exactly.  A pair whose lower bound lies above the tile's k-th upper bound cannot
be among the nearest; the others are recomputed in double precision from the original vectors, and the tiles'
heaps of k are merged.  The result is exact.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 10
SLICE, BLOCK = 8192, 1024
_CHUNK = 128


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    arr = column.combine_chunks()
    n = len(arr)
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales and the Euclidean norms of what rounding took away."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of row pairs, squares added from the first component to the last."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        return _root_of_squares(a, b, total)


def _root_of_squares(a: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        total += d * d
    return np.sqrt(total)


def tile(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, y: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest rows of x for each row of y, rows of the query's own id aside."""
    # bounds are taken in units of the largest component, so that squares neither overflow nor vanish
    largest = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    unit = 2.0 ** math.floor(math.log2(largest)) if largest > 0 else 1.0
    q, scale, error = quantise(x / unit)
    qy, scale_y, error_y = quantise(y / unit)
    kind = np.float32 if x.shape[1] <= 1000 else np.float64  # sums of products of int8 are exact in both
    q, qy = q.astype(kind), qy.astype(kind)
    norm, norm_y = (scale**2) * (q.astype(np.float64) ** 2).sum(1), (scale_y**2) * (qy.astype(np.float64) ** 2).sum(1)
    out = []
    for at in range(0, len(y), _CHUNK):
        part = slice(at, at + _CHUNK)
        product = (qy[part] @ q.T).astype(np.float64)
        square = norm_y[part][:, None] + norm - 2 * scale_y[part][:, None] * scale * product
        near = np.sqrt(np.maximum(square, 0))
        slack = error_y[part][:, None] + error
        slack += 1e-6 * (np.sqrt(norm_y[part])[:, None] + np.sqrt(norm))  # rounding of the formula itself
        own = query_ids[part][:, None] == ids
        upper = np.where(own, np.inf, near + slack)
        bound = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(upper), np.inf)
        row, col = np.nonzero(~own & (near - slack <= bound[:, None]))
        distance = exact_distance(y[at + row], x[col])
        cuts = np.searchsorted(row, np.arange(len(upper) + 1))
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            best = heapq.nsmallest(k, zip(distance[lo:hi].tolist(), ids[col[lo:hi]].tolist(), strict=True))
            out += [(int(query_ids[at + i]), v, d) for d, v in best]
    return out


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each usable vector whose id is divisible by `every`, its k nearest others.

    Vectors of other lengths than the query's are no candidates.  Rows that share the query's id are its own; the least
    of their vectors asks.  A distance too large for a double is infinite.
    Ties go to the smaller id; fewer candidates give fewer rows; rows without an id take no part.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    is_query = F.col("vec_id") % every == 0
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    slices, blocks = max(1, math.ceil(n["n"] / SLICE)), max(1, math.ceil(n["q"] / BLOCK))
    deal = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
    data = rows.withColumn("slice", deal(slices, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).withColumn("block", deal(blocks, 2)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = tile(left["vec_id"].to_numpy(), _matrix(left["v"]), right["vec_id"].to_numpy(), _matrix(right["v"]), k)
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    key = ["dim", "slice", "block"]
    tiles = data.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(join, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return tiles.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d) WHERE rank <= 10
"""
