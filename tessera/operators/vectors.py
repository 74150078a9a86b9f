"""Exact cosine search over arrays of floats, and rankings built on it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from .relational import top_per_group


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Length one; a zero vector stays zero."""
    size = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / size)


def faults(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """One row: rows, distinct ids, least and greatest length, rows with a missing or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("n_ids"), F.min(F.size(vector)).cast("long").alias("least_dim"), F.max(F.size(vector)).cast("long").alias("most_dim"), F.count_if(F.coalesce(bad, F.lit(True))).alias("n_bad"))


#: Bytes of query vectors that a task holds at once; more queries are more passes over the index.
SLICE_BYTES = 32 << 20


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query") -> DataFrame:
    """The k rows of greatest cosine for each query, ties to the smaller id.  k under 1 counts as 1.

    A slice of the queries meets each batch of the index in one matrix product, and the batch keeps k rows a query; the
    slices, passes over the index, are of at most SLICE_BYTES.  Null vectors take no part; vectors of another length are an error.
    """
    k = max(1, k)
    asked = queries.where(F.col(query_vector).isNotNull()).select(query_id, F.transform(query_vector, lambda x: x.cast("double")).alias("q"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("d"), F.coalesce(F.min(F.size("q")), F.lit(0)).alias("least")).first()
    if size.d != size.least:
        raise ValueError(f"the queries have {size.least} to {size.d} dimensions")
    slices = max(1, math.ceil(8 * size.n * size.d / SLICE_BYTES))
    rows = index.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).alias("v"))
    kind, id_kind = index.schema[id_col].dataType, asked.schema[query_id].dataType
    kind_of = to_arrow_type(id_kind)
    schema = StructType([StructField(query_id, id_kind), StructField(id_col, kind), StructField("score", DoubleType())])
    out = None
    for part in range(slices):
        mine = asked if slices == 1 else asked.where(F.pmod(F.xxhash64(query_id), F.lit(slices)) == part)
        held = sorted(((r[0], r[1]) for r in mine.collect()), key=lambda r: str(r[0]))  # of at most about SLICE_BYTES
        names, units = [r[0] for r in held], _units(np.array([r[1] for r in held], np.float64).reshape(len(held), size.d))

        def near(batches, names=names, units=units):
            for batch in batches:
                if not batch.num_rows or not names:
                    continue
                ids, v = batch.column(0), batch.column(1)
                if pc.min(pc.list_value_length(v)).as_py() != units.shape[1] or pc.max(pc.list_value_length(v)).as_py() != units.shape[1]:
                    raise ValueError(f"the queries have {units.shape[1]} dimensions, the index others")
                by_id = np.asarray(pc.sort_indices(ids))
                score = units @ _units(_matrix(v, units.shape[1])[by_id]).T
                place = np.argsort(-np.round(score, 12), axis=1, kind="stable")[:, :k]
                yield pa.record_batch([pa.array([n for n in names for _ in range(place.shape[1])], kind_of), ids.take(pa.array(by_id[place.ravel()])), pa.array(np.take_along_axis(score, place, axis=1).ravel())], [query_id, id_col, "score"])

        found = rows.mapInArrow(near, schema)
        out = found if out is None else out.unionByName(found)
    return top_per_group(out, [query_id], [F.round("score", 12).desc(), F.col(id_col)], k)


def rank_owners(hits: DataFrame, links: DataFrame, item: str, owner: str, m: int = 3, group: str = "query_id") -> DataFrame:
    """Owners by the mean of their m best items, a missing item counting as zero."""
    per = hits.join(links.select(item, owner).distinct(), item)
    ranked = per.withColumn("_r", F.row_number().over(W.partitionBy(group, owner).orderBy(F.col("score").desc(), F.col(item))))
    return ranked.groupBy(group, owner).agg((F.sum(F.when(F.col("_r") <= m, F.col("score")).otherwise(0.0)) / m).alias("owner_score"), F.max("score").alias("best"), F.count(F.lit(1)).alias("n_matching"))


#: Rows and columns of a tile of cosines, which stays in cache, and rows of a task.
TILE, TASK_ROWS = (256, 1024), 4096


def similarity_histogram(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", sample: int = 200, bins: int = 20) -> DataFrame:
    """(bin, n): cosines of the pairs among the `sample` rows of least id hash, in equal bins of [-1, 1].

    The sample is the operator's own, a look at a large table; with as many rows as the table has, all pairs count.  As in
    search(), slices of the rows of at most about SLICE_BYTES meet all rows in matrix products; a pair counts where its greater
    id meets the slice.  Vectors with a null take no part; vectors of several lengths are an error.
    """
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    rows = df.where(whole).select(id_col, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d"), F.coalesce(F.min(F.size("v")), F.lit(0)).alias("least")).first()
    if size.d != size.least:
        raise ValueError(f"the vectors have {size.least} to {size.d} dimensions")
    if size.n > sample:
        rows = rows.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    n, dim = min(size.n, sample), size.d
    dealt = rows.repartition(max(1, min(n, df.sparkSession.sparkContext.defaultParallelism), math.ceil(n / TASK_ROWS)))
    slices = max(1, math.ceil(8 * n * dim / SLICE_BYTES))
    out = None
    for part in range(slices):
        mine = rows if slices == 1 else rows.where(F.pmod(F.xxhash64(id_col), F.lit(slices)) == part)
        held = mine.toArrow()  # of at most about SLICE_BYTES
        by_id = pc.sort_indices(held.column(0))
        names, units = held.column(0).take(by_id).to_numpy(), _units(_matrix(held.column(1).combine_chunks(), dim)[by_id.to_numpy()])

        def count(batches, names=names, units=units):
            found = np.zeros(bins + 2, np.int64)
            for batch in batches:
                order = np.asarray(pc.sort_indices(batch.column(0)))
                ids, mine = batch.column(0).to_numpy(zero_copy_only=False)[order], _units(_matrix(batch.column(1), dim)[order])
                before = np.searchsorted(names, ids)  # names before each id
                scaled, sound = mine * (bins / 2), bool(np.isfinite(mine).all() and np.isfinite(units).all())
                for at in range(0, len(ids), TILE[0]):
                    upto = before[at : at + TILE[0]]
                    for first in range(0, upto[-1], TILE[1]):
                        # 5e-10 more puts a cosine that rounds up to a limit at 9 digits beyond it
                        place = scaled[at : at + TILE[0]] @ units[first : first + TILE[1]].T + (1 + 5e-10) * bins / 2
                        bin_of = (place if sound else np.nan_to_num(place)).astype(np.int64)
                        if upto[0] < first + bin_of.shape[1]:
                            bin_of[np.arange(first, first + bin_of.shape[1]) >= upto[:, None]] = bins + 1
                        found += np.bincount(bin_of.ravel(), minlength=bins + 2)
            found[bins - 1] += found[bins]
            yield pa.record_batch([pa.array(np.arange(1, bins + 1, dtype=np.int32)), pa.array(found[:bins])], ["bin", "n"])

        told = dealt.mapInArrow(count, "bin int, n long")
        out = told if out is None else out.unionByName(told)
    return out.groupBy("bin").agg(F.sum("n").alias("n")).where("n > 0")
