"""Joins, orderings and windows in the shapes that the cleaning and reporting plans use."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def left_fill(left: DataFrame, right: DataFrame, on: str, fill: dict) -> DataFrame:
    """Left join; missing matches get the fill values."""
    return left.join(right, on, "left").fillna(fill)


def keep_known(df: DataFrame, allowed: DataFrame, on: str) -> DataFrame:
    return df.join(allowed.select(on), on, "left_semi")


def todo(df: DataFrame, done: DataFrame, on: str) -> DataFrame:
    return df.join(done.select(on), on, "left_anti")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Spark limits each group before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def forward_fill(df: DataFrame, columns: list[str], order: Column, group: list[str]) -> DataFrame:
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def flag_repeats(df: DataFrame, subset: list[str], order: Column, flag: str = "is_repeat") -> DataFrame:
    return df.withColumn(flag, F.row_number().over(W.partitionBy(*subset).orderBy(order)) > 1)


def first_spelling(df: DataFrame, group: list[str], column: str, order: Column, out: str) -> DataFrame:
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.withColumn(out, F.first(column, ignorenulls=True).over(w))


def prefer(primary: DataFrame, fallback: DataFrame, key: str, good: Column, values: list[str]) -> DataFrame:
    """One row for each key: the primary's if it is good, else the fallback's if that is good, else the primary's."""
    p = primary.select(F.col(key), F.struct(*values).alias("p"), good.alias("p_good"))
    f = fallback.select(F.col(key), F.struct(*values).alias("f"), good.alias("f_good"))
    both = p.join(f, key, "full")
    pick = F.when(F.col("p_good"), F.col("p")).when(F.col("f_good"), F.col("f")).otherwise(F.coalesce("p", "f"))
    source = F.when(F.col("p_good"), "primary").when(F.col("f_good"), "fallback").otherwise("none")
    return both.select(key, pick.alias("s"), source.alias("data_source")).select(key, "s.*", "data_source")


def dense_counts(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """Counts by whole number with zeros between the least and the greatest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(out))
    span = counts.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias(column))
    return span.join(counts, column, "left").fillna({out: 0})


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(df: DataFrame, key: str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """One row (key, field, message) for each rule that a row breaks; the job goes on."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))) for field, (bad, message) in rules.items()]))
    return df.select(key, F.explode(found).alias("v")).select(key, "v.field", "v.message")


def nest(parents: DataFrame, links: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: str, fields: list[str], out: str = "items") -> DataFrame:
    """Parents with the ordered array of their children; parents without one are left out."""
    rows = links.join(children, child_key).groupBy(parent_key).agg(F.array_sort(F.collect_list(F.struct(*dict.fromkeys([order, child_key, *fields])))).alias(out))
    return parents.join(rows, parent_key)


#: Marks up to which a ruler goes to every task.
RULER = 100_000
RANGES = 1024


def _sorted_marks(marks: DataFrame, start: str, label: str) -> tuple[np.ndarray, list]:
    """Starts in order and their labels, of equal starts the greatest label; null starts are no marks."""
    rows = marks.where(F.col(start).isNotNull()).groupBy(F.col(start).cast("double").alias("s")).agg(F.max(label).alias("l")).collect()
    rows.sort(key=lambda r: r.s)
    return np.array([r.s for r in rows], np.float64), [r.l for r in rows]


def _lookup(points: DataFrame, x: Column, pick, label: str, kind) -> DataFrame:
    """points with the label of the mark that pick(values) names by its place, -1 for none."""

    @F.pandas_udf(kind)
    def found(values: pd.Series) -> pd.Series:
        return pd.Series(pick(values.to_numpy(np.float64)), dtype=object)

    return points.withColumn(label, found(x.cast("double")))


def as_of(points: DataFrame, marks: DataFrame, x: str, start: str, label: str, slack: float = 0.0) -> DataFrame:
    """For each point the mark of greatest start not beyond x + slack, of equal starts the greatest label.

    Up to RULER marks are a sorted ruler in every task, searched by halves.  More are laid beside the distinct x in
    ranges of x: within a range the last mark goes forward, and each range begins with the last one of those before it.
    """
    marks = marks.select(F.col(start).alias("_s"), F.col(label).alias("_l"))
    kind = marks.schema["_l"].dataType
    if marks.count() <= RULER:
        starts, labels = _sorted_marks(marks, "_s", "_l")
        named = np.array([*labels, None], object)
        return _lookup(points, F.col(x) + slack, lambda v: named[np.where(np.isnan(v), -1, np.searchsorted(starts, v, "right") - 1)], label, kind)
    return _as_of_ranges(points, marks, x, label, slack)


def _as_of_ranges(points: DataFrame, marks: DataFrame, x: str, label: str, slack: float, ranges: int = RANGES) -> DataFrame:
    ruler = marks.where("_s is not null").groupBy(F.col("_s").cast("double").alias("_s")).agg(F.max("_l").alias("_l"))
    bounds = ruler.agg(F.percentile_approx("_s", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0]
    edges = np.unique(np.array(bounds, np.float64))

    @F.pandas_udf("int")
    def range_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, values.to_numpy(np.float64), "right"))

    asked = points.where(F.col(x).isNotNull()).select((F.col(x) + slack).cast("double").alias("_s")).distinct().withColumn("_mark", F.lit(False))
    line = ruler.withColumn("_mark", F.lit(True)).unionByName(asked, allowMissingColumns=True).withColumn("_r", range_of("_s"))
    before = line.where("_mark").groupBy("_r").agg(F.max_by("_l", "_s").alias("_m"))
    every = line.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("_r"))  # at most `ranges` rows
    carried = every.join(before, "_r", "left").withColumn("_b", F.last("_m", ignorenulls=True).over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)))
    within = W.partitionBy("_r").orderBy("_s", F.col("_mark").desc()).rowsBetween(W.unboundedPreceding, 0)
    told = line.withColumn("_o", F.last(F.when(F.col("_mark"), F.col("_l")), ignorenulls=True).over(within)).where("NOT _mark").join(F.broadcast(carried.select("_r", "_b")), "_r").select(F.col("_s").alias("_x"), F.coalesce("_o", "_b").alias("_label"))
    return points.join(told, (F.col(x) + slack).cast("double") == F.col("_x"), "left").withColumn(label, F.col("_label")).drop("_x", "_label")


def nearest_mark(points: DataFrame, marks: DataFrame, x: str, at: str, label: str, most: float) -> DataFrame:
    """For each point the mark at the least distance, the lesser of equally near ones, null beyond `most`.

    The nearest is the last mark not beyond x or the first beyond it, so more than RULER marks are two as-of joins.
    """
    marks = marks.select(F.col(at).alias("_s"), F.col(label).alias("_l"))
    kind = marks.schema["_l"].dataType
    if marks.count() <= RULER:
        starts, labels = _sorted_marks(marks, "_s", "_l")
        named = np.array([*labels, None], object)

        def pick(v: np.ndarray) -> np.ndarray:
            if not len(starts):
                return np.full(len(v), None)
            high = np.minimum(np.searchsorted(starts, v, "right"), len(starts) - 1)
            low = np.maximum(high - 1, 0)
            best = np.where(np.abs(starts[low] - v) <= np.abs(starts[high] - v), low, high)
            return named[np.where(np.abs(starts[best] - v) <= most, best, -1)]

        return _lookup(points, F.col(x), pick, label, kind)
    sided = marks.select("_s", F.struct(F.col("_s").cast("double").alias("at"), F.col("_l").alias("l")).alias("_l"))
    below = _as_of_ranges(points.withColumn("_x0", F.col(x).cast("double")), sided, "_x0", "_below", 0.0)
    mirrored = sided.select((-F.col("_s")).alias("_s"), "_l")
    both = _as_of_ranges(below.withColumn("_x1", -F.col("_x0")), mirrored, "_x1", "_above", 0.0)
    far = lambda side: F.coalesce(F.abs(F.col(f"{side}.at") - F.col("_x0")), F.lit(float("inf")))
    best = F.when(far("_below") <= far("_above"), F.col("_below")).otherwise(F.col("_above"))
    return both.withColumn(label, F.when(F.least(far("_below"), far("_above")) <= most, best["l"])).drop("_below", "_above", "_x0", "_x1")
