"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every document gets a hash-random key; its leading digits are a range of keys.  Sums by (source, range) are
prefix-summed within the source, running sums go on within each range, and the source is cut at its exact
budget.  No task holds a source: a range holds one part in 4096 of it.  Budgets over the source's size repeat
whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.shared import materialise

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
_RANGE_DIGITS = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares by weight, none above `most` times its source's size.

    The excess of capped sources goes to the others by weight.  Sorted by cap over weight, the capped
    sources come first, so one pass of running sums finds them.  One row for each source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * most
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    from_here = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    ahead = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    filled = (
        sources.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(whole))
        .withColumn("level", (F.col("total") - ahead) / F.sum("weight").over(from_here))
        .withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
    )
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"]
    return filled.withColumn("line", first).select("source", "source_size", F.when(F.col("capped") | F.col("line").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("line") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document.

    size is the number of words (null text: 0).  taken is the document's size times the whole epochs, plus its
    part of the last one up to the source's exact budget in whole words.  The same input gives the same mix.
    Rows alike in id and size are interchangeable.  A null source is a source, the last one.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.substring(F.md5(F.concat_ws("-", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(str(seed)))), 1, 16)
    sized = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")), "sized")
    sized = sized.withColumn("range", F.substring("key", 1, _RANGE_DIGITS))
    by_range = sized.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    offsets = by_range.withColumn("offset", F.sum("in_range").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)))
    budget = targets(by_range.groupBy("source").agg(F.sum("in_range").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = (
        offsets.alias("o")
        .join(budget.alias("b"), F.col("o.source").eqNullSafe(F.col("b.source")))
        .select(F.col("o.source").alias("p_source"), F.col("o.range").alias("p_range"), F.coalesce("offset", F.lit(0)).alias("offset"), "source_size", "target", epochs.cast("long").alias("epochs"))
        .withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    )
    running = F.sum("size").over(W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    return (
        sized.withColumn("running", running)
        .join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range")))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("running") + F.col("size")))).cast("long").alias("taken"))
    )


ORACLE_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(doc_id::VARCHAR || '-17'), 1, 16) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
r AS (SELECT *, CASE ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, source_size::DOUBLE * 3 AS cap FROM r),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
k AS (SELECT *, cap < level * weight AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, (SELECT level FROM k WHERE NOT capped ORDER BY cap / weight, source NULLS LAST LIMIT 1) * weight) END AS target FROM k),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
f AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS rest FROM e),
w AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM sized)
SELECT w.doc_id, w.source, w.size, f.source_size, f.target,
       (f.epochs * w.size + greatest(0, least(w.size, f.rest - w.running + w.size)))::BIGINT AS taken
FROM w JOIN f ON w.source IS NOT DISTINCT FROM f.source
"""
