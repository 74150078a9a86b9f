"""Counts, shares and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import percent

MISSING_LABEL = "(non renseigné)"
SEPARATOR = r" \| "


def per_owner(owners: DataFrame, links: DataFrame, owner: str, item: str) -> DataFrame:
    """Distinct items of every owner, none counting as 0."""
    counts = links.groupBy(owner).agg(F.countDistinct(item).alias("n"))
    return owners.select(owner).distinct().join(counts, owner, "left").fillna({"n": 0})


def memberships(df: DataFrame, label: str, missing: str = MISSING_LABEL) -> DataFrame:
    """One row for each of several labels in a text."""
    return df.withColumn(label, F.explode(F.split(F.coalesce(F.col(label), F.lit(missing)), SEPARATOR)))


def per_membership(owners: DataFrame, links: DataFrame, owner: str, label: str, item: str) -> DataFrame:
    """Distinct items by label; an item of two labels counts for each."""
    return memberships(owners.select(owner, label), label).join(links.select(owner, item), owner).groupBy(label).agg(F.countDistinct(item).alias("n"))


def word_frequency(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    words = F.transform(F.split(F.col(column), separator), lambda x: F.lower(F.trim(x)))
    return df.select(F.explode(F.filter(words, lambda x: x != "")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str, missing: str = "missing") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def number_summary(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(column).alias("n"), F.median(column).alias("median"), F.max(column).alias("greatest"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal bins from the least to the greatest value, empty ones left out."""
    span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    bin_of = F.least(F.lit(bins), F.floor((F.col(column) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).cast("int") + 1)
    return df.where(F.col(column).isNotNull()).join(F.broadcast(span)).groupBy(F.coalesce(bin_of, F.lit(1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_missing, pct_present) for each column, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_missing")) for c in columns])).alias("r")
    return one.select("n", rows).select("r.field", "r.n_missing", percent(F.col("n") - F.col("r.n_missing"), F.col("n")).alias("pct_present"))


def coverage(df: DataFrame, status: str, present: Column) -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(present.cast("int")), 1).alias("pct"))


def as_markdown(title: str, scalars: dict, sections: dict[str, dict]) -> str:
    """A report of a few numbers as text."""
    lines = [f"# {title}", "", *[f"- {k}: {'-' if v is None else v}" for k, v in scalars.items()]]
    for name, values in sections.items():
        lines += ["", f"## {name}", "", *[f"- {k}: {v}" for k, v in values.items()]]
    return "\n".join(lines) + "\n"
