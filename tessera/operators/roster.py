"""Rosters: one row for each person, counts about members, and identifiers entered by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import MISSING_LABEL


def one_per_person(rows: DataFrame, person: str, order: str, first: list[str], joined: list[str], separator: str = " | ") -> DataFrame:
    """One row for each person: first values by order, and distinct labels joined in order of first sight.

    Labels are made distinct before they are collected, so a person of many rows costs one entry a label.
    Blank labels are left out; without any the result is null.
    """
    out = rows.groupBy(person).agg(*[F.min_by(c, order).alias(c) for c in first], F.count(F.lit(1)).alias("n_rows"))
    for c in joined:
        seen = rows.where(F.trim(c) != "").groupBy(person, c).agg(F.min(order).alias("_at"))
        labels = F.array_sort(F.collect_list(F.struct("_at", c)))
        out = out.join(seen.groupBy(person).agg(F.array_join(labels.getField(c), separator).alias(c)), person, "left")
    return out


def member_counts(rows: DataFrame, person: str, order: str, home: str, is_home: str, repeat: str = "is_repeat", lab: str = "lab", team: str = "team", kind: str = "kind") -> DataFrame:
    """(metric, label, n): rows, people, people by lab (a person's first) and by team, repeats, missing values."""
    inside = rows.where(is_home)
    named = lambda c: F.coalesce(F.col(c), F.lit(MISSING_LABEL))
    none = F.lit(None).cast("string")
    counted = lambda df, metric: df.select(F.lit(metric).alias("metric"), "label", F.col("count").alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(person).alias("people"), F.count_if(repeat).alias("repeats"), *[F.count_if(F.col(c).isNull()).alias(f"missing {c}") for c in (home, lab, team, kind)])
    home_total = inside.agg(F.countDistinct(person).alias("home people"), F.countDistinct(lab).alias("home labs"), F.countDistinct(named(lab), named(team)).alias("home teams"))
    several = rows.where(f"NOT {repeat}").groupBy(person).count().agg(F.count_if(F.col("count") > 1).alias("people of several rows"))
    by_lab = inside.groupBy(person).agg(F.min_by(named(lab), order).alias("label")).groupBy("label").count()
    by_team = inside.groupBy(F.concat_ws(" / ", named(lab), named(team)).alias("label")).agg(F.countDistinct(person).alias("count"))
    out = None
    for one in (total, home_total, several):
        pairs = F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in one.columns]), F.array(*[F.col(c).cast("long") for c in one.columns])))
        part = one.select(pairs.alias("metric", "n")).select("metric", none.alias("label"), "n")
        out = part if out is None else out.unionByName(part)
    for metric, table in (("people by lab", by_lab), ("people by team", by_team)):
        out = out.unionByName(counted(table, metric))
    for metric, column in (("rows by home", home), ("rows by kind", kind)):
        out = out.unionByName(counted(rows.groupBy(named(column).alias("label")).count(), metric))
    return out


def fill_ids(roster: DataFrame, old: DataFrame, new: DataFrame, person: str, external: str) -> DataFrame:
    """The roster with an identifier for each person: the new one, else the old one, else an empty text."""
    one = lambda df, name: df.groupBy(person).agg(F.max(F.trim(external)).alias(name))
    joined = roster.join(one(old, "_old"), person, "left").join(one(new, "_new"), person, "left")
    return joined.withColumn(external, F.coalesce("_new", "_old", F.lit(""))).drop("_old", "_new")


def status_counts(roster: DataFrame, states: DataFrame, person: str, status: str = "status", missing: str = "pending") -> DataFrame:
    """(status, n) over the roster; who has no state is pending."""
    return roster.select(person).join(states.select(person, status), person, "left").groupBy(F.coalesce(status, F.lit(missing)).alias(status)).agg(F.count(F.lit(1)).alias("n"))
