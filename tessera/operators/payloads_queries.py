"""Plans over parsed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.payloads import html_nodes, robots_allowed


def gate(urls: DataFrame, rules: DataFrame) -> DataFrame:
    return robots_allowed(urls, rules).select("page_id", "path", "allowed")


def tag_counts(pages: DataFrame) -> DataFrame:
    nodes = pages.select("page_id", F.explode(html_nodes(F.col("html"))).alias("n"))
    return nodes.groupBy("n.tag").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("page_id").alias("n_pages"))
