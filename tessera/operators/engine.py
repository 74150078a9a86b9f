"""A stored vector index and searches by text over it: records, and the people behind them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import shorten

from .embed import hashed_words
from .relational import top_per_group
from .vectors import faults, rank_owners, search, unit


def save_index(vectors: DataFrame, path: str, id_col: str, vector: str = "embedding") -> DataFrame:
    """Write unit vectors with all other columns, and one row about them, which is returned.

    Repeated or null ids, vectors of different lengths and missing or infinite components are errors.
    """
    found = faults(vectors, id_col, vector).first()
    if found.n != found.n_ids or found.n_bad or found.least_dim != found.most_dim:
        raise ValueError(f"not an index: {found.n} rows, {found.n_ids} ids, lengths {found.least_dim} to {found.most_dim}, {found.n_bad} vectors with bad components")
    spark = vectors.sparkSession
    vectors.withColumn(vector, unit(F.col(vector)).cast("array<float>")).write.mode("overwrite").parquet(f"{path}/vectors")
    info = spark.createDataFrame([(found.n, found.most_dim, id_col, vector)], "n long, dim long, id_col string, vector string")
    info.write.mode("overwrite").parquet(f"{path}/info")
    return info


class Engine:
    """Searches over an index with the tables of its records.

    records hold `item`, title, abstract, year, citations, doi, url and what else is wanted; people hold `person`, name,
    lab and team; links hold `item`, `person` and position, the order of an item's people.
    """

    def __init__(self, index: DataFrame, records: DataFrame, people: DataFrame, links: DataFrame, item: str = "article_id", person: str = "person_id", vector: str = "embedding", encode: Callable[[list[str]], np.ndarray] = hashed_words):
        self.index, self.records, self.people, self.links = index, records, people, links
        self.item, self.person, self.vector, self.encode = item, person, vector, encode

    @classmethod
    def load(cls, spark: SparkSession, path: str, records: DataFrame, people: DataFrame, links: DataFrame, **more) -> Engine:
        info = spark.read.parquet(f"{path}/info").first()
        return cls(spark.read.parquet(f"{path}/vectors"), records, people, links, item=info.id_col, vector=info.vector, **more)

    def _queries(self, texts: str | list[str]) -> DataFrame:
        texts = [texts] if isinstance(texts, str) else list(texts)
        if not texts or any(not t or not t.strip() for t in texts):
            raise ValueError("a query is blank")
        vectors = np.asarray(self.encode([t.strip() for t in texts]), np.float64)
        first = self.index.select(F.size(self.vector).alias("n")).first()
        if first and first.n != vectors.shape[1]:
            raise ValueError(f"the queries have {vectors.shape[1]} dimensions, the index {first.n}")
        return self.index.sparkSession.createDataFrame([(k, t, v.tolist()) for k, (t, v) in enumerate(zip(texts, vectors, strict=True))], "query_id int, text string, query array<double>")

    def hits(self, texts: str | list[str], k: int) -> DataFrame:
        """query_id, item, score and rank of the k nearest records of each query, ties to the smaller id."""
        return search(self.index, self._queries(texts), k, self.item, self.vector)

    def search(self, texts: str | list[str], k: int = 5) -> DataFrame:
        """Hits with their records, and their people in order; people not in the table are named by id only."""
        hits = self.hits(texts, k)
        told = hits.select(self.item).distinct().join(self.links.select(self.item, self.person, "position"), self.item).join(self.people.select(self.person, "name", "lab", "team"), self.person, "left")
        each = told.groupBy(self.item).agg(F.array_sort(F.collect_list(F.struct("position", self.person, "name", "lab", "team"))).alias("_p"))
        kinds = lambda field: F.array_distinct(F.filter(F.col(f"_p.{field}"), lambda x: x.isNotNull()))
        listed = each.select(self.item, F.col(f"_p.{self.person}").alias("person_ids"), F.filter(F.col("_p.name"), lambda x: x.isNotNull()).alias("people"), kinds("lab").alias("labs"), kinds("team").alias("teams"))
        url = F.coalesce(F.concat(F.lit("https://doi.org/"), F.col("doi")), F.col("url"))
        full = hits.join(self.records, self.item).join(listed, self.item, "left")
        for column in ("person_ids", "people", "labs", "teams"):
            full = full.withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
        return full.withColumns({"score": F.round("score", 4), "abstract": shorten(F.col("abstract")), "url": url}).orderBy("query_id", "rank")

    def search_people(self, texts: str | list[str], k: int = 5, pool: int = 100, m: int = 3) -> DataFrame:
        """People ranked by the mean of their m best records among the `pool` nearest, with these records."""
        hits = self.hits(texts, pool).select("query_id", self.item, "score")
        scored = rank_owners(hits, self.links, self.item, self.person, m)
        first = top_per_group(scored, ["query_id"], [F.col("owner_score").desc(), F.col("best").desc(), F.col(self.person)], max(1, k))
        named = hits.join(self.links.select(self.item, self.person).distinct(), self.item).join(self.records.select(self.item, "title"), self.item)
        best = top_per_group(named, ["query_id", self.person], [F.col("score").desc(), F.col(self.item)], m, "_n")
        top = best.groupBy("query_id", self.person).agg(F.array_sort(F.collect_list(F.struct("_n", self.item, "title", F.round("score", 4).alias("score")))).alias("_t"))
        items = F.transform("_t", lambda t: F.struct(t[self.item].alias(self.item), t["title"].alias("title"), t["score"].alias("score")))
        joined = first.join(top, ["query_id", self.person]).join(self.people, self.person, "left")
        return joined.withColumns({"owner_score": F.round("owner_score", 4), "best": F.round("best", 4), "top_items": items}).drop("_t").orderBy("query_id", "rank")
