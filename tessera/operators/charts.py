"""The tables behind the charts of a description: what a plotting library would be given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import shorten

from .relational import dense_counts
from .reports import histogram, memberships, per_owner, word_frequency


def chart_tables(people: DataFrame, articles: DataFrame, links: DataFrame, top: int = 15) -> dict[str, DataFrame]:
    """Bars and histograms by name, each (label, n) or (bin, n), in the order they are drawn.

    people: chercheur_id, nom_complet, laboratoire, interests, citations_totales, h_index, scholar_profile_status; articles:
    article_id, annee, abstract_status; links: chercheur_id, article_id.
    """
    named = people.select("chercheur_id", "nom_complet")
    bars = lambda df: df.orderBy(F.col("n").desc(), "label").limit(top)
    mine = per_owner(people, links, "chercheur_id", "article_id").join(named, "chercheur_id").select(F.col("nom_complet").alias("label"), "n")
    owners = memberships(people.select("chercheur_id", "laboratoire"), "laboratoire")
    by_lab = owners.join(links.select("chercheur_id", "article_id"), "chercheur_id").groupBy(F.col("laboratoire").alias("label")).agg(F.countDistinct("article_id").alias("n"))
    in_lab = owners.groupBy(F.col("laboratoire").alias("label")).agg(F.countDistinct("chercheur_id").alias("n"))
    cited = people.where("scholar_profile_status = 'matched' AND citations_totales IS NOT NULL").select(F.col("nom_complet").alias("label"), F.col("citations_totales").alias("n"))
    topics = word_frequency(people.select(F.array_join("interests", ";").alias("interests")), "interests").select(F.col("word").alias("label"), "n")
    kinds = people.agg(F.countDistinct("h_index").alias("k")).first().k
    return {
        "publications_by_person": bars(mine), "publications_by_lab": by_lab.orderBy(F.col("n").desc(), "label").select(shorten(F.col("label"), 42).alias("label"), "n"), "people_by_lab": in_lab.orderBy(F.col("n").desc(), "label"),
        "citations_by_person": bars(cited), "interests": bars(topics), "articles_by_year": dense_counts(articles.select(F.col("annee").alias("label")), "label").orderBy("label"),
        "h_index": histogram(people, "h_index", min(15, max(3, kinds))), "abstracts": articles.groupBy(F.col("abstract_status").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy("label"),
    }
