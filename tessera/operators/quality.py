"""Field rules of articles and researchers, and the report of how complete the data are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import percent, web_url

from .relational import violations

#: What the fields may hold.
ABSTRACT_STATES = ("found", "truncated", "too_short", "not_found", "api_error", "publisher_unavailable", "pending")
PROFILE_STATES = ("matched", "ambiguous", "not_found", "blocked", "error", "pending")
PRECISIONS, EMBEDDED, SOURCES = ("day", "month", "year"), ("title_abstract", "title_only", "abstract_only", "none"), ("google_scholar", "openalex", "none")
YEAR_MIN = 1900


def _unknown(name: str, values: tuple[str, ...], optional: bool = False) -> tuple[Column, str]:
    bad = ~F.col(name).isin(*values)
    return bad if optional else F.col(name).isNull() | bad, f"not one of {', '.join(values)}"


def _blank(name: str) -> tuple[Column, str]:
    return F.col(name).isNull() | (F.trim(name) == ""), "missing"


def _address(name: str) -> tuple[Column, str]:
    return F.col(name).isNotNull() & web_url(F.col(name)).isNull(), "no web address"


def article_errors(articles: DataFrame) -> DataFrame:
    """(article_id, field, message) for each rule that an article breaks."""
    blank = F.exists("auteurs", lambda a: a.isNull() | (F.trim(a) == ""))
    rules = {
        "article_id": (~F.coalesce(F.col("article_id").rlike(r"^art_\d+$"), F.lit(False)), "no article id"),
        "titre": _blank("titre"),
        "auteurs": (blank, "an empty author"),
        "annee": (~F.col("annee").between(YEAR_MIN, F.year(F.current_date()) + 1), "implausible year"),
        "date_precision": _unknown("date_precision", PRECISIONS, True),
        "citations": (F.col("citations") < 0, "negative"),
        "scholar_url": _address("scholar_url"),
        "pdf_url": _address("pdf_url"),
        "doi": (~F.col("doi").rlike(r"^10\.\d{4,9}/\S+$"), "no DOI"),
        "abstract_status": _unknown("abstract_status", ABSTRACT_STATES),
        "embedding_source": _unknown("embedding_source", EMBEDDED),
    }
    return violations(articles, "article_id", rules)


def researcher_errors(people: DataFrame) -> DataFrame:
    """(chercheur_id, field, message) for each rule that a researcher breaks."""
    rules = {m: (F.col(m) < 0, "negative") for m in ("citations_totales", "h_index", "i10_index")}
    rules |= {"nom_complet": _blank("nom_complet"), "scholar_url": _address("scholar_url"), "scholar_profile_status": _unknown("scholar_profile_status", PROFILE_STATES), "profile_match_confidence": (~F.col("profile_match_confidence").between(0, 1), "not between 0 and 1"), "data_source": _unknown("data_source", SOURCES)}
    return violations(people, "chercheur_id", rules)


def _long(one: DataFrame) -> DataFrame:
    """A row of numbers as rows (metric, label, value)."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit(None).cast("string").alias("label"), F.col(c).cast("double").alias("value")) for c in one.columns]))
    return one.select(rows.alias("m")).select("m.*")


def _counted(df: DataFrame, column: str, metric: str, missing: str = "(aucune)") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(metric).alias("metric"), "label", "value")


def quality_report(people: DataFrame, articles: DataFrame, links: DataFrame, raw: DataFrame, states: DataFrame, stats: DataFrame, errors: DataFrame) -> DataFrame:
    """(metric, label, value): counts and shares over the data collected, and counts by state and source.

    Shares of nothing are null.  stats is (metric, n) of cleaning, errors the rules broken.
    """
    n = F.count(F.lit(1))
    status = F.coalesce(F.col("scholar_profile_status") != "matched", F.lit(True))
    persons = people.agg(n.alias("researchers"), percent(F.count_if(status), n).alias("pct_researchers_without_profile"))
    works = articles.agg(
        n.alias("unique_publications"), F.count("doi").alias("publications_with_doi"), percent(F.count("doi"), n).alias("pct_publications_with_doi"), F.count("abstract_clean").alias("abstracts"),
        percent(n - F.count("abstract_clean"), n).alias("pct_publications_without_abstract"), F.count_if(F.col("annee").isNull()).alias("publications_without_year"),
    )
    bad = lambda c: F.coalesce(F.col(c).isin("error", "blocked"), F.lit(False))
    parts = [
        _long(persons), _long(works), _long(links.agg(n.alias("links"))), _long(raw.agg(F.count_if(F.col("scrape_status") == "detail_error").alias("detail_errors"))),
        _long(states.agg(F.count_if(bad("scholar_profile_status") | bad("collection_status")).alias("researchers_in_error_or_blocked"))), _long(errors.agg(n.alias("validation_errors"))),
        _counted(people, "scholar_profile_status", "researchers_by_status"), _counted(people, "data_source", "researchers_by_source"), _counted(articles, "abstract_status", "abstracts_by_status"),
        _counted(articles, "abstract_source", "abstracts_by_source"), _counted(articles, "embedding_source", "embedding_source"), stats.select(F.lit("cleaning").alias("metric"), F.col("metric").alias("label"), F.col("n").cast("double").alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summary(people: DataFrame, articles: DataFrame, links: DataFrame, top: int = 10) -> DataFrame:
    """One row: counts, h-index, articles by year, states of abstracts, and the people of most publications."""
    n = F.count(F.lit(1))
    as_map = lambda df, key: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), "n")))))
    by_year = as_map(articles.where("annee is not null").groupBy("annee").agg(n.alias("n")), "annee").toDF("articles_by_year")
    by_state = as_map(articles.groupBy("abstract_status").agg(n.alias("n")), "abstract_status").toDF("abstracts_by_status")
    most = links.groupBy("chercheur_id").agg(F.countDistinct("article_id").alias("n")).orderBy(F.col("n").desc(), "chercheur_id").limit(top)
    named = most.join(people.select("chercheur_id", "nom_complet"), "chercheur_id", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "chercheur_id", "nom_complet", "n"))), lambda s: F.struct(s["chercheur_id"].alias("chercheur_id"), s["nom_complet"].alias("nom_complet"), s["n"].alias("n"))).alias("most_publications"))
    one = people.agg(n.alias("researchers"), F.count("h_index").alias("with_h_index"), F.median("h_index").alias("h_index_median"), F.max("h_index").alias("h_index_max"))
    return one.join(articles.agg(n.alias("articles"), F.round(100 * F.avg(F.col("abstract_clean").isNotNull().cast("int")), 1).alias("pct_with_abstract"))).join(links.agg(n.alias("links"))).join(by_year).join(by_state).join(named)
