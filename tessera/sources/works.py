"""Payloads of a bibliographic service, authors and works, as candidates, states and raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import values as vl

#: What is read of a payload.
WORK = "id string, display_name string, publication_year int, publication_date string, doi string, cited_by_count long, abstract_inverted_index map<string,array<int>>, type string, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string,type:string,host_organization_name:string>>, best_oa_location struct<pdf_url:string>"
AUTHOR = "id string, display_name string, works_count long, cited_by_count long, summary_stats struct<h_index:int,i10_index:int>, last_known_institutions array<struct<id:string,display_name:string>>, affiliations array<struct<institution:struct<id:string>>>, topics array<struct<display_name:string>>"


def works(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Payload columns with w, the work parsed from JSON."""
    return payloads.withColumn("w", F.from_json(payload, WORK))


def abstract_of(work: Column) -> Column:
    """The abstract put together again from its inverted index, unless it lists affiliations."""
    told = vl.words_from_index(work["abstract_inverted_index"])
    return F.when(~tx.looks_like_affiliation(told), told)


def work_records(parsed: DataFrame, name: str = "openalex") -> DataFrame:
    """Raw records of works (chercheur_id, w): the venue is a journal unless it is a conference."""
    w, source = F.col("w"), F.col("w.primary_location.source")
    venue, is_conference = tx.clean_light(source["display_name"]), F.coalesce(source["type"] == "conference", F.lit(False))
    pub = F.concat(F.lit("oa:"), vl.last_segment(w["id"]))
    names = tx.clean_light_all(F.filter(F.transform(w["authorships"], lambda a: a["author"]["display_name"]), lambda n: F.length(n) > 0))
    out = parsed.withColumns({"_abstract": abstract_of(w), "_venue": venue, "_pub": pub})
    has = F.col("_abstract").isNotNull()
    return out.select(
        *[c for c in parsed.columns if c != "w"],
        F.concat_ws("::", "chercheur_id", "_pub").alias("raw_pub_id"), F.col("_pub").alias("scholar_pub_id"), tx.clean_light(w["display_name"]).alias("titre"), F.coalesce(names, F.array().cast("array<string>")).alias("auteurs"), F.lit(False).alias("auteurs_truncated"), source["display_name"].alias("venue_raw"),
        w["publication_year"].alias("annee"), w["cited_by_count"].alias("citations"), w["publication_date"].alias("date_publication_raw"), F.when(~is_conference, F.col("_venue")).alias("journal"), F.when(is_conference, F.col("_venue")).alias("conference"), tx.clean_light(source["host_organization_name"]).alias("publisher"),
        tx.normalize_doi(w["doi"]).alias("doi"), w["best_oa_location"]["pdf_url"].alias("pdf_url"), F.col("_abstract").alias("abstract"), F.when(has, name).alias("abstract_source"), F.when(has, "found").otherwise("not_found").alias("abstract_status"), F.lit("skipped").alias("detail_status"), F.lit(name).alias("scrape_status"), F.lit(name).alias("data_source"),
    )


def most_cited(parsed: DataFrame, person: str, most: int) -> DataFrame:
    """At most so many works of each person, the most cited first."""
    from tessera.operators.relational import top_per_group

    return top_per_group(parsed, [person], [F.col("w.cited_by_count").desc_nulls_last(), F.col("w.id")], max(1, most), "_n").drop("_n")


def author_candidates(payloads: DataFrame, institution: str, payload: str = "payload") -> DataFrame:
    """Payload columns with author_id, name_key, works and at_home: now, or in the past, at the institution."""
    parsed = payloads.withColumn("a", F.from_json(payload, AUTHOR))
    now = F.transform("a.last_known_institutions", lambda i: vl.last_segment(i["id"]))
    past = F.transform("a.affiliations", lambda i: vl.last_segment(i["institution"]["id"]))
    known = lambda ids: F.coalesce(F.array_contains(ids, institution), F.lit(False))
    return parsed.withColumns({"author_id": vl.last_segment(F.col("a.id")), "name_key": tx.match_key(F.col("a.display_name")), "works": F.coalesce("a.works_count", F.lit(0)), "at_home": known(now) | known(past)})


def author_profile(author: Column) -> Column:
    """What a state says of an author: name, institutions, five topics and counts."""
    places = F.array_distinct(F.transform(author["last_known_institutions"], lambda i: i["display_name"]))
    counts = F.create_map(F.lit("citations"), author["cited_by_count"].cast("int"), F.lit("h_index"), author["summary_stats"]["h_index"], F.lit("i10_index"), author["summary_stats"]["i10_index"])
    return F.struct(author["display_name"].alias("name"), F.nullif(F.array_join(places, ", "), F.lit("")).alias("affiliation"), F.lit(None).cast("string").alias("email_domain"), F.slice(F.transform(author["topics"], lambda t: t["display_name"]), 1, 5).alias("interests"), counts.alias("metrics"), F.lit(None).cast("int").alias("since_year"))
