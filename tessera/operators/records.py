"""Raw publication records to clean rows, one article for each work, and the rows of researchers.

Column names are those of the data model: raw records and states come in as they were collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import values as vl

from . import dedup

#: Text fields that are only cleaned lightly, and what a state of an abstract may say.
PLAIN = ("journal", "conference", "volume", "numero", "pages", "publisher")
KEPT_WITHOUT_TEXT = ("api_error", "publisher_unavailable")
PROFILE = "https://scholar.google.com/citations?user="
METRICS = ("citations", "h_index", "i10_index")


def abstract_state(clean: Column, status: Column, least: int) -> Column:
    """The state of an abstract after cleaning: what is said of a missing one stays, a short one is too_short."""
    missing = F.when(status.isin(*KEPT_WITHOUT_TEXT), status).otherwise("not_found")
    return F.when(clean.isNull(), missing).when(F.length(clean) < least, "too_short").when(status.isin("found", "truncated"), status).otherwise("found")


def clean_publications(raw: DataFrame, least_abstract: int = 50, year_min: int = 1950) -> DataFrame:
    """The clean fields of every raw record; other columns (an order of the records, say) stay.

    abstract keeps the raw text, abstract_clean is for language models; a list of affiliations is no abstract.
    """
    c = F.col
    new = {f: tx.clean_light(c(f)) for f in ("titre", *PLAIN)}
    usable = F.when(~tx.looks_like_affiliation(c("abstract")), c("abstract"))
    date = vl.publication_date(c("_told"), vl.year_or_null(c("annee"), year_min))
    new |= {"auteurs": tx.clean_light_all(c("auteurs")), "_date": date, "_abstract": usable, "abstract_clean": tx.clean_abstract(tx.clean_light(usable)), "citations": vl.count_or_null(c("citations"))}
    new |= {u: vl.web_url(tx.clean_light(c(u))) for u in ("scholar_url", "pdf_url")}
    new |= {"doi": F.coalesce(tx.normalize_doi(c("doi")), tx.extract_doi(c("external_url")))}
    out = raw.withColumn("_told", tx.clean_light(c("date_publication_raw"))).withColumns(new)
    text, source = tx.embedding_text(c("titre"), c("abstract_clean"), least_abstract)
    has = c("abstract_clean").isNotNull()
    out = out.withColumns({"annee": c("_date.year"), "date_publication": c("_date.date"), "date_precision": c("_date.precision"), "abstract_status": abstract_state(c("abstract_clean"), c("abstract_status"), least_abstract), "abstract": F.when(has, c("_abstract")), "abstract_source": F.when(has, c("abstract_source")), "embedding_text": text, "embedding_source": source})
    return out.drop("_date", "_abstract", "_told", "date_publication_raw", "external_url")


def screen(raw: DataFrame, people: DataFrame | None = None, person: str = "chercheur_id") -> DataFrame:
    """The records with reject: outside (no known person), no_title, or null for those that go on."""
    title = F.coalesce(F.length(tx.clean_light(F.col("titre"))), F.lit(0)) == 0
    if people is None:
        return raw.withColumn("reject", F.when(title, "no_title"))
    known = people.select(F.col(person).alias("_known")).distinct()
    return raw.join(known, F.col(person) == F.col("_known"), "left").withColumn("reject", F.when(F.col("_known").isNull(), "outside").when(title, "no_title")).drop("_known")


def resolve(raw: DataFrame, people: DataFrame | None = None, threshold: float = dedup.THRESHOLD, least_abstract: int = 50, year_min: int = 1950) -> dict[str, DataFrame]:
    """articles, links and stats of raw records (rid, the order of the records, and the raw fields)."""
    screened = screen(raw, people)
    cleaned = clean_publications(screened.where(F.col("reject").isNull()).drop("reject"), least_abstract, year_min).withColumn("title_key", tx.match_key(F.col("titre")))
    keyed = dedup.group_records(cleaned.withColumn("year", F.col("annee")), threshold)
    articles = dedup.number_articles(merge_groups(keyed))
    links = dedup.owner_links(articles, "source_raw_pub_ids").withColumnsRenamed({"owner": "chercheur_id", "raw_id": "raw_pub_id"})
    return {"articles": articles, "links": links, "stats": cleaning_counts(screened, articles, links)}


def merge_groups(grouped: DataFrame) -> DataFrame:
    """One article for each root: every field from the best record that has it, the authors of the first longest list,
    the most citations, owners and raw ids of all.

    The best record has a DOI, a whole abstract, a long one, many citations; the first of equals.  An empty text or
    list counts as missing.  Fields are aggregates with partial results, so a large group is no window.
    """
    size = lambda name: F.coalesce(F.length(name), F.lit(0))
    rank = F.struct((size("doi") == 0).cast("int").alias("no_doi"), F.coalesce(F.col("abstract_status") != "found", F.lit(True)).cast("int").alias("not_found"), (-size("abstract_clean")).alias("short"), (-F.coalesce("citations", F.lit(0))).alias("cited"), F.col("rid"))
    own = {"root", "rid", "auteurs", "citations", "chercheur_id", "raw_pub_id", "title_key", "year"}
    fields = [f for f in grouped.schema.fields if f.name not in own]

    def present(f) -> Column:
        kind, col = f.dataType.typeName(), F.col(f.name)
        return (F.length(col) > 0) if kind == "string" else (F.size(col) > 0) if kind in ("array", "map") else col.isNotNull()

    ordered = lambda name: F.transform(F.array_sort(F.collect_list(F.when(size(name) > 0, F.struct("rid", name)))), lambda s: s[name])
    merged = grouped.groupBy("root").agg(
        *[F.min_by(f.name, F.when(present(f), rank)).alias(f.name) for f in fields],
        F.min_by("auteurs", F.struct((-F.coalesce(F.size("auteurs"), F.lit(0))).alias("n"), F.col("rid"))).alias("auteurs"),
        F.max("citations").alias("citations"),
        F.min_by("title_key", F.when(size("title_key") > 0, rank)).alias("title_key"),
        F.min_by("year", F.when(F.col("year").isNotNull(), rank)).alias("year"),
        F.array_sort(F.collect_set(F.when(size("chercheur_id") > 0, F.col("chercheur_id")))).alias("chercheur_ids"),
        ordered("raw_pub_id").alias("source_raw_pub_ids"),
        F.count(F.lit(1)).cast("int").alias("n_source_records"),
    )
    return merged.withColumn("title_key", F.coalesce("title_key", F.lit("")))


def cleaning_counts(screened: DataFrame, articles: DataFrame, links: DataFrame) -> DataFrame:
    """(metric, n): how many records came in, were left out, merged, and linked."""
    given = screened.agg(F.count(F.lit(1)).alias("raw_records"), F.count_if(F.col("reject") == "no_title").alias("records_without_title_dropped"), F.count_if(F.col("reject") == "outside").alias("records_outside_target_institution"), F.count_if(F.col("reject").isNull()).alias("records_after_cleaning"))
    made = articles.agg(F.count(F.lit(1)).alias("unique_articles"), F.coalesce(F.sum(F.col("n_source_records") - 1), F.lit(0)).alias("duplicates_merged"))
    linked = links.agg(F.count(F.lit(1)).alias("links"))
    long = lambda one: one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("n")) for m in one.columns])).alias("m")).select("m.metric", "m.n")
    return long(given).unionByName(long(made)).unionByName(long(linked))


def new_publications(rows: DataFrame, details: bool = True) -> DataFrame:
    """Listing rows (chercheur_id, scholar_id, scholar_pub_id, titre, auteurs_listing, venue_raw, annee, citations,
    scholar_url) as raw records with every field; a record without an own id is named by its title and year."""
    own = F.coalesce(F.nullif("scholar_pub_id", F.lit("")), F.left(F.sha1(F.concat_ws("|", F.coalesce("titre", F.lit("None")), F.coalesce(F.col("annee").cast("string"), F.lit("None")))), F.lit(12)))
    from tessera.sources.payloads import listing_authors

    authors = F.coalesce(listing_authors(F.col("auteurs_listing")), F.array().cast("array<string>"))
    none = {f: F.lit(None).cast("string") for f in ("date_publication_raw", "journal", "conference", "volume", "numero", "pages", "publisher", "pdf_url", "external_url", "doi", "abstract", "abstract_source", "scrape_error")}
    cut = F.coalesce(F.col("auteurs_listing").rlike(r"(\.\.\.|…)\s*$"), F.lit(False))
    return rows.withColumns({"raw_pub_id": F.concat_ws("::", "chercheur_id", own), "auteurs": authors, "auteurs_truncated": cut, **none, "abstract_status": F.lit("pending"), "abstract_attempts": F.array().cast("array<struct<source:string,status:string>>"), "detail_status": F.lit("pending" if details else "skipped"), "scrape_status": F.lit("listed")}).drop("auteurs_listing")


# ---------------------------------------------------------------- states and researchers


def flatten(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each publication of the states, the states with n_publications_collected instead)."""
    each = states.select("chercheur_id", F.explode("publications").alias("_p")).select("chercheur_id", "_p.*")
    return each, states.withColumn("n_publications_collected", F.greatest(F.size("publications"), F.lit(0))).drop("publications")


def publications_of(states: DataFrame) -> Column:
    """How many publications a state has: the count it was given, else the length of its list."""
    size = F.greatest(F.size("publications"), F.lit(0)) if "publications" in states.columns else F.lit(0)
    return F.coalesce("n_publications_collected", size) if "n_publications_collected" in states.columns else size


def to_review(states: DataFrame) -> DataFrame:
    """The candidates of every state that a person has to decide: ambiguous ones, and those without a match."""
    open_ = states.where(F.col("scholar_profile_status").isin("ambiguous", "not_found"))
    return open_.select("chercheur_id", "nom_complet", "scholar_profile_status", F.explode_outer("candidates").alias("_c")).select("chercheur_id", "nom_complet", "scholar_profile_status", "_c.*")


def state_from_profile(profiles: DataFrame, most: int) -> DataFrame:
    """States of profiles (chercheur_id, scholar_id, profile, publications) saved by hand: sure, and complete."""
    return profiles.withColumns({"scholar_profile_status": F.lit("matched"), "profile_match_confidence": F.lit(1.0), "match_method": F.lit("saved_page"), "collection_status": F.lit("complete"), "publications": F.slice("publications", 1, most)})


def profile_url(external_id: Column) -> Column:
    return F.concat(F.lit(PROFILE), external_id)


def profile_metrics(profile: str = "profile", window: int = 2021) -> dict[str, Column]:
    """Counts of a profile (metrics map, since_year); those since 2021 only if the profile's window begins then."""
    metric = lambda name: vl.count_or_null(F.try_element_at(F.col(f"{profile}.metrics"), F.lit(name)))
    since = F.col(f"{profile}.since_year")
    out = {"citations_totales" if m == "citations" else m: metric(m) for m in METRICS} | {"since_year": since}
    out |= {f"{m}_since": metric(f"{m}_since") for m in METRICS}
    return out | {f"{m}_since_{window}": F.when(since == window, metric(f"{m}_since")) for m in METRICS}


def of_institution(members: DataFrame, institution: str, column: str = "etablissement") -> DataFrame:
    """Members whose institution has the matching key of the one asked for; none is the empty one."""
    return members.where(tx.match_key(F.col(column)) == tx.match_key(F.lit(institution)))


def researchers(members: DataFrame, states: DataFrame, known_ids: DataFrame, institution: str, allowed: DataFrame | None = None) -> DataFrame:
    """One row for each person of the institution, with the state collected, if any.

    members: rid, chercheur_id, nom_complet, chercheur_source_name, etablissement, laboratoire, equipe, type_membre,
    is_duplicate_row; states: chercheur_id, scholar_id, scholar_url, profile and statuses; known_ids: chercheur_id, external_id.
    """
    from .roster import one_per_person

    home = of_institution(members, institution).where(~F.col("is_duplicate_row"))
    home = home if allowed is None else home.join(allowed.select("chercheur_id").distinct(), "chercheur_id", "left_semi")
    people = one_per_person(home, "chercheur_id", "rid", ["nom_complet", "chercheur_source_name", "etablissement"], ["laboratoire", "equipe", "type_membre"]).withColumnRenamed("n_rows", "n_affectations")
    full = people.join(states.withColumn("_n", publications_of(states)), "chercheur_id", "left").join(known_ids.select("chercheur_id", "external_id"), "chercheur_id", "left")
    full = full.withColumn("scholar_id", F.coalesce(F.nullif("scholar_id", F.lit("")), F.nullif("external_id", F.lit(""))))
    url = F.coalesce(vl.web_url(tx.clean_light(F.col("scholar_url"))), profile_url(F.col("scholar_id")))
    source = F.when(F.coalesce("_n", F.lit(0)) > 0, F.coalesce("data_source", F.lit("google_scholar"))).otherwise("none")
    columns = {"scholar_url": url, "affiliation": tx.clean_light(F.col("profile.affiliation")), "email_domain": F.col("profile.email_domain"), "interests": F.coalesce(tx.clean_light_all(F.col("profile.interests")), F.array().cast("array<string>")), **profile_metrics(), "scholar_profile_status": F.coalesce("scholar_profile_status", F.lit("pending")), "collection_status": F.coalesce("collection_status", F.lit("n/a")), "data_source": source}
    return full.withColumns(columns).drop("profile", "publications", "_n", "external_id", "n_publications_collected")


def collected(primary: DataFrame, fallback: DataFrame, sources: list, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(publications, states, new cache rows): of each person the state that counts, its publications enriched.

    States: chercheur_id, scholar_profile_status, publications; a matched state with publications is good.
    """
    from .enrich import enrich_all, work_key
    from .relational import prefer

    values = ["scholar_profile_status", "publications"]
    good = (F.col("scholar_profile_status") == "matched") & (F.size("publications") > 0)
    each, states = flatten(prefer(primary, fallback, "chercheur_id", good, values))
    keyed = each.withColumn("key", F.when(F.length(F.trim("titre")) > 0, work_key(tx.match_key(F.col("titre")), F.col("annee"))))
    numbered = keyed.withColumn("rid", F.xxhash64("raw_pub_id"))  # which of equal works is asked for does not matter
    found, fresh = enrich_all(numbered, sources, cache)
    return found.drop("key", "rid"), states, fresh
