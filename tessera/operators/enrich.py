"""Filling gaps of records from several sources in order of trust, and keyed state that resumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import extract_doi, is_truncated, normalize_doi

#: Characters of a whole abstract from a service, and from a publisher's page.
FULL, PAGE = 80, 150


ATTEMPTS = "array<struct<source:string,status:string>>"


def enrich(publications: DataFrame, sources: list[tuple[str, DataFrame]], key: str = "key", publisher_pages: DataFrame | None = None) -> DataFrame:
    """Publications completed by services, in order, each row of a service's table answering one key.

    publications: key, doi, external_url, pdf_url, abstract, abstract_source, abstract_status, journal, conference,
    publisher.  sources: (name, table of key, status, doi, abstract, journal, publisher), status api_error for a failed
    call.  A service is asked until whole abstract, DOI and venue are there.  An abstract is taken if it is whole, has 80
    characters, is longer than the own one, and none was whole before.  Journal and publisher are filled only where missing,
    from the first service that has them.  publisher_pages: key, status, abstract; read where a DOI is known and no
    whole abstract.  attempts lists (source, status) of all that were asked; final is false after a failed call.
    """
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    doi = F.coalesce(normalize_doi(F.col("doi")), extract_doi(F.col("external_url")), extract_doi(F.col("pdf_url")))
    out = publications.withColumns({"doi": doi, "_full": F.coalesce(F.col("abstract_status") == "found", F.lit(False)), "_venue": has(F.col("journal")) | has(F.col("conference")), "_journal": F.lit(None).cast("string"), "_publisher": F.lit(None).cast("string"), "attempts": F.array().cast(ATTEMPTS)})

    def asked(out: DataFrame, name: str, status: Column, ask: Column) -> dict[str, Column]:
        abstract = F.when(ask, F.col("_t.abstract"))
        whole = F.coalesce(~is_truncated(abstract) & (F.length(abstract) >= FULL), F.lit(False))
        take = whole & ~F.col("_full") & (F.length(abstract) > F.coalesce(F.length("abstract"), F.lit(0)))
        tried = F.array_append("attempts", F.struct(F.lit(name).alias("source"), status.alias("status")))
        return {"abstract": F.when(take, abstract).otherwise(F.col("abstract")), "abstract_source": F.when(take, F.lit(name)).otherwise(F.col("abstract_source")), "_full": F.col("_full") | take, "attempts": F.when(ask, tried).otherwise(F.col("attempts"))}

    for name, table in sources:
        out = out.join(table.select(F.col(key).alias("_k"), F.struct("status", "doi", "abstract", "journal", "publisher").alias("_t")), F.col(key) == F.col("_k"), "left").drop("_k")
        ask = ~(F.col("_full") & F.col("doi").isNotNull() & (F.col("_venue") | has(F.col("_journal"))))
        failed = F.coalesce(F.col("_t.status") == "api_error", F.lit(False))
        answer = F.when(ask & ~failed, F.col("_t"))
        out = out.withColumns({"_ask": ask, "_failed": failed, "_t": answer})
        status = F.when(F.col("_failed"), "api_error").when(has(F.col("_t.abstract")), "found").otherwise("not_found")
        more = {"doi": F.coalesce("doi", normalize_doi(F.col("_t.doi"))), "_journal": F.coalesce("_journal", F.nullif("_t.journal", F.lit(""))), "_publisher": F.coalesce("_publisher", F.nullif("_t.publisher", F.lit("")))}
        out = out.withColumns(asked(out, name, status, F.col("_ask")) | more).drop("_ask", "_failed", "_t")
    if publisher_pages is not None:
        out = out.join(publisher_pages.select(F.col(key).alias("_k"), F.struct("status", "abstract").alias("_t")), F.col(key) == F.col("_k"), "left").drop("_k")
        ask = ~F.col("_full") & F.col("doi").isNotNull()
        refused = F.coalesce(F.col("_t.status") != "ok", F.lit(True))
        out = out.withColumns({"_ask": ask, "_refused": refused})
        text = F.when(F.col("_ask") & ~F.col("_refused") & (F.length("_t.abstract") >= PAGE), F.col("_t.abstract"))
        status = F.when(F.col("_refused"), "publisher_unavailable").when(text.isNotNull(), "found").otherwise("not_found")
        tried = F.array_append("attempts", F.struct(F.lit("publisher_page").alias("source"), status.alias("status")))
        out = out.withColumns({"abstract": F.coalesce(text, "abstract"), "abstract_source": F.when(text.isNotNull(), "publisher_page").otherwise(F.col("abstract_source")), "_full": F.col("_full") | text.isNotNull(), "attempts": F.when(F.col("_ask"), tried).otherwise(F.col("attempts"))}).drop("_ask", "_refused", "_t")
    said = lambda what: F.exists("attempts", lambda a: a["status"] == what)
    missing = F.when(said("api_error"), "api_error").when(said("publisher_unavailable"), "publisher_unavailable").otherwise("not_found")
    state = F.when(F.col("_full"), "found").when(has(F.col("abstract")), F.when(is_truncated(F.col("abstract")), "truncated").otherwise("found")).otherwise(missing)
    filled = {"journal": F.when(F.col("_venue"), F.col("journal")).otherwise(F.coalesce("_journal", "journal")), "publisher": F.coalesce(F.nullif("publisher", F.lit("")), "_publisher"), "abstract_status": state, "final": ~said("api_error")}
    return out.withColumns(filled).drop("_full", "_venue", "_journal", "_publisher")


def work_key(title_key: Column, year: Column) -> Column:
    """Names a work whoever its authors are, so a shared one is asked for once."""
    return F.left(F.sha1(F.concat_ws("|", title_key, F.coalesce(year.cast("string"), F.lit("None")))), F.lit(16))


CACHED = ("doi", "abstract", "abstract_source", "abstract_status", "attempts", "journal", "publisher")


def enrich_all(publications: DataFrame, sources: list[tuple[str, DataFrame]], cache: DataFrame | None = None, publisher_pages: DataFrame | None = None, version: int = 2) -> tuple[DataFrame, DataFrame]:
    """(publications with what is known of their work, new rows for the cache).

    publications: rid, key (work_key) and the fields of enrich(); without a key none is asked for.  cache: key, the
    fields CACHED, final and version.  Final rows of this version are used again, each other work is enriched once, as its first
    record has it.  Journal and publisher of a cached row only fill what is missing.
    """
    known = publications.limit(0).select("key") if cache is None else cache.where(F.col("final") & (F.col("version") == version)).select("key").distinct()
    todo = publications.where("key is not null").join(known, "key", "left_anti")
    first = todo.groupBy("key").agg(F.min_by(F.struct(*[c for c in publications.columns if c != "key"]), "rid").alias("_f")).select("key", "_f.*")
    fresh = enrich(first, sources, publisher_pages=publisher_pages).select("key", *CACHED, "final", F.lit(version).alias("version"))
    told = fresh if cache is None else fresh.unionByName(cache.where(F.col("final") & (F.col("version") == version)).select(*fresh.columns))
    found = told.select("key", F.struct(*CACHED).alias("_c"))
    empty = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    columns = {c: F.when(F.col("_c").isNull(), F.col(c) if c in publications.columns else F.array().cast(ATTEMPTS)).when(~empty(c) if c in ("journal", "publisher") else F.lit(False), F.col(c) if c in publications.columns else F.lit(None)).otherwise(F.col(f"_c.{c}")) for c in CACHED}
    return publications.join(found, "key", "left").withColumns(columns).drop("_c"), fresh


def pending(keys: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Keys without a final state: not_found, ambiguous, or matched and complete."""
    done = state.where(F.col("status").isin("not_found", "ambiguous") | ((F.col("status") == "matched") & F.col("complete"))).select(key)
    return keys.join(done, key, "left_anti")


def merge_detail(row: list[str], prefix: str = "d_", abstract: str = "abstract") -> dict[str, Column]:
    """Columns overwritten by a detail that is not empty; a new abstract is found or truncated."""
    out = {c: F.coalesce(F.nullif(F.col(f"{prefix}{c}"), F.lit("")), F.col(c)) for c in row}
    if abstract in row:
        new = F.length(f"{prefix}{abstract}") > 0
        out |= {"abstract_status": F.when(new, F.when(is_truncated(F.col(f"{prefix}{abstract}")), "truncated").otherwise("found")).otherwise(F.col("abstract_status"))}
    return out
