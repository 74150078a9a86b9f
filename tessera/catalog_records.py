"""Registered queries over records of publications, people and pages, made of the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import values as vl
from tessera.operators import dedup, enrich, layout, matching, quality, records, relational, reports, vectors
from tessera.plans.shared import materialise
from tessera.registry import query
from tessera.sources import payloads, works
from tessera.sources.readers import table

c = F.col


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Documents as raw records with gaps and faults: dates in all forms, years and counts out of range, odd addresses."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    i, size = c("doc_id"), F.length("text")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    s = lambda x: x.cast("string")
    date = F.when(i % 6 == 0, F.concat_ws("/", s(2010 + size % 10), s(size % 14), s(size % 33))).when(i % 6 == 1, F.concat_ws("/", s(2010 + size % 10), s(1 + size % 12))).when(i % 6 == 2, F.concat_ws(" ", F.lit("Mar"), s(2010 + size % 10))).when(i % 6 == 3, F.concat_ws(" ", F.lit("31 April"), s(2010 + size % 10))).when(i % 6 == 4, F.lit("soon"))
    null = F.lit(None).cast("string")
    return docs.select(
        i.alias("rid"), F.concat(F.lit("r"), s(i % 97), F.lit("::"), s(i)).alias("raw_pub_id"), F.concat(F.lit("r"), s(i % 97)).alias("chercheur_id"), F.when(i % 53 != 0, title).alias("titre"), F.split(F.left(title, F.lit(40)), " ").alias("auteurs"),
        F.when(i % 41 == 0, F.lit(1200)).when(i % 11 != 0, (2015 + size % 6).cast("int")).alias("annee"), date.alias("date_publication_raw"), (c("n_chars") % 60 - 5).alias("citations"), F.when(i % 7 == 0, F.concat(F.lit("https://doi.org/10.1234/"), F.upper(F.left(F.md5("text"), F.lit(8))), F.lit("."))).alias("doi"),
        F.when(i % 9 == 0, F.concat(F.lit("https://x.org/?doi=10.5555/a"), s(i), F.lit("&k=1"))).alias("external_url"), F.when(i % 10 == 0, "ftp://a.org/b").when(i % 10 == 1, F.concat(F.lit("https://a.org/"), s(i))).alias("pdf_url"), F.concat(F.lit(" https://s.org/"), s(i)).alias("scholar_url"),
        F.when(i % 13 != 0, F.substring(c("text"), F.length(title) + 2, size)).alias("abstract"), F.lit("list").alias("abstract_source"), F.when(c("quality") == 1, "found").when(c("quality") == 0, "truncated").when(i % 3 == 0, "api_error").alias("abstract_status"),
        F.concat(F.lit(" "), c("source"), F.lit("  x ")).alias("journal"), null.alias("conference"), s(size % 30).alias("volume"), null.alias("numero"), null.alias("pages"), c("lang").alias("publisher"), F.when(i % 17 == 0, "detail_error").otherwise("detail_ok").alias("scrape_status"),
    )


def _sql_light(x: str) -> str:
    return rf"nullif(trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '[\s]+', ' ', 'g')), '')"


_SQL_RAW = r"""raw AS (SELECT doc_id AS rid, 'r' || (doc_id % 97) || '::' || doc_id AS raw_pub_id, 'r' || (doc_id % 97) AS chercheur_id, CASE WHEN doc_id % 53 <> 0 THEN split_part(text, chr(10), 1) END AS titre, string_split(left(split_part(text, chr(10), 1), 40), ' ') AS auteurs,
  CASE WHEN doc_id % 41 = 0 THEN 1200 WHEN doc_id % 11 <> 0 THEN 2015 + length(text) % 6 END AS annee,
  CASE doc_id % 6 WHEN 0 THEN (2010 + length(text) % 10) || '/' || (length(text) % 14) || '/' || (length(text) % 33) WHEN 1 THEN (2010 + length(text) % 10) || '/' || (1 + length(text) % 12) WHEN 2 THEN 'Mar ' || (2010 + length(text) % 10) WHEN 3 THEN '31 April ' || (2010 + length(text) % 10) WHEN 4 THEN 'soon' END AS date_publication_raw,
  n_chars % 60 - 5 AS citations, CASE WHEN doc_id % 7 = 0 THEN 'https://doi.org/10.1234/' || upper(left(md5(text), 8)) || '.' END AS doi, CASE WHEN doc_id % 9 = 0 THEN 'https://x.org/?doi=10.5555/a' || doc_id || '&k=1' END AS external_url,
  CASE doc_id % 10 WHEN 0 THEN 'ftp://a.org/b' WHEN 1 THEN 'https://a.org/' || doc_id END AS pdf_url, ' https://s.org/' || doc_id AS scholar_url, CASE WHEN doc_id % 13 <> 0 THEN substr(text, length(split_part(text, chr(10), 1)) + 2) END AS abstract, 'list' AS abstract_source,
  CASE WHEN quality = 1 THEN 'found' WHEN quality = 0 THEN 'truncated' WHEN doc_id % 3 = 0 THEN 'api_error' END AS abstract_status, ' ' || source || '  x ' AS journal, (length(text) % 30)::VARCHAR AS volume, lang AS publisher, CASE WHEN doc_id % 17 = 0 THEN 'detail_error' ELSE 'detail_ok' END AS scrape_status
  FROM documents LEFT JOIN labels USING (doc_id))"""

_AFFILIATION = r"(?i)\b(universit\w*|laborator\w*|facult\w*|department|institute|institut|school|college|morocco|maroc|casablanca|france|spain|usa)\b"
_SQL_LISTED = rf"""coalesce(NOT regexp_matches(abstract, '(?i)\b(we|this paper|this study|this article|propose\w*|present\w*|show\w*|results?|aims?|investigat\w*|study|studies|approach|method)\b')
  AND ((len(regexp_extract_all(abstract, '{_AFFILIATION}')) >= 2 AND length(abstract) < 600) OR (regexp_matches(abstract, '^\d+\s?[A-Z]') AND len(regexp_extract_all(abstract, '{_AFFILIATION}')) >= 1)), false)"""

_SQL_CLEAN = (
    _SQL_RAW
    + rf""", a AS (SELECT *, {_sql_light('titre')} AS t, CASE WHEN NOT {_SQL_LISTED} THEN abstract END AS usable, regexp_extract(date_publication_raw, '^(\d{{4}})(?:/(\d{{1,2}}))?(?:/(\d{{1,2}}))?$', ['y', 'm', 'd']) AS n, date_publication_raw AS w,
  CASE WHEN annee BETWEEN 1950 AND year(current_date) + 1 THEN annee END AS known FROM raw),
b AS (SELECT *, nullif(lower(trim(regexp_replace(regexp_replace(regexp_replace({_sql_light('usable')}, '(?i)^\s*(abstract|résumé|resume|summary|description)\s*[:.\-–—]?\s+', ''), '\s*(…|\.{{3,}})\s*$', ''), '\s+', ' ', 'g'))), '') AS clean,
  coalesce(try_cast(n.y AS INTEGER), try_cast(nullif(regexp_extract(w, '(\d{{4}})$', 1), '') AS INTEGER)) AS y, coalesce(try_cast(n.m AS INTEGER), CASE WHEN w LIKE 'Mar %' THEN 3 WHEN w LIKE '% April %' THEN 4 END) AS m, coalesce(try_cast(n.d AS INTEGER), CASE WHEN w LIKE '% April %' THEN 31 END) AS d FROM a),
e AS (SELECT *, CASE WHEN m BETWEEN 1 AND 12 THEN m END AS gm, CASE WHEN m BETWEEN 1 AND 12 AND d IS NOT NULL AND try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', y, m, d) AS DATE) IS NOT NULL THEN d END AS gd,
  coalesce(lower(rtrim(regexp_extract(doi, '10\..*$'), '.')), nullif(regexp_extract(external_url, '10\.\d{{4,9}}/[^\s?#&]+'), '')) AS clean_doi FROM b),
cleaned AS (SELECT rid, raw_pub_id, chercheur_id, t AS titre, list_filter(auteurs, lambda x: x <> '') AS auteurs, coalesce(y, known) AS annee,
  CASE WHEN y IS NULL THEN known::VARCHAR WHEN gm IS NULL THEN y::VARCHAR WHEN gd IS NULL THEN format('{{:04d}}-{{:02d}}', y, gm) ELSE format('{{:04d}}-{{:02d}}-{{:02d}}', y, gm, gd) END AS date_publication,
  CASE WHEN y IS NULL THEN CASE WHEN known IS NOT NULL THEN 'year' END WHEN gm IS NULL THEN 'year' WHEN gd IS NULL THEN 'month' ELSE 'day' END AS date_precision, {_sql_light('journal')} AS journal, volume, publisher, CASE WHEN citations >= 0 THEN citations END AS citations,
  trim(scholar_url) AS scholar_url, CASE WHEN pdf_url LIKE 'http%' THEN pdf_url END AS pdf_url, clean_doi AS doi, CASE WHEN clean IS NOT NULL THEN usable END AS abstract, clean AS abstract_clean, CASE WHEN clean IS NOT NULL THEN abstract_source END AS abstract_source,
  CASE WHEN clean IS NULL THEN CASE WHEN abstract_status = 'api_error' THEN 'api_error' ELSE 'not_found' END WHEN length(clean) < 50 THEN 'too_short' WHEN abstract_status IN ('found', 'truncated') THEN abstract_status ELSE 'found' END AS abstract_status,
  CASE WHEN t IS NOT NULL AND length(clean) >= 50 THEN t || CASE WHEN right(t, 1) IN ('.', '!', '?', ':', ';') THEN ' ' ELSE '. ' END || clean WHEN t IS NOT NULL THEN t WHEN length(clean) >= 50 THEN clean END AS embedding_text,
  CASE WHEN t IS NOT NULL AND length(clean) >= 50 THEN 'title_abstract' WHEN t IS NOT NULL THEN 'title_only' WHEN length(clean) >= 50 THEN 'abstract_only' ELSE 'none' END AS embedding_source, scrape_status FROM e)"""
)
_FIELDS = "rid, titre, array_to_string(auteurs, '|') AS auteurs, annee, date_publication, date_precision, journal, volume, publisher, citations, scholar_url, pdf_url, doi, md5(abstract) AS abstract, md5(abstract_clean) AS abstract_clean, abstract_source, abstract_status, md5(embedding_text) AS embedding_text, embedding_source, scrape_status"


def _shown(df: DataFrame) -> list:
    hashed = ("abstract", "abstract_clean", "embedding_text")
    return [F.array_join(x, "|").alias(x) if x == "auteurs" else F.md5(x).alias(x) if x in hashed else c(x) for x in (n.strip().split(" AS ")[-1] for n in _FIELDS.replace("array_to_string(auteurs, '|')", "auteurs").split(",")) if x in df.columns]


@query(f"WITH {_SQL_CLEAN} SELECT {_FIELDS} FROM cleaned")
def clean_records(spark: SparkSession, d: str) -> DataFrame:
    """The clean fields of every raw record."""
    found = records.clean_publications(_raw(spark, d))
    return found.select(*_shown(found))


@query(f"WITH {_SQL_RAW} SELECT CASE WHEN chercheur_id IN (SELECT 'r' || s_suppkey FROM supplier WHERE s_suppkey < 90) THEN CASE WHEN coalesce({_sql_light('titre')}, '') = '' THEN 'no_title' ELSE 'kept' END ELSE 'outside' END AS fate, count(*) AS n FROM raw GROUP BY 1")
def screened_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of people who are not known, and records without a title, counted apart."""
    people = table(spark, d, "supplier").where("s_suppkey < 90").select(F.concat(F.lit("r"), c("s_suppkey").cast("string")).alias("chercheur_id"))
    return records.screen(_raw(spark, d), people).groupBy(F.coalesce("reject", F.lit("kept")).alias("fate")).agg(F.count(F.lit(1)).alias("n"))


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    """Clean records in groups of one length of text, large enough to show every rule of merging."""
    found = records.clean_publications(_raw(spark, d)).withColumns({"title_key": tx.match_key_ascii(F.coalesce("titre", F.lit(""))), "year": c("annee")})
    root = F.length(F.coalesce("titre", F.lit(""))) % 60
    first = found.groupBy(root.alias("_g")).agg(F.min("rid").alias("root"))
    return found.join(first, root == c("_g")).drop("_g")


@query(
    f"""WITH {_SQL_CLEAN}, g AS (SELECT *, min(rid) OVER (PARTITION BY length(coalesce(titre, '')) % 60) AS root, coalesce(length(abstract_clean), 0) AS size FROM cleaned),
o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY (doi IS NULL)::INTEGER, (abstract_status <> 'found')::INTEGER, -size, -coalesce(citations, 0), rid) AS k FROM g)
SELECT root, arg_min(titre, k) FILTER (titre IS NOT NULL) AS titre, arg_min(doi, k) FILTER (doi IS NOT NULL) AS doi, arg_min(pdf_url, k) FILTER (pdf_url IS NOT NULL) AS pdf_url, md5(arg_min(abstract_clean, k) FILTER (abstract_clean IS NOT NULL)) AS abstract_clean, arg_min(abstract_status, k) AS abstract_status, arg_min(journal, k) AS journal,
  max(citations) AS citations, array_to_string(arg_min(auteurs, -len(auteurs) * 1000000 + rid), '|') AS auteurs, array_to_string(list_sort(list_distinct(list(chercheur_id))), '|') AS chercheur_ids, array_to_string(list(raw_pub_id ORDER BY rid), '|') AS source_raw_pub_ids, count(*)::INTEGER AS n_source_records FROM o GROUP BY root"""
)
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    """One article for each group, fields from the best record that has them."""
    joined = {x: F.array_join(x, "|") for x in ("auteurs", "chercheur_ids", "source_raw_pub_ids")}
    return records.merge_groups(_grouped(spark, d)).withColumns(joined | {"abstract_clean": F.md5("abstract_clean")}).select("root", "titre", "doi", "pdf_url", "abstract_clean", "abstract_status", "journal", "citations", *joined, "n_source_records")


_SQL_ARTICLES = r"""r AS (SELECT o_custkey AS root, min(p_name) AS title_key, min(year(o_orderdate))::INTEGER AS year, list(o_custkey % 40 || '::' || o_orderkey ORDER BY o_orderkey) AS raw_ids FROM orders JOIN part ON p_partkey = o_orderkey % 150 GROUP BY 1),
n AS (SELECT *, format('art_{:05d}', row_number() OVER (ORDER BY title_key, coalesce(year, 0), root)) AS article_id FROM r)"""


def _articles(spark: SparkSession, d: str) -> DataFrame:
    given = table(spark, d, "orders").join(table(spark, d, "part"), c("p_partkey") == c("o_orderkey") % 150)
    raw = F.concat_ws("::", (c("o_custkey") % 40).cast("string"), c("o_orderkey").cast("string"))
    merged = given.groupBy(c("o_custkey").alias("root")).agg(F.min("p_name").alias("title_key"), F.min(F.year("o_orderdate")).alias("year"), F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", raw.alias("r")))), lambda x: x["r"]).alias("raw_ids"))
    return dedup.number_articles(merged)


@query(f"WITH {_SQL_ARTICLES} SELECT article_id, root, title_key, year FROM n")
def numbered_articles(spark: SparkSession, d: str) -> DataFrame:
    """Numbers by title, year and first record."""
    return _articles(spark, d).select("article_id", "root", "title_key", "year")


@query(f"WITH {_SQL_ARTICLES}, u AS (SELECT article_id, raw_id, k FROM (SELECT article_id, unnest(raw_ids) AS raw_id, unnest(range(len(raw_ids))) AS k FROM n)) SELECT split_part(raw_id, '::', 1) AS owner, article_id, arg_min(raw_id, k) AS raw_id FROM u GROUP BY 1, 2")
def article_links(spark: SparkSession, d: str) -> DataFrame:
    """D11"""
    return dedup.owner_links(_articles(spark, d), "raw_ids")


_SQL_POINTS = r"""r AS (SELECT doc_id AS rid, trim(regexp_replace(lower(regexp_replace(split_part(text, chr(10), 1), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS title_key,
  CASE WHEN doc_id % 11 <> 0 THEN 2015 + length(text) % 6 END AS year, CASE WHEN doc_id % 7 = 0 THEN md5(text) END AS doi FROM documents),
k AS (SELECT *, min(rid) OVER (PARTITION BY title_key, year, doi) AS point FROM r WHERE len(list_filter(string_split(title_key, ' '), lambda t: t <> '')) >= 3),
te AS (SELECT point AS src, rid AS dst FROM k WHERE rid <> point UNION ALL SELECT a.rid, b.rid FROM k a JOIN k b ON a.rid = a.point AND b.rid = b.point AND a.title_key = b.title_key AND a.rid < b.rid AND (a.year IS NULL OR b.year IS NULL OR a.year = b.year) AND coalesce(a.doi = b.doi, true)),
de AS (SELECT * FROM (SELECT min(rid) OVER (PARTITION BY doi) AS src, rid AS dst FROM r WHERE doi IS NOT NULL) WHERE src <> dst)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records: the first line as title, a year and a DOI made of the id."""
    docs = table(spark, d, "documents")
    year = F.when(c("doc_id") % 11 != 0, (F.lit(2015) + F.length("text") % 6).cast("int"))
    return docs.select(c("doc_id").alias("rid"), tx.match_key_ascii(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title_key"), year.alias("year"), F.when(c("doc_id") % 7 == 0, F.md5("text")).alias("doi"), "n_chars", "source")


@query(f"WITH {_SQL_POINTS} SELECT src, dst FROM te")
def title_edges(spark: SparkSession, d: str) -> DataFrame:
    """One title, years equal or unknown, no two DOIs; copies are a star."""
    return dedup.title_edges(_records(spark, d))


@query(f"WITH RECURSIVE {_SQL_POINTS}, e AS (SELECT src, dst FROM te UNION SELECT src, dst FROM de), s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), w(n, x) AS (SELECT a, a FROM s UNION SELECT w.n, s.b FROM w JOIN s ON w.x = s.a) SELECT n AS node, min(x) AS component FROM w GROUP BY n")
def exact_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the edges by DOI and by title."""
    from tessera.operators.components import connected_components

    given = _records(spark, d)
    return connected_components(dedup.doi_edges(given).unionByName(dedup.title_edges(given)))


@query()
def doc_groups(spark: SparkSession, d: str) -> DataFrame:
    """Records with the root of their group; the fuzzy edges have no SQL, see the tests."""
    return dedup.group_records(_records(spark, d)).select("rid", "root")


@query()
def doc_survivorship(spark: SparkSession, d: str) -> DataFrame:
    """One article for each group, numbered."""
    merged = dedup.survivors(dedup.group_records(_records(spark, d)), ["title_key", "year", "doi", "n_chars", "source"], [c("doi").isNull().cast("int"), -c("n_chars")])
    return dedup.number_articles(merged).select("article_id", "root", "title_key", "year", "n_source_records")


@query(
    r"""WITH p AS (SELECT p_partkey AS k, p_name AS a, string_split(p_name, ' ') AS w FROM part), v AS (SELECT k, a, unnest(['swap', 'glue', 'article', 'more', 'letters', 'empty']) AS kind, unnest([w[2] || ' ' || w[1], replace(a, ' ', ''), 'el' || w[1] || ' ' || w[2], a || ' lamp', 'el ' || w[2] || ' ' || w[1] , '']) AS b FROM p),
t AS (SELECT *, string_split(a, ' ') AS x, list_filter(string_split(b, ' '), lambda t: t <> '') AS y FROM v),
l AS (SELECT *, list_filter(x, lambda t: t NOT IN ('el', 'al')) AS bx, list_filter(y, lambda t: t NOT IN ('el', 'al')) AS by_ FROM t),
s AS (SELECT *, array_to_string(list_sort(string_split(array_to_string(x, ''), '')), '') AS lx, array_to_string(list_sort(string_split(array_to_string(y, ''), '')), '') AS ly, array_to_string(list_sort(string_split(array_to_string(bx, ''), '')), '') AS lbx, array_to_string(list_sort(string_split(array_to_string(by_, ''), '')), '') AS lby,
  array_to_string(list_sort(string_split(array_to_string(list_transform(bx, lambda t: CASE WHEN length(t) > 4 AND left(t, 2) IN ('el', 'al') THEN substr(t, 3) ELSE t END), ''), '')), '') AS ux, array_to_string(list_sort(string_split(array_to_string(list_transform(by_, lambda t: CASE WHEN length(t) > 4 AND left(t, 2) IN ('el', 'al') THEN substr(t, 3) ELSE t END), ''), '')), '') AS uy FROM l)
SELECT k, kind, CASE WHEN len(y) = 0 THEN 0.0::DOUBLE WHEN list_sort(list_distinct(x)) = list_sort(list_distinct(y)) THEN 1.0 WHEN lx = ly OR (lbx = lby AND lbx <> '') THEN 0.95 WHEN ux = uy AND ux <> '' THEN 0.93 WHEN len(list_intersect(x, y)) = len(list_distinct(x)) AND len(list_distinct(x)) >= 2 THEN 0.85 END AS score FROM s"""
)
def name_tiers(spark: SparkSession, d: str) -> DataFrame:
    """M1: every tier but the last, on names and ways to write them; the last has no SQL, see the tests."""
    w = F.split("p_name", " ")
    ways = {"swap": F.concat_ws(" ", w[1], w[0]), "glue": F.replace("p_name", F.lit(" "), F.lit("")), "article": F.concat(F.lit("el"), w[0], F.lit(" "), w[1]), "more": F.concat("p_name", F.lit(" lamp")), "letters": F.concat(F.lit("el "), w[1], F.lit(" "), w[0]), "empty": F.lit("")}
    each = table(spark, d, "part").select(c("p_partkey").alias("k"), c("p_name").alias("a"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), b.alias("b")) for k, b in ways.items()])).alias("v"))
    return each.select("k", c("v.kind").alias("kind"), matching.name_score(c("a"), c("v.b")).alias("score"))


@query(
    """WITH x AS (SELECT o_custkey AS person, o_orderkey AS candidate_id, 0.5 + (o_orderkey % 50) / 100.0::DOUBLE AS name_score, round((o_totalprice % 1000) / 1000, 3) AS score FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY score DESC, candidate_id) AS r, lead(score) OVER (PARTITION BY person ORDER BY score DESC, candidate_id) AS nxt FROM x WHERE name_score >= 0.66),
l AS (SELECT person, string_agg(candidate_id::VARCHAR, ',' ORDER BY score DESC, candidate_id) AS listing FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY score DESC, candidate_id) AS r FROM x) WHERE r <= 5 GROUP BY 1),
b AS (SELECT * FROM f WHERE r = 1), d AS (SELECT person, score, candidate_id, CASE WHEN score >= 0.7 AND (nxt IS NULL OR score - nxt >= 0.15) THEN 'matched' WHEN score >= 0.5 THEN 'ambiguous' ELSE 'not_found' END AS status FROM b)
SELECT person, coalesce(status, 'not_found') AS status, round(score, 3) AS confidence, CASE WHEN status = 'matched' THEN candidate_id END AS candidate_id, listing FROM l LEFT JOIN d USING (person)"""
)
def match_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The decision for each person, with the five best candidates."""
    given = table(spark, d, "orders").select(c("o_custkey").alias("person"), c("o_orderkey").alias("candidate_id"), (F.lit(0.5) + (c("o_orderkey") % 50) / 100).alias("name_score"), vl.scaled_round(c("o_totalprice") % 1000 / 1000, 3).alias("score"))
    listing = F.array_join(F.transform("listing", lambda x: x["candidate_id"].cast("string")), ",")
    return matching.decide(given, "person").select("person", "status", "confidence", "candidate_id", listing.alias("listing"))


_PLACE = "'Faculty of Sciences, City ' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN ', Great University' ELSE '' END AS affiliation"
_MAIL = "CASE WHEN s_suppkey % 4 = 0 THEN 'Mail.Great.Example' WHEN s_suppkey % 4 = 1 THEN 'other.example' END AS email_domain"


@query(
    f"""WITH p AS (SELECT s_suppkey AS person, s_name, {_PLACE}, {_MAIL} FROM supplier), k AS (SELECT *, trim(regexp_replace(lower(affiliation), '[^a-z0-9]+', ' ', 'g')) AS a, coalesce(lower(email_domain) LIKE '%great.example', false) AS mail FROM p),
e AS (SELECT person, regexp_matches(a, 'city 7\\b') AS faculty, regexp_matches(a, 'great university') OR mail AS university, mail AS email, regexp_matches(a, '\\bcity 1') AS city, person % 5 = 0 AS topic FROM k)
SELECT person, round(least(1.0::DOUBLE, 0.4 + CASE WHEN faculty THEN 0.25 ELSE 0 END + CASE WHEN university THEN 0.15 ELSE 0 END + CASE WHEN email THEN 0.1 ELSE 0 END + CASE WHEN city THEN 0.05 ELSE 0 END + CASE WHEN topic THEN 0.05 ELSE 0 END), 6) AS score, faculty, university, email, city, topic FROM e"""
)
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """M2, M3: evidence told from affiliation, mail and topics, and its weighted sum."""
    given = table(spark, d, "supplier").selectExpr("s_suppkey AS person", "s_name", _PLACE, _MAIL)
    key = tx.match_key_ascii(c("s_name"))
    people = given.select("person", key.alias("name_key"), F.lit("team of hydrology").alias("context_key"))
    candidates = given.select("person", c("person").alias("candidate_id"), key.alias("name_key"), tx.match_key_ascii(c("affiliation")).alias("affiliation_key"), "email_domain", F.array(F.when(c("person") % 5 == 0, "Hydrology").otherwise("team")).alias("interests"))
    found = matching.score_candidates(people, candidates, r"city 7\b", "great university", r"\bcity 1", "great.example", ["team", "of"])
    return found.select("person", F.round("score", 6).alias("score"), "evidence.*")


@query(
    r"""WITH p AS (SELECT doc_id AS k, CASE WHEN doc_id % 7 = 0 THEN '10.1234/' || doc_id END AS doi, CASE WHEN doc_id % 5 = 0 THEN left(text, 60) WHEN doc_id % 5 = 1 THEN left(text, 200) END AS own, doc_id % 10 = 1 AS full0, CASE WHEN doc_id % 4 = 0 THEN 'J' END AS venue, text, length(text) AS n FROM documents),
a AS (SELECT *, NOT (full0 AND doi IS NOT NULL AND venue IS NOT NULL) AS ask1, k % 11 = 0 AS bad1, CASE WHEN k % 11 <> 0 AND k % 3 = 0 THEN left(text, 150) END AS t1 FROM p),
b AS (SELECT *, coalesce(ask1 AND NOT full0 AND length(t1) >= 80 AND NOT regexp_matches(t1, '(…|\.{3,})\s*$') AND length(t1) > coalesce(length(own), 0), false) AS take1, CASE WHEN doi IS NOT NULL THEN doi WHEN ask1 AND NOT bad1 AND k % 3 = 0 THEN '10.5555/' || k END AS doi1, CASE WHEN ask1 AND NOT bad1 AND k % 3 = 0 THEN 'Found' END AS j1 FROM a),
c AS (SELECT *, full0 OR take1 AS full1, CASE WHEN take1 THEN t1 ELSE own END AS x1 FROM b),
e AS (SELECT *, NOT (full1 AND doi1 IS NOT NULL AND (venue IS NOT NULL OR j1 IS NOT NULL)) AS ask2, CASE WHEN k % 2 = 0 THEN left(text, 300) || CASE WHEN k % 6 = 0 THEN ' ...' ELSE '' END END AS t2 FROM c),
f AS (SELECT *, coalesce(ask2 AND NOT full1 AND length(t2) >= 80 AND NOT regexp_matches(t2, '(…|\.{3,})\s*$') AND length(t2) > coalesce(length(x1), 0), false) AS take2 FROM e)
SELECT k AS key, doi1 AS doi, md5(CASE WHEN take2 THEN t2 ELSE x1 END) AS abstract, CASE WHEN take2 THEN 'two' WHEN take1 THEN 'one' WHEN own IS NOT NULL THEN 'own' END AS abstract_source,
  CASE WHEN full1 OR take2 THEN 'found' WHEN length(x1) > 0 THEN CASE WHEN regexp_matches(x1, '(…|\.{3,})\s*$') THEN 'truncated' ELSE 'found' END WHEN ask1 AND bad1 THEN 'api_error' ELSE 'not_found' END AS abstract_status, CASE WHEN venue IS NOT NULL THEN venue ELSE j1 END AS journal,
  concat_ws(',', CASE WHEN ask1 THEN 'one:' || CASE WHEN bad1 THEN 'api_error' WHEN t1 IS NOT NULL THEN 'found' ELSE 'not_found' END END, CASE WHEN ask2 THEN 'two:' || CASE WHEN t2 IS NOT NULL THEN 'found' ELSE 'not_found' END END) AS attempts, NOT (ask1 AND bad1) AS final FROM f"""
)
def enriched_records(spark: SparkSession, d: str) -> DataFrame:
    """Abstract, DOI and journal from two services, the first of which fails at times."""
    docs = table(spark, d, "documents")
    i, null = c("doc_id"), F.lit(None).cast("string")
    given = docs.select(
        i.alias("key"), F.when(i % 7 == 0, F.concat(F.lit("10.1234/"), i.cast("string"))).alias("doi"), null.alias("external_url"), null.alias("pdf_url"), F.when(i % 5 == 0, F.left("text", F.lit(60))).when(i % 5 == 1, F.left("text", F.lit(200))).alias("abstract"),
        F.when(i % 5 < 2, "own").alias("abstract_source"), F.when(i % 10 == 1, "found").alias("abstract_status"), F.when(i % 4 == 0, "J").alias("journal"), null.alias("conference"), null.alias("publisher"),
    )
    fine = i % 3 == 0
    one = docs.select(i.alias("key"), F.when(i % 11 == 0, "api_error").otherwise("ok").alias("status"), F.when(fine, F.concat(F.lit("10.5555/"), i.cast("string"))).alias("doi"), F.when(fine, F.left("text", F.lit(150))).alias("abstract"), F.when(fine, "Found").alias("journal"), null.alias("publisher"))
    two = docs.where(i % 2 == 0).select(i.alias("key"), F.lit("ok").alias("status"), null.alias("doi"), F.concat(F.left("text", F.lit(300)), F.when(i % 6 == 0, " ...").otherwise("")).alias("abstract"), null.alias("journal"), null.alias("publisher"))
    attempts = F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["source"], a["status"])), ",")
    return enrich.enrich(given, [("one", one), ("two", two)]).select("key", "doi", F.md5("abstract").alias("abstract"), "abstract_source", "abstract_status", "journal", attempts.alias("attempts"), "final")


_SQL_WORK = """w AS (SELECT event_id, 'https://o.org/W' || event_id AS id, 'A <b>work</b> of ' || event_type AS name, 2000 + event_id % 30 AS y, value, event_type FROM events)"""


@query(
    f"""WITH {_SQL_WORK} SELECT 'c' || (event_id % 50) || '::oa:W' || event_id AS raw_pub_id, 'A work of ' || event_type AS titre, 'Ann Lee|Bo Ra' AS auteurs, y AS annee, event_id % 100 AS citations, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Place ' || event_type END AS journal, CASE WHEN event_id % 3 = 0 THEN 'Place ' || event_type END AS conference, '10.1234/w' || event_id AS doi,
  CASE WHEN event_id % 4 <> 0 THEN 'deep ' || event_type || ' deep nets' END AS abstract, CASE WHEN event_id % 4 <> 0 THEN 'found' ELSE 'not_found' END AS abstract_status FROM w"""
)
def work_records(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of works as raw records."""
    e = table(spark, d, "events")
    i, s = c("event_id"), lambda x: x.cast("string")
    index = F.when(i % 4 != 0, F.create_map(F.lit("deep"), F.array(F.lit(0), F.lit(2)), c("event_type"), F.array(F.lit(1)), F.lit("nets"), F.array(F.lit(3))))
    author = lambda n: F.struct(F.struct(F.lit(n).alias("display_name")).alias("author"))
    place = F.struct(F.struct(F.concat(F.lit("Place "), c("event_type")).alias("display_name"), F.when(i % 3 == 0, "conference").otherwise("journal").alias("type")).alias("source"))
    work = F.struct(F.concat(F.lit("https://o.org/W"), s(i)).alias("id"), F.concat(F.lit("A <b>work</b> of "), c("event_type")).alias("display_name"), (2000 + i % 30).alias("publication_year"), F.concat(F.lit("https://doi.org/10.1234/W"), s(i)).alias("doi"), (i % 100).alias("cited_by_count"), index.alias("abstract_inverted_index"), F.array(author("Ann  Lee"), author("Bo Ra")).alias("authorships"), place.alias("primary_location"))
    given = e.select(F.concat(F.lit("c"), s(i % 50)).alias("chercheur_id"), F.to_json(work).alias("payload"))
    found = works.work_records(works.works(given).drop("payload"))
    return found.select("raw_pub_id", "titre", F.array_join("auteurs", "|").alias("auteurs"), c("annee").cast("long").alias("annee"), "citations", "journal", "conference", "doi", "abstract", "abstract_status")


def _profile_page() -> object:
    """A profile page made of a customer and an order count; a saved page has the same shape."""
    row = F.concat(F.lit('<tr class="gsc_a_tr"><td><a class="gsc_a_at" href="/citations?citation_for_view=u:'), c("c_custkey").cast("string"), F.lit('">Work of '), c("c_name"), F.lit('</a><div class="gs_gray">A Ben, B Lee, ...</div><div class="gs_gray">Venue</div></td><td class="gsc_a_c">'), F.when(c("c_custkey") % 3 == 0, "").when(c("c_custkey") % 3 == 1, "*").otherwise("12"), F.lit('</td><td class="gsc_a_y"><span>2019</span></td></tr>'))
    return F.concat(
        F.lit('<div id="gsc_prf_i"><div id="gsc_prf_in">'), c("c_name"), F.lit('</div><div class="gsc_prf_il">Univ &amp; Co</div><div class="gsc_prf_il" id="gsc_prf_ivh">Verified email at '), F.lower("c_mktsegment"), F.lit('.org</div><div id="gsc_prf_int"><a>Nets</a> <a>Rivers</a></div></div><table id="gsc_rsb_st"><thead><tr><th>All</th><th>Since 2021</th></tr></thead><tbody><tr><td class="gsc_rsb_sc1">Citations</td><td class="gsc_rsb_std">'),
        c("c_custkey").cast("string"), F.lit('</td><td class="gsc_rsb_std">7</td></tr><tr><td class="gsc_rsb_sc1">h-index</td><td class="gsc_rsb_std">1,2</td></tr></tbody></table><ul id="gsc_rsb_co"><li><a href="?user=x">Co One</a></li><li><a href="#">no</a></li></ul>'), row, F.lit('<button id="gsc_bpf_more"'), F.when(c("c_custkey") % 2 == 0, " disabled").otherwise(""), F.lit(">more</button>"),
    )


@query(
    """SELECT c_custkey, c_name AS name, 'Univ & Co' AS affiliation, lower(c_mktsegment) || '.org' AS email_domain, 'Nets|Rivers' AS interests, c_custkey::INTEGER AS citations, 7 AS citations_since, 12 AS h_index, 2021 AS since_year, 'Co One' AS coauthors, c_custkey % 2 = 1 AS has_more, 'u:' || c_custkey AS scholar_pub_id, 'Work of ' || c_name AS titre, 'A Ben|B Lee' AS auteurs,
  CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 2 THEN 12 END AS cited, 2019 AS annee, 'https://scholar.google.com/citations?citation_for_view=u:' || c_custkey AS scholar_url FROM customer"""
)
def profile_pages(spark: SparkSession, d: str) -> DataFrame:
    """Identity, metrics, co-authors and publications read from profile pages."""
    page = table(spark, d, "customer").select("c_custkey", payloads.profile(_profile_page()).alias("p"))
    metric = lambda m: c("p.metrics")[m]
    one = page.select("c_custkey", "p", F.explode("p.publications").alias("x"))
    return one.select(
        "c_custkey", "p.name", "p.affiliation", "p.email_domain", F.array_join("p.interests", "|").alias("interests"), metric("citations").alias("citations"), metric("citations_since").alias("citations_since"), metric("h_index").alias("h_index"), "p.since_year", F.array_join("p.coauthors", "|").alias("coauthors"), "p.has_more",
        "x.scholar_pub_id", "x.titre", F.array_join(payloads.listing_authors(c("x.auteurs_listing")), "|").alias("auteurs"), c("x.citations").alias("cited"), "x.annee", "x.scholar_url",
    )


@query("SELECT s_suppkey, 'R' || lpad(s_suppkey::VARCHAR, 11, '0') AS external_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Lab ' || s_nationkey END AS affiliation, 'nets' AS interests, s_nationkey AS cited_by FROM supplier WHERE s_suppkey % 5 <> 0")
def search_pages(spark: SparkSession, d: str) -> DataFrame:
    """H1: hits of pages of search results; one without an id is no hit."""
    s = lambda x: x.cast("string")
    link = F.when(c("s_suppkey") % 5 != 0, F.concat(F.lit("/citations?hl=en&amp;user=R"), F.lpad(s(c("s_suppkey")), 11, "0"))).otherwise("/citations?hl=en")
    page = F.concat(F.lit('<div class="gsc_1usr gs_scl"><h3 class="gs_ai_name"><a href="'), link, F.lit('">'), c("s_name"), F.lit("</a></h3>"), F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit('<div class="gs_ai_aff">Lab '), s(c("s_nationkey")), F.lit("</div>"))).otherwise(""), F.lit('<div class="gs_ai_int"><a class="gs_ai_one_int">nets</a></div><div class="gs_ai_cby">Cited by '), s(c("s_nationkey")), F.lit("</div></div>"))
    found = payloads.search_results(table(spark, d, "supplier").select("s_suppkey", page.alias("html")))
    return found.select("s_suppkey", "external_id", "name", "affiliation", F.array_join("interests", "|").alias("interests"), "cited_by")


_SQL_FAULTY = r"""x AS (SELECT doc_id AS k, CASE WHEN doc_id % 9 = 0 THEN 'art' || doc_id ELSE 'art_' || doc_id END AS article_id, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE lang END AS titre, CASE WHEN doc_id % 8 = 0 THEN 1200 ELSE 2000 END AS annee, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE 3 END AS citations, CASE WHEN doc_id % 6 = 0 THEN 'ftp://a.org/b' WHEN doc_id % 6 = 1 THEN 'https://a.org/b' END AS pdf_url,
  CASE WHEN doc_id % 5 = 0 THEN '11.1/bad' WHEN doc_id % 5 = 1 THEN '10.1234/x' END AS doi, CASE WHEN doc_id % 11 = 0 THEN 'what' ELSE 'found' END AS abstract_status FROM documents)"""


def _faulty(spark: SparkSession, d: str) -> DataFrame:
    i, null = c("doc_id"), F.lit(None).cast("string")
    return table(spark, d, "documents").select(
        F.concat(F.when(i % 9 == 0, "art").otherwise("art_"), i.cast("string")).alias("article_id"), F.when(i % 10 == 0, " ").otherwise(c("lang")).alias("titre"), F.array(F.when(i % 12 == 0, " ").otherwise("A Ben")).alias("auteurs"), F.when(i % 8 == 0, 1200).otherwise(2000).alias("annee"), F.lit("year").alias("date_precision"), F.when(i % 7 == 0, -1).otherwise(3).alias("citations"),
        null.alias("scholar_url"), F.when(i % 6 == 0, "ftp://a.org/b").when(i % 6 == 1, "https://a.org/b").alias("pdf_url"), F.when(i % 5 == 0, "11.1/bad").when(i % 5 == 1, "10.1234/x").alias("doi"), F.when(i % 11 == 0, "what").otherwise("found").alias("abstract_status"), F.lit("none").alias("embedding_source"),
    )


@query(
    f"""WITH {_SQL_FAULTY} SELECT article_id, 'article_id' AS field FROM x WHERE k % 9 = 0 UNION ALL SELECT article_id, 'titre' FROM x WHERE k % 10 = 0 UNION ALL SELECT article_id, 'auteurs' FROM x WHERE k % 12 = 0 UNION ALL SELECT article_id, 'annee' FROM x WHERE annee < 1900 UNION ALL SELECT article_id, 'citations' FROM x WHERE citations < 0
UNION ALL SELECT article_id, 'pdf_url' FROM x WHERE pdf_url LIKE 'ftp%' UNION ALL SELECT article_id, 'doi' FROM x WHERE NOT regexp_matches(doi, '^10\\.\\d{{4,9}}/\\S+$') UNION ALL SELECT article_id, 'abstract_status' FROM x WHERE abstract_status = 'what'"""
)
def article_faults(spark: SparkSession, d: str) -> DataFrame:
    """Fields of articles that break a rule."""
    return quality.article_errors(_faulty(spark, d)).select("article_id", "field")


@query(
    """SELECT s_suppkey AS chercheur_id, 'h_index' AS field FROM supplier WHERE s_nationkey - 3 < 0 UNION ALL SELECT s_suppkey, 'profile_match_confidence' FROM supplier WHERE s_acctbal / 5000 NOT BETWEEN 0 AND 1 UNION ALL SELECT s_suppkey, 'scholar_profile_status' FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 'data_source' FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT s_suppkey, 'scholar_url' FROM supplier WHERE s_suppkey % 5 = 0"""
)
def researcher_faults(spark: SparkSession, d: str) -> DataFrame:
    """Fields of researchers that break a rule."""
    k = c("s_suppkey")
    people = table(spark, d, "supplier").select(k.alias("chercheur_id"), c("s_name").alias("nom_complet"), F.lit(1).alias("citations_totales"), (c("s_nationkey") - 3).alias("h_index"), F.lit(None).cast("int").alias("i10_index"), F.when(k % 5 == 0, "javascript:x").alias("scholar_url"), F.when(k % 4 == 0, "maybe").otherwise("matched").alias("scholar_profile_status"), (c("s_acctbal") / 5000).alias("profile_match_confidence"), F.when(k % 6 == 0, "web").otherwise("none").alias("data_source"))
    return quality.researcher_errors(people).select("chercheur_id", "field")


@query(
    f"""WITH {_SQL_CLEAN}, art AS (SELECT * FROM cleaned WHERE titre IS NOT NULL), p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'pending' ELSE 'matched' END AS st, CASE WHEN s_suppkey % 3 = 0 THEN 'none' ELSE 'openalex' END AS src FROM supplier)
SELECT 'researchers' AS metric, NULL AS label, count(*)::DOUBLE AS value FROM p UNION ALL SELECT 'pct_researchers_without_profile', NULL, round(100.0::DOUBLE * count(*) FILTER (st <> 'matched') / count(*), 1) FROM p UNION ALL SELECT 'unique_publications', NULL, count(*) FROM art UNION ALL SELECT 'publications_with_doi', NULL, count(doi) FROM art
UNION ALL SELECT 'pct_publications_with_doi', NULL, round(100.0::DOUBLE * count(doi) / count(*), 1) FROM art UNION ALL SELECT 'abstracts', NULL, count(abstract_clean) FROM art UNION ALL SELECT 'pct_publications_without_abstract', NULL, round(100.0::DOUBLE * (count(*) - count(abstract_clean)) / count(*), 1) FROM art UNION ALL SELECT 'publications_without_year', NULL, count(*) FILTER (annee IS NULL) FROM art
UNION ALL SELECT 'links', NULL, count(*) FROM art UNION ALL SELECT 'detail_errors', NULL, count(*) FILTER (scrape_status = 'detail_error') FROM raw UNION ALL SELECT 'researchers_in_error_or_blocked', NULL, count(*) FILTER (s_suppkey % 7 = 0) FROM p UNION ALL SELECT 'validation_errors', NULL, 0
UNION ALL SELECT 'researchers_by_status', st, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'researchers_by_source', src, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'abstracts_by_status', abstract_status, count(*) FROM art GROUP BY 2 UNION ALL SELECT 'abstracts_by_source', coalesce(abstract_source, '(aucune)'), count(*) FROM art GROUP BY 2
UNION ALL SELECT 'embedding_source', embedding_source, count(*) FROM art GROUP BY 2 UNION ALL SELECT 'cleaning', 'raw_records', count(*) FROM raw UNION ALL SELECT 'cleaning', 'records_without_title_dropped', count(*) FROM cleaned WHERE titre IS NULL UNION ALL SELECT 'cleaning', 'records_outside_target_institution', 0 UNION ALL SELECT 'cleaning', 'records_after_cleaning', count(*) FROM art
UNION ALL SELECT 'cleaning', 'unique_articles', count(*) FROM art UNION ALL SELECT 'cleaning', 'duplicates_merged', 0 UNION ALL SELECT 'cleaning', 'links', count(*) FROM art"""
)
def whole_quality_report(spark: SparkSession, d: str) -> DataFrame:
    """The report over the clean records, each an article of its own."""
    raw = records.screen(_raw(spark, d))
    articles = materialise(records.clean_publications(raw.where("reject IS NULL")).withColumn("n_source_records", F.lit(1)), "articles")
    people = table(spark, d, "supplier").select(F.when(c("s_suppkey") % 4 == 0, "pending").otherwise("matched").alias("scholar_profile_status"), F.when(c("s_suppkey") % 3 == 0, "none").otherwise("openalex").alias("data_source"))
    states = table(spark, d, "supplier").select(F.lit("matched").alias("scholar_profile_status"), F.when(c("s_suppkey") % 7 == 0, "blocked").alias("collection_status"))
    links = articles.select("raw_pub_id")
    return quality.quality_report(people, articles, links, raw, states, records.cleaning_counts(raw, articles, links), raw.limit(0))


@query("SELECT item_id AS page, pos, 'Person ' || item_id || ' ' || pos AS name, CASE WHEN item_id % 3 = 0 OR pos > 2 THEN 'FST' END AS etablissement, 'Lab ' || pos AS laboratoire FROM benchmark, (SELECT unnest([2, 3])::INTEGER AS pos) WHERE item_id >= (SELECT min(item_id) FROM benchmark WHERE item_id % 3 = 0)")
def table_members(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tables whose header stands on some pages only; rows before the first and without a name go."""
    page = table(spark, d, "benchmark").select(c("item_id").alias("page"))
    null = F.lit(None).cast("string")
    name = F.concat(F.lit("Person "), c("page").cast("string"), F.lit(" "))
    row = lambda pos, *cells: F.struct(F.lit(pos).alias("pos"), F.array(*cells).alias("cells"))
    head = F.when(c("page") % 3 == 0, row(1, F.lit("Établissement"), F.lit("Enseignant-Chercheur"), F.lit("Laboratoire"))).otherwise(row(1, null, null, null))
    rows = F.array(head, row(2, F.when(c("page") % 3 == 0, "FST"), F.concat(name, F.lit("2")), F.lit("Lab 2")), row(3, F.lit(" FST "), F.concat(name, F.lit("<b>3</b>")), F.lit("Lab  3")), row(4, F.lit("FST"), null, F.lit("Lab 4")))
    given = page.select("page", F.explode(rows).alias("r")).select("page", "r.pos", "r.cells")
    kept, _ = layout.rows_to_records(given)
    return kept.select("page", "pos", F.regexp_replace("chercheur_source_name", r"\s+(\d)$", " $1").alias("name"), "etablissement", "laboratoire")


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings), t AS (SELECT * FROM v), p AS (SELECT list_cosine_similarity(a.e, b.e) AS s FROM t a JOIN t b ON a.vec_id < b.vec_id) SELECT least(20, floor((round(s, 9) + 1) * 10)::INTEGER + 1) AS bin, count(*) AS n FROM p GROUP BY 1"""
)
def similarity_histogram(spark: SparkSession, d: str) -> DataFrame:
    """V19 with a sample as large as the table, so all pairs count."""
    e = table(spark, d, "embeddings")
    return vectors.similarity_histogram(e, sample=max(1, e.count()))


@query("SELECT doc_id, sha256('hashed-words|default|document|' || text) AS key, 128 AS dim FROM documents")
def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of the distinct texts by the hashing stand-in."""
    from tessera.operators import embed

    out, _ = embed.embed(table(spark, d, "documents"), "text", "hashed-words")
    return out.select("doc_id", "key", F.size("embedding").alias("dim"))


@query("SELECT c_custkey, c_custkey % 30 AS citations_totales, CASE WHEN c_custkey % 2 = 0 THEN 2021 ELSE 2020 END AS since_year, c_custkey % 7 AS citations_since, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 END AS citations_since_2021 FROM customer")
def profile_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts since 2021 only where the profile's window begins then."""
    k = c("c_custkey")
    metrics = F.create_map(F.lit("citations"), k % 30, F.lit("citations_since"), k % 7)
    given = table(spark, d, "customer").select(k, F.struct(metrics.alias("metrics"), F.when(k % 2 == 0, 2021).otherwise(2020).alias("since_year")).alias("profile"))
    return given.withColumns(records.profile_metrics()).select("c_custkey", "citations_totales", "since_year", "citations_since", "citations_since_2021")


@query("SELECT o_custkey AS chercheur_id, o_orderkey AS id, o_totalprice AS price FROM orders")
def flattened_states(spark: SparkSession, d: str) -> DataFrame:
    """Publications of states, one row each."""
    states = table(spark, d, "orders").groupBy(c("o_custkey").alias("chercheur_id")).agg(F.collect_list(F.struct(c("o_orderkey").alias("id"), c("o_totalprice").alias("price"))).alias("publications"))
    return records.flatten(states)[0]


@query("SELECT label, count(DISTINCT c_custkey) AS n FROM (SELECT c_custkey, unnest(string_split(c_mktsegment || ' | ' || c_nationkey::VARCHAR, ' | ')) AS label FROM customer) GROUP BY label")
def people_per_label(spark: SparkSession, d: str) -> DataFrame:
    """A3: distinct people by each of their labels."""
    owners = table(spark, d, "customer").select("c_custkey", F.concat_ws(" | ", "c_mktsegment", c("c_nationkey").cast("string")).alias("label"))
    return reports.memberships(owners, "label").groupBy("label").agg(F.countDistinct("c_custkey").alias("n"))


@query("SELECT lower(trim(w)) AS word, count(*) AS n FROM (SELECT unnest(string_split(p_type || '; ' || p_brand || ';', ';')) AS w FROM part) WHERE trim(w) <> '' GROUP BY 1")
def interest_counts(spark: SparkSession, d: str) -> DataFrame:
    """A4: words of lists parted by semicolons."""
    return reports.word_frequency(table(spark, d, "part").select(F.concat("p_type", F.lit("; "), "p_brand", F.lit(";")).alias("w")), "w")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def most_cited(spark: SparkSession, d: str) -> DataFrame:
    """The greatest fifteen, a top-k report."""
    return table(spark, d, "orders").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(15).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey AS owner, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall FROM orders GROUP BY 1 UNION ALL SELECT NULL, round(avg(r), 9) FROM (SELECT avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS r FROM orders GROUP BY o_custkey)")
def fallback_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of each owner's works that the other source has, by DOI here, and the mean."""
    o = table(spark, d, "orders").select(c("o_custkey").alias("owner"), c("o_orderkey").cast("string").alias("doi"), F.lit("").alias("title_key"), "o_orderkey")
    found = matching.recall(o, o.where("o_orderkey % 3 = 0"), "owner")
    return found.select("owner", F.round("recall", 9).alias("recall"))


@query("SELECT n_nationkey AS pos, CASE WHEN n_nationkey % 5 = 0 THEN 'other_institution' WHEN n_nationkey % 7 = 0 THEN 'invalid_id' ELSE 'accepted' END AS status FROM nation")
def imported_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers entered for people of the roster."""
    n = table(spark, d, "nation")
    name = F.translate(F.md5(c("n_nationkey").cast("string")), "0123456789", "ghijklmnop")  # names unlike each other
    key = F.concat_ws(" ", F.left(name, F.lit(12)), F.right(name, F.lit(12)))
    entries = n.select(c("n_nationkey").alias("pos"), key.alias("name_key"), F.when(c("n_nationkey") % 7 == 0, "short").otherwise(F.concat(F.lit("ABCDEFGH"), F.lpad(c("n_nationkey").cast("string"), 4, "0"))).alias("external_id"))
    roster = n.select(c("n_nationkey").alias("person_id"), key.alias("name_key"), F.when(c("n_nationkey") % 5 == 0, "away").otherwise("home").alias("institution_key"))
    return matching.match_entries(entries, roster, "home").select("pos", "status")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'robot_check' WHEN o_orderkey % 4 = 1 THEN 'not_a_profile' ELSE 'ok' END AS status FROM orders")
def saved_page_status(spark: SparkSession, d: str) -> DataFrame:
    """What a saved page is."""
    html = F.when(c("o_orderkey") % 4 == 0, "<p>Our systems have detected Unusual Traffic</p>").when(c("o_orderkey") % 4 == 1, "<p>hello</p>").otherwise('<div id="gsc_prf_in">Ann Lee</div>')
    page = table(spark, d, "orders").select("o_orderkey", html.alias("h")).withColumn("name", payloads.profile(c("h"))["name"])
    return page.select("o_orderkey", payloads.page_status(c("h"), c("name")).alias("status"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '10.1000/' || c_custkey WHEN c_custkey % 3 = 1 THEN '10.1000/x+' || c_custkey END AS doi, CASE WHEN c_custkey % 2 = 0 THEN 'AAAAAAAAAAA' || (c_custkey % 10) END AS external_id, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'length' END AS fault FROM customer")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """DOIs and ids in addresses."""
    k = c("c_custkey").cast("string")
    i = c("c_custkey")
    doi = F.when(i % 3 == 0, F.concat(F.lit(" HTTPS://DX.doi.org/10.1000/"), k, F.lit(".;"))).when(i % 3 == 1, F.concat(F.lit("doi: 10.1000%2FX+"), k)).otherwise(F.concat(F.lit("11.1/"), k))
    page = F.when(i % 2 == 0, F.concat(F.lit("?citation_for_view=BBBBBBBBBBBB:1 ?citation_for_view=AAAAAAAAAAA"), (i % 10).cast("string"), F.lit(":1 ?citation_for_view=AAAAAAAAAAA"), (i % 10).cast("string"))).otherwise("none")
    return table(spark, d, "customer").select("c_custkey", tx.normalize_doi(doi).alias("doi"), payloads.scholar_id(page).alias("external_id"), vl.external_id_fault(F.when(i % 2 == 0, "AAAAAAAAAAA1").otherwise("AAAA")).alias("fault"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'El-Amrani M''Sik' ELSE 'Sara Ben ' || 'Omar' END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'fst_el_amrani_m_sik' ELSE 'unk_sara_ben_omar' END AS id, CASE WHEN c_custkey % 2 = 0 THEN 'amrani el m sik' ELSE 'ben omar sara' END AS key FROM customer")
def people_names(spark: SparkSession, d: str) -> DataFrame:
    """Names, keys and ids of people."""
    raw = F.when(c("c_custkey") % 2 == 0, "Pr. Dr. EL-AMRANI  m'sik").otherwise("SARA.ben_omar")
    name = tx.person_name(raw)
    named = table(spark, d, "customer").select("c_custkey", name.alias("name"))
    key = tx.match_key(c("name"))
    place = F.when(c("c_custkey") % 2 == 0, "fst").otherwise("")
    return named.select("c_custkey", "name", vl.person_id(place, tx.slug(key)).alias("id"), tx.name_key(key).alias("key"))


@query("WITH r AS (SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2) SELECT o_custkey, o_orderkey FROM r")
def capped_works(spark: SparkSession, d: str) -> DataFrame:
    """At most two works of each person, the most cited."""
    w = table(spark, d, "orders").select("o_custkey", F.struct(c("o_totalprice").alias("cited_by_count"), c("o_orderkey").alias("id")).alias("w"))
    return works.most_cited(w, "o_custkey", 2).select("o_custkey", c("w.id").alias("o_orderkey"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS x, (SELECT max(s) FROM (SELECT DISTINCT l_extendedprice AS s FROM lineitem) m WHERE m.s <= l_quantity * 1000) AS mark FROM lineitem")
def as_of_many(spark: SparkSession, d: str) -> DataFrame:
    """P22 with a mark for each price, laid beside the points in ranges."""
    li = table(spark, d, "lineitem")
    marks = li.select(c("l_extendedprice").alias("_s"), c("l_extendedprice").alias("_l"))
    points = li.select("l_orderkey", "l_linenumber", c("l_quantity").alias("x"), (c("l_quantity") * 1000).alias("y"))
    return relational._as_of_ranges(points, marks, "y", "mark", 0.0, 64).select("l_orderkey", "l_linenumber", "x", "mark")


@query(
    """WITH p AS (SELECT o_custkey AS person, o_orderkey AS author_id, 0.85 + (o_orderkey % 16) / 100.0::DOUBLE AS score, o_orderstatus <> 'P' AS at_home, floor(o_totalprice / 5000)::BIGINT AS works FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY works DESC, author_id) AS r, max(works) OVER (PARTITION BY person) AS top FROM p WHERE round(score, 6) >= 0.9 AND at_home)
SELECT person, CASE WHEN bool_or(r > 1 AND works >= greatest(20, 0.5 * top)) THEN 'ambiguous' ELSE 'matched' END AS status, min(CASE WHEN r = 1 THEN author_id END) AS author_id, array_to_string(list_sort(list(author_id) FILTER (r = 1 OR round(score, 6) >= 0.93)), ',') AS merged FROM f GROUP BY person"""
)
def author_choice(spark: SparkSession, d: str) -> DataFrame:
    """M9: the author of most works at the institution, unless another is large too; fragments merged."""
    o = table(spark, d, "orders")
    given = o.select(c("o_custkey").alias("person"), c("o_orderkey").alias("author_id"), F.round(0.85 + (c("o_orderkey") % 16) / 100, 6).alias("score"), (c("o_orderstatus") != "P").alias("at_home"), F.floor(c("o_totalprice") / 5000).alias("works"))
    return matching.choose_author(given, "person").select("person", "status", "author_id", F.array_join(F.transform("merged_ids", lambda x: x.cast("string")), ",").alias("merged"))


@query("SELECT c_custkey, round(0.6 * c_acctbal / 10000 + 0.4, 3) AS fallback, round(least(1.0, c_acctbal / 10000 + CASE WHEN c_custkey % 3 = 0 THEN 0.1 WHEN c_custkey % 3 = 1 THEN 0.05 ELSE 0 END), 3) AS raised FROM customer WHERE c_acctbal >= 0")
def confidences(spark: SparkSession, d: str) -> DataFrame:
    """Confidence in the fallback source, and raised by co-authors."""
    x = c("c_acctbal") / 10000
    bonus = F.when(c("c_custkey") % 3 == 0, 0.1).when(c("c_custkey") % 3 == 1, 0.05).otherwise(0.0)
    return table(spark, d, "customer").where("c_acctbal >= 0").select("c_custkey", matching.blended_confidence(x).alias("fallback"), matching.raised_confidence(x, bonus).alias("raised"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS journal, CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE 'old' END AS abstract, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN regexp_matches(text, '(…|\\.{3,})\\s*$') THEN 'truncated' ELSE 'found' END ELSE 'pending' END AS abstract_status FROM documents")
def merged_details(spark: SparkSession, d: str) -> DataFrame:
    """A detail page's fields over a listed record, never by an empty one."""
    i = c("doc_id")
    listed = table(spark, d, "documents").select(i, c("source").alias("journal"), F.lit("old").alias("abstract"), F.lit("pending").alias("abstract_status"), F.when(i % 3 == 0, c("lang")).otherwise("").alias("d_journal"), F.when(i % 2 == 0, c("text")).alias("d_abstract"))
    merged = listed.withColumns(enrich.merge_detail(["journal", "abstract"]))
    return merged.select("doc_id", "journal", F.when(c("abstract") == "old", "old").otherwise(F.md5("abstract")).alias("abstract"), "abstract_status")


@query("SELECT label, count(*) AS n, count(*) FILTER (vec_id % 2 = 0) AS n_vectors, round(sum(CASE WHEN vec_id % 2 = 0 THEN round(embedding[1]::DOUBLE, 5) ELSE 0 END), 4) AS first_sum FROM embeddings GROUP BY label")
def attached_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Nested items with their vectors, or none."""
    from tessera.operators import embed

    e = table(spark, d, "embeddings")
    nested = e.groupBy("label").agg(F.array_sort(F.collect_list(F.struct(c("vec_id").alias("article_id")))).alias("articles"))
    full = embed.attach(nested, e.where("vec_id % 2 = 0").select(c("vec_id").alias("article_id"), "embedding"), "true").select("label", F.explode("articles").alias("a"))
    return full.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("a.embedding").alias("n_vectors"), F.round(F.sum(F.coalesce(c("a.embedding")[0], F.lit(0.0))), 4).alias("first_sum"))


@query(f"WITH {_SQL_CLEAN} SELECT rid FROM cleaned WHERE embedding_text IS NOT NULL AND embedding_source <> 'none'")
def embeddable_records(spark: SparkSession, d: str) -> DataFrame:
    """P5: records that have a text to embed."""
    from tessera.operators import embed

    return embed.embeddable(records.clean_publications(_raw(spark, d))).select("rid")


@query(
    """SELECT (SELECT count(*) FROM supplier) AS researchers, (SELECT count(s_nationkey) FROM supplier) AS with_h_index, (SELECT median(s_nationkey) FROM supplier) AS h_index_median, (SELECT max(s_nationkey) FROM supplier) AS h_index_max, (SELECT count(*) FROM documents) AS articles, (SELECT round(100 * avg(CASE WHEN n_chars > 500 THEN 1.0::DOUBLE ELSE 0 END), 1) FROM documents) AS pct_with_abstract, (SELECT count(*) FROM lineitem) AS links,
(SELECT string_agg(y || ':' || n, ',' ORDER BY y) FROM (SELECT 2000 + doc_id % 7 AS y, count(*) AS n FROM documents GROUP BY 1)) AS by_year, (SELECT string_agg(s || ':' || n, ',' ORDER BY n DESC, s::VARCHAR) FROM (SELECT l_suppkey AS s, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, s::VARCHAR LIMIT 10)) AS most"""
)
def overall_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row about everything."""
    people = table(spark, d, "supplier").select(c("s_suppkey").cast("string").alias("chercheur_id"), c("s_name").alias("nom_complet"), c("s_nationkey").alias("h_index"))
    articles = table(spark, d, "documents").select((2000 + c("doc_id") % 7).alias("annee"), F.when(c("n_chars") > 500, "x").alias("abstract_clean"), F.lit("found").alias("abstract_status"))
    links = table(spark, d, "lineitem").select(c("l_suppkey").cast("string").alias("chercheur_id"), c("l_orderkey").alias("article_id"))
    pair = lambda k, v: F.concat_ws(":", k, v.cast("string"))
    years = F.array_join(F.transform(F.map_entries("articles_by_year"), lambda e: pair(e["key"], e["value"])), ",")
    most = F.array_join(F.transform("most_publications", lambda m: pair(m["chercheur_id"], m["n"])), ",")
    return quality.summary(people, articles, links).select("researchers", "with_h_index", "h_index_median", "h_index_max", "articles", "pct_with_abstract", "links", years.alias("by_year"), most.alias("most"))
