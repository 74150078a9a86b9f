"""Registry of the queries outside the training-data operators, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import values as vl
from tessera.operators import dedup, matching, payloads_queries, relational, reports, roster, vectors
from tessera.operators.records import abstract_state
from tessera.registry import ORACLE_SQL, QUERIES, query
from tessera.sources.readers import table
from tessera.streaming.state import latest, windowed_counts

#: Words that say nothing about a topic.
STOP = "the of and to in is that it for on with as was be by this are or an at from der die und den das le la les de des et un une que el los las en se".split()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# ---------------------------------------------------------------- vectors


@query("""SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id)::INTEGER AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """V1-V4, V6: ten nearest by cosine of the vectors whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.search(e, asked, 10).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM h) WHERE r <= 100),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, label, round(sum(CASE WHEN k <= 3 THEN score ELSE 0 END) / 3, 6) AS owner_score, round(max(score), 6) AS best, count(*) AS n_matching FROM o GROUP BY query_id, label""")
def label_rank_topm(spark: SparkSession, d: str) -> DataFrame:
    """V7, V8: owners by the mean of their three best of a pool of a hundred."""
    e = table(spark, d, "embeddings")
    pool = vectors.search(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 100)
    return vectors.rank_owners(pool, e, "vec_id", "label").select("query_id", "label", F.round("owner_score", 6).alias("owner_score"), F.round("best", 6).alias("best"), "n_matching")


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim, count(*) FILTER (WHERE embedding IS NULL OR list_contains(list_transform(embedding, lambda x: isnan(x) OR isinf(x)), true)) AS n_bad FROM embeddings")
def vector_validate(spark: SparkSession, d: str) -> DataFrame:
    """V3"""
    return vectors.faults(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS self_score FROM embeddings")
def self_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """V18"""
    e = table(spark, d, "embeddings").withColumn("u", vectors.unit(F.col("embedding")))
    return e.select("vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("self_score"))


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
p AS (SELECT label, i, avg(e[i]) AS m FROM (SELECT label, e, unnest(range(1, 65)) AS i FROM u) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS c FROM p GROUP BY label)
SELECT label, rank, vec_id, round(score, 6) AS score FROM (
  SELECT u.label, u.vec_id, list_cosine_similarity(u.e, c.c) AS score, row_number() OVER (PARTITION BY u.label ORDER BY list_cosine_similarity(u.e, c.c) DESC, vec_id)::INTEGER AS rank FROM u JOIN c USING (label)) WHERE rank <= 3""")
def centroid_closest(spark: SparkSession, d: str) -> DataFrame:
    """The three rows nearest to their cluster's centroid."""
    from tessera.operators.topics import central_rows

    return central_rows(table(spark, d, "embeddings"), "vec_id", "label").select("label", "rank", "vec_id", F.round("score", 6).alias("score"))


@query()
def kmeans_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the clusters of unit vectors, k given."""
    from tessera.operators.topics import clusters

    return clusters(table(spark, d, "embeddings"), k=8).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def semantic_map(spark: SparkSession, d: str) -> DataFrame:
    """A point for each row."""
    from tessera.operators.topics import two_dimensions

    return two_dimensions(table(spark, d, "embeddings")).select("vec_id", "label", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query()
def cluster_terms(spark: SparkSession, d: str) -> DataFrame:
    """Six terms for each language."""
    from tessera.operators.topics import cluster_terms as terms

    return terms(_docs(spark, d).select("doc_id", "lang", "text"), "doc_id", "text", "lang", STOP)


# ---------------------------------------------------------------- text


@query(r"""SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\s]+', ' ', 'g')), '') AS clean FROM documents""")
def doc_clean_light(spark: SparkSession, d: str) -> DataFrame:
    """T1, T2"""
    return _docs(spark, d).select("doc_id", tx.clean_light(F.col("text")).alias("clean"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents""")
def doc_match_key_ascii(spark: SparkSession, d: str) -> DataFrame:
    """T6, the part in built-ins."""
    return _docs(spark, d).select("doc_id", tx.match_key_ascii(F.col("text")).alias("key"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(replace(replace(text, 'ß', ''), 'ø', ''), 'œ', ''))), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents""")
def doc_match_key(spark: SparkSession, d: str) -> DataFrame:
    """T5-T7 with compatibility decomposition."""
    return _docs(spark, d).select("doc_id", tx.match_key(F.col("text")).alias("key"))


@query(r"SELECT doc_id, regexp_matches(text, '(…|\.{3,})\s*$') AS truncated FROM documents")
def doc_truncated_flag(spark: SparkSession, d: str) -> DataFrame:
    """T3"""
    return _docs(spark, d).select("doc_id", tx.is_truncated(F.col("text")).alias("truncated"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(left(text, 300), ' [^ ]*$', '') || '…' END AS preview FROM documents")
def doc_preview_300(spark: SparkSession, d: str) -> DataFrame:
    """T14"""
    return _docs(spark, d).select("doc_id", tx.shorten(F.col("text")).alias("preview"))


@query(r"""WITH p AS (SELECT doc_id, nullif(trim(split_part(text, chr(10), 1), ' '), '') AS title, trim(substr(text, length(split_part(text, chr(10), 1)) + 2), ' ') AS body FROM documents),
q AS (SELECT doc_id, title, CASE WHEN length(body) >= 50 THEN body END AS body FROM p)
SELECT doc_id, CASE WHEN title IS NOT NULL AND body IS NOT NULL THEN 'title_abstract' WHEN title IS NOT NULL THEN 'title_only' WHEN body IS NOT NULL THEN 'abstract_only' ELSE 'none' END AS source,
  md5(CASE WHEN title IS NOT NULL AND body IS NOT NULL THEN title || CASE WHEN right(title, 1) IN ('.', '!', '?', ':', ';') THEN ' ' ELSE '. ' END || body ELSE coalesce(title, body) END) AS text_md5 FROM q""")
def doc_embedding_source(spark: SparkSession, d: str) -> DataFrame:
    """First line as title, the rest as abstract."""
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    text, source = tx.embedding_text(title, F.substring(F.col("text"), F.length(title) + 2, F.length("text")))
    return _docs(spark, d).select("doc_id", source.alias("source"), F.md5(text).alias("text_md5"))


@query(r"""SELECT doc_id, coalesce(NOT regexp_matches(text, '(?i)\b(we|this paper|this study|this article|propose\w*|present\w*|show\w*|results?|aims?|investigat\w*|study|studies|approach|method)\b')
  AND ((len(regexp_extract_all(text, '(?i)\b(universit\w*|laborator\w*|facult\w*|department|institute|institut|school|college|morocco|maroc|casablanca|france|spain|usa)\b')) >= 2 AND length(text) < 600)
  OR (regexp_matches(text, '^\d+\s?[A-Z]') AND len(regexp_extract_all(text, '(?i)\b(universit\w*|laborator\w*|facult\w*|department|institute|institut|school|college|morocco|maroc|casablanca|france|spain|usa)\b')) >= 1)), false) AS flagged FROM documents""")
def looks_like_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """T11"""
    return _docs(spark, d).select("doc_id", tx.looks_like_affiliation(F.col("text")).alias("flagged"))


@query("SELECT text, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def doc_exact_dups(spark: SparkSession, d: str) -> DataFrame:
    """D12"""
    return _docs(spark, d).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY text) AS src, doc_id AS dst FROM documents WHERE doc_id % 11 <> 0) WHERE src <> dst")
def doi_edges(spark: SparkSession, d: str) -> DataFrame:
    """D1, the text's digest standing for a DOI, which some lack."""
    return dedup.doi_edges(_docs(spark, d).select(F.col("doc_id").alias("rid"), F.when(F.col("doc_id") % 11 != 0, F.md5("text")).alias("doi")))


@query(r"""WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS tok FROM documents),
b AS (SELECT item_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS tok FROM benchmark)
SELECT b.item_id, t.doc_id, round(len(list_intersect(b.tok, t.tok))::DOUBLE / (len(b.tok) + len(t.tok) - len(list_intersect(b.tok, t.tok))), 6) AS jaccard FROM b JOIN t ON len(list_intersect(b.tok, t.tok)) * 5 >= (len(b.tok) + len(t.tok) - len(list_intersect(b.tok, t.tok)))""")
def title_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    """Items and documents of token Jaccard 0.2 or more, by prefix and length filter."""
    words = lambda c: F.array_distinct(tx.tokens(tx.match_key_ascii(c)))
    a = table(spark, d, "benchmark").select("item_id", words(F.col("text")).alias("ta"))
    most = a.agg(F.coalesce(F.max(F.size("ta")), F.lit(0))).first()[0]
    b = _docs(spark, d).select("doc_id", words(F.col("text")).alias("tb")).where(F.size("tb") <= 5 * most)  # a larger set shares too few
    frequency = b.select(F.explode("tb").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    one = a.select("item_id", F.size("ta").alias("n"), F.explode("ta").alias("t")).join(frequency, "t", "left")
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "t"))  # a window over one item's words
    prefix = one.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") / 5) + 1)
    sized = b.select("doc_id", F.size("tb").alias("m"), F.explode("tb").alias("t"))
    pairs = prefix.select("item_id", "n", "t").join(sized, "t").where((F.col("m") <= 5 * F.col("n")) & (F.col("n") <= 5 * F.col("m"))).select("item_id", "doc_id").distinct()
    full = pairs.join(a, "item_id").join(b, "doc_id")
    shared = F.size(F.array_intersect("ta", "tb"))
    return full.where(shared * 5 >= F.size("ta") + F.size("tb") - shared).select("item_id", "doc_id", F.round(dedup.jaccard(F.col("ta"), F.col("tb")), 6).alias("jaccard"))


# ---------------------------------------------------------------- pages and addresses


@query(r"SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title FROM pages")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("")).alias("title"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, regexp_extract(url, '([^/]*)$', 1) AS last FROM pages")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """N3, H8, N13"""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.try_parse_url(vl.web_url(u), F.lit("HOST")).alias("host"), vl.query_param(u, "page").alias("page"), vl.last_segment(u).alias("last"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, CASE WHEN path LIKE '/en/1%' THEN true WHEN path LIKE '/en/%' THEN false WHEN path LIKE '/%7' THEN false ELSE true END AS allowed FROM p""")
def robots_gate(spark: SparkSession, d: str) -> DataFrame:
    """The longest rule wins."""
    rules = spark.createDataFrame([("/en/", False), ("/en/1", True), ("/*7$", False), ("", False)], "pattern string, allow boolean")
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    return payloads_queries.gate(table(spark, d, "pages").select("page_id", path.alias("path")), rules)


@query("SELECT tag, count(*) AS n_nodes, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM pages) GROUP BY tag")
def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    """H1-H5: elements of every page by tag."""
    return payloads_queries.tag_counts(table(spark, d, "pages"))


# ---------------------------------------------------------------- relations and reports


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_orderkey")
def per_key_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct("l_partkey").alias("n_parts"))


@query("SELECT c_custkey AS owner, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join_fill_zero(spark: SparkSession, d: str) -> DataFrame:
    """A1, P7"""
    return reports.per_owner(table(spark, d, "customer").select(F.col("c_custkey").alias("owner")), table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), "o_orderkey"), "owner", "o_orderkey")


@query("""SELECT o_custkey, rank, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3""")
def per_group_topk(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "rank", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def restrict_semi(spark: SparkSession, d: str) -> DataFrame:
    """P3"""
    return relational.keep_known(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def todo_anti(spark: SparkSession, d: str) -> DataFrame:
    """P13"""
    return relational.todo(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey", "c_name")


@query("""SELECT y.y::INTEGER AS year, count(o_orderkey) AS n FROM (SELECT unnest(generate_series((SELECT min(year(o_orderdate)) FROM orders), (SELECT max(year(o_orderdate)) FROM orders))) AS y) y LEFT JOIN orders ON year(o_orderdate) = y.y GROUP BY y.y""")
def dense_year_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A5"""
    return relational.dense_counts(table(spark, d, "orders").select(F.year("o_orderdate").alias("year")), "year")


@query("""SELECT label, count(DISTINCT o_orderkey) AS n FROM (SELECT c_custkey, unnest(string_split(c_mktsegment || ' | ' || c_nationkey::VARCHAR, ' | ')) AS label FROM customer) m JOIN orders ON o_custkey = c_custkey GROUP BY label""")
def explode_membership(spark: SparkSession, d: str) -> DataFrame:
    """An order counts for the segment and for the nation of its customer."""
    owners = table(spark, d, "customer").select("c_custkey", F.concat_ws(" | ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("label"))
    return reports.per_membership(owners, table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "label", "o_orderkey")


@query("""SELECT c_custkey, list_aggregate(list(o_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR ORDER BY o_orderkey, l_linenumber), 'string_agg', ',') AS items, count(*) AS n_items
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def nested_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Parents with the ordered list of their items."""
    links = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey"))
    nested = relational.nest(table(spark, d, "customer").select("c_custkey"), links, table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "c_custkey", "l_orderkey", "l_orderkey", ["l_linenumber"])
    pair = lambda x: F.concat_ws(":", x["l_orderkey"].cast("string"), x["l_linenumber"].cast("string"))
    return nested.select("c_custkey", F.array_join(F.transform("items", pair), ",").alias("items"), F.size("items").cast("long").alias("n_items"))


@query("""SELECT 'quality' AS field, count(*) FILTER (WHERE quality IS NULL) AS n_missing, round(100.0::DOUBLE * count(quality) / count(*), 1) AS pct_present FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL), round(100.0::DOUBLE * count(lang) / count(*), 1) FROM documents""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """A11"""
    return reports.completeness(_docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left"), ["quality", "lang"])


@query("SELECT coalesce(quality::VARCHAR, 'missing') AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def status_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A7, A14"""
    return reports.value_counts(_docs(spark, d).select("doc_id").join(table(spark, d, "labels"), "doc_id", "left"), "quality")


@query("""SELECT doc_id, 'n_chars' AS field, 'not the length of the text' AS message FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT doc_id, 'text', 'shorter than 50 characters' FROM documents WHERE length(text) < 50
UNION ALL SELECT doc_id, 'lang', 'unknown language' FROM documents WHERE lang NOT IN ('en', 'fr', 'de')""")
def validation_errors(spark: SparkSession, d: str) -> DataFrame:
    """A17"""
    rules = {"n_chars": (F.col("n_chars") != F.length("text"), "not the length of the text"), "text": (F.length("text") < 50, "shorter than 50 characters"), "lang": (~F.col("lang").isin("en", "fr", "de"), "unknown language")}
    return relational.violations(_docs(spark, d), "doc_id", rules)


@query("""WITH p AS (SELECT doc_id, quality AS v FROM labels), f AS (SELECT doc_id, CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END AS v FROM documents)
SELECT doc_id, CASE WHEN p.v = 1 THEN p.v WHEN f.v = 1 THEN f.v ELSE coalesce(p.v, f.v) END AS v, CASE WHEN p.v = 1 THEN 'primary' WHEN f.v = 1 THEN 'fallback' ELSE 'none' END AS data_source FROM p FULL JOIN f USING (doc_id)""")
def effective_state(spark: SparkSession, d: str) -> DataFrame:
    """P14"""
    primary = table(spark, d, "labels").select("doc_id", F.col("quality").alias("v"))
    fallback = _docs(spark, d).select("doc_id", F.when(F.length("text") > 1000, 1).otherwise(0).alias("v"))
    return relational.prefer(primary, fallback, "doc_id", F.col("v") == 1, ["v"])


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state_per_key(spark: SparkSession, d: str) -> DataFrame:
    """K4, C3"""
    return latest(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_prop_extract(spark: SparkSession, d: str) -> DataFrame:
    """H12, N1"""
    return table(spark, d, "events").select("event_id", vl.count_or_null(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """An extension: the batch form of the streaming counts."""
    return windowed_counts(table(spark, d, "events"))


@query("""SELECT user_id, event_id, last_value(CASE WHEN value > 10 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events""")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """P27"""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("value") > 10, F.col("value")).alias("value"))
    return relational.forward_fill(e, ["value"], F.col("event_id"), ["user_id"])


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_repeat, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS first_id FROM documents")
def repeat_flags(spark: SparkSession, d: str) -> DataFrame:
    """P28, P29"""
    flagged = relational.flag_repeats(_docs(spark, d).select("doc_id", "text"), ["text"], F.col("doc_id"))
    return relational.first_spelling(flagged, ["text"], "doc_id", F.col("doc_id"), "first_id").select("doc_id", "is_repeat", "first_id")


@query("SELECT count(o_totalprice) AS n, median(o_totalprice) AS median, max(o_totalprice) AS greatest FROM orders")
def number_summary(spark: SparkSession, d: str) -> DataFrame:
    """A6"""
    return reports.number_summary(table(spark, d, "orders"), "o_totalprice")


@query("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(15, floor((value - lo) * 15 / (hi - lo))::INTEGER + 1) AS bin, count(*) AS n FROM events, s GROUP BY 1""")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A6"""
    return reports.histogram(table(spark, d, "events"), "value", 15)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN 'large' WHEN l_quantity >= 20 THEN 'middle' WHEN l_quantity >= 5 THEN 'small' END AS band FROM lineitem""")
def as_of_band(spark: SparkSession, d: str) -> DataFrame:
    """The last mark at or before a value."""
    marks = spark.createDataFrame([(5.0, "small"), (20.0, "middle"), (40.0, "large")], "start double, band string")
    return relational.as_of(table(spark, d, "lineitem"), marks, "l_quantity", "start", "band").select("l_orderkey", "l_linenumber", "band")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity - 10) <= abs(l_quantity - 30) AND abs(l_quantity - 10) <= 8 THEN 'ten' WHEN abs(l_quantity - 30) < abs(l_quantity - 10) AND abs(l_quantity - 30) <= 8 THEN 'thirty' END AS near FROM lineitem""")
def nearest_mark(spark: SparkSession, d: str) -> DataFrame:
    """P23"""
    marks = spark.createDataFrame([(10.0, "ten"), (30.0, "thirty")], "at double, near string")
    return relational.nearest_mark(table(spark, d, "lineitem"), marks, "l_quantity", "at", "near", 8.0).select("l_orderkey", "l_linenumber", "near")


@query(r"""SELECT doc_id, CASE WHEN length(text) < 50 THEN 'too_short' WHEN l.quality = 1 THEN 'found' WHEN l.quality = 0 THEN 'truncated' ELSE 'found' END AS abstract_status FROM documents LEFT JOIN labels l USING (doc_id)""")
def abstract_status(spark: SparkSession, d: str) -> DataFrame:
    """The status machine."""
    joined = _docs(spark, d).select("doc_id", "text").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "found").when(F.col("quality") == 0, "truncated")
    return joined.select("doc_id", abstract_state(F.col("text"), status, 50).alias("abstract_status"))


@query()
def name_scores(spark: SparkSession, d: str) -> DataFrame:
    """M1: every supplier's name against the one with the next number."""
    s = table(spark, d, "supplier").select("s_suppkey", tx.match_key_ascii(F.col("s_name")).alias("k"))
    n = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("k").alias("k2"))
    return s.join(n, "s_suppkey").select("s_suppkey", F.round(matching.name_score(F.col("k"), F.col("k2")), 6).alias("score"))


# ---------------------------------------------------------------- rosters


@query("""WITH s AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS seen FROM orders GROUP BY ALL), p AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS seen FROM orders GROUP BY ALL),
a AS (SELECT o_custkey, string_agg(o_orderstatus, ' | ' ORDER BY seen) AS o_orderstatus FROM s GROUP BY 1), b AS (SELECT o_custkey, string_agg(o_orderpriority, ' | ' ORDER BY seen) AS o_orderpriority FROM p GROUP BY 1),
o AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice, count(*) AS n_rows FROM orders GROUP BY 1)
SELECT * FROM o JOIN a USING (o_custkey) JOIN b USING (o_custkey)""")
def one_per_person(spark: SparkSession, d: str) -> DataFrame:
    """D13"""
    return roster.one_per_person(table(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_totalprice"], ["o_orderstatus", "o_orderpriority"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) > 1 AS again FROM orders),
h AS (SELECT * FROM r WHERE o_orderstatus = 'F'), f AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS label FROM h GROUP BY 1)
SELECT 'rows' AS metric, NULL AS label, count(*) AS n FROM r UNION ALL SELECT 'people', NULL, count(DISTINCT o_custkey) FROM r UNION ALL SELECT 'repeats', NULL, count(*) FILTER (again) FROM r
UNION ALL SELECT 'missing o_orderstatus', NULL, count(*) FILTER (o_orderstatus IS NULL) FROM r UNION ALL SELECT 'missing o_orderpriority', NULL, count(*) FILTER (o_orderpriority IS NULL) FROM r UNION ALL SELECT 'missing team', NULL, count(*) FILTER (year(o_orderdate) IS NULL) FROM r
UNION ALL SELECT 'missing kind', NULL, count(*) FILTER (month(o_orderdate) IS NULL) FROM r
UNION ALL SELECT 'home people', NULL, count(DISTINCT o_custkey) FROM h UNION ALL SELECT 'home labs', NULL, count(DISTINCT o_orderpriority) FROM h UNION ALL SELECT 'home teams', NULL, count(DISTINCT (o_orderpriority, year(o_orderdate))) FROM h
UNION ALL SELECT 'people of several rows', NULL, count(*) FROM (SELECT o_custkey FROM r WHERE NOT again GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'people by lab', label, count(*) FROM f GROUP BY label
UNION ALL SELECT 'people by team', o_orderpriority || ' / ' || year(o_orderdate), count(DISTINCT o_custkey) FROM h GROUP BY ALL
UNION ALL SELECT 'rows by home', o_orderstatus, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'rows by kind', month(o_orderdate)::VARCHAR, count(*) FROM r GROUP BY ALL""")
def member_counts(spark: SparkSession, d: str) -> DataFrame:
    """A10, A14"""
    rows = relational.flag_repeats(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], F.col("o_orderkey"), "again")
    rows = rows.withColumns({"team": F.year("o_orderdate").cast("string"), "kind": F.month("o_orderdate").cast("string")})
    return roster.member_counts(rows, "o_custkey", "o_orderkey", "o_orderstatus", "o_orderstatus = 'F'", "again", "o_orderpriority", "team", "kind")


@query("""SELECT c_custkey AS person, coalesce(n.x, o.x, '') AS external_id FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS x FROM orders GROUP BY 1) o ON c_custkey = o.o_custkey
LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS x FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) n ON c_custkey = n.o_custkey""")
def fill_ids(spark: SparkSession, d: str) -> DataFrame:
    """P18"""
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("external_id"), "o_orderstatus")
    return roster.fill_ids(table(spark, d, "customer").select(F.col("c_custkey").alias("person")), found, found.where("o_orderstatus = 'P'"), "person", "external_id")


@query("SELECT coalesce(quality::VARCHAR, 'pending') AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """A14, A15"""
    return roster.status_counts(_docs(spark, d), table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("status")), "doc_id")
