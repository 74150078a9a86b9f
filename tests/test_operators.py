import numpy as np
from pyspark.sql import functions as F

from tessera.operators import dedup, embed, enrich, layout, matching, relational, vectors
from tessera.operators.components import connected_components
from tessera.sources import payloads
from tessera.streaming.state import read_state, upsert_into


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: find(n) for n in nodes}
    parts = connected_components(spark.createDataFrame(pairs, "src long, dst long"), part=40)  # stars go on from forests of parts
    assert {r.node: r.component for r in parts.collect()} == got
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_dedup_cases(spark):
    rows = [
        (0, "deep nets for rivers", 2015, "d1"), (1, "other words here", 2019, "d1"),  # one DOI
        (2, "a same long title", 2015, None), (3, "a same long title", 2015, None), (4, "a same long title", 2021, None),  # years differ
        (5, "survey", 2015, None), (6, "survey", 2015, None),  # one word
        (7, "learning of water flows in basins", 2016, None), (8, "learning of water flow in basins", 2017, None),  # one letter, a year apart
        (9, "theory of water part i", 2016, None), (10, "theory of water part ii", 2016, None),  # parts
        (11, "three whole words", 2015, "x"), (12, "three whole words", 2015, "y"),  # two DOIs
    ]
    grouped = dedup.group_records(spark.createDataFrame(rows, "rid long, title_key string, year int, doi string"))
    assert {r.rid: r.root for r in grouped.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11, 12: 12}


def test_survivors_and_numbers(spark):
    rows = [(0, 0, "b", None, 5), (1, 0, "b", "d", 3), (2, 2, "a", None, None)]
    merged = dedup.survivors(spark.createDataFrame(rows, "rid long, root long, title_key string, doi string, year int"), ["title_key", "doi", "year"], [F.col("doi").isNull().cast("int")])
    got = {r.article_id: (r.root, r.doi, r.year, r.n_source_records) for r in dedup.number_articles(merged).collect()}
    assert got == {"art_00001": (2, None, None, 1), "art_00002": (0, "d", 3, 2)}


def test_name_scores(spark):
    cases = [("amina el idrissi", "idrissi amina el", 1.0), ("el amrani ali", "ali elamrani", 0.95), ("sara ben ali", "sara ben ali haddad", 0.85), ("x", "", 0.0), ("john smith", "paul jones", 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string").select(matching.name_score(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in df.collect()] == [c[2] for c in cases]


def test_decisions(spark):
    rows = [("p", "a", 0.9, 0.9), ("p", "b", 0.9, 0.5), ("q", "a", 0.9, 0.8), ("q", "b", 0.9, 0.75), ("r", "a", 0.1, 0.9)]
    got = {r.person: (r.status, r.candidate_id) for r in matching.decide(spark.createDataFrame(rows, "person string, candidate_id string, name_score double, score double"), "person").collect()}
    assert got == {"p": ("matched", "a"), "q": ("ambiguous", None), "r": ("not_found", None)}


def test_owner_ranking_divides_by_m(spark):
    hits = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.6), (0, 3, 0.55), (0, 4, 0.5)], "query_id int, item int, score double")
    links = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "b")], "item int, owner string")
    got = {r.owner: round(r.owner_score, 2) for r in vectors.rank_owners(hits, links, "item", "owner").collect()}
    assert got == {"a": 0.30, "b": 0.55}


def test_search_edges(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, query array<float>")
    assert [(r.vec_id, round(r.score, 6)) for r in vectors.search(index, queries, 99).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert vectors.search(index, queries, 0).count() == 1


def test_batches_and_cache(spark):
    assert [len(b) for b in embed.make_batches(["x"] * 7, 3)] == [3, 3, 1]
    assert [len(b) for b in embed.make_batches(["a" * 100, "b" * 100, "c" * 100], 9, 520)] == [2, 1]
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, " ")], "id int, text string")
    out, fresh = embed.embed(df, "text", "m")
    assert fresh.count() == 1 and {r.id: r.embedding is not None for r in out.collect()} == {1: True, 2: True, 3: False}
    again, new = embed.embed(df, "text", "m", cache=fresh)
    assert new.count() == 0 and again.where("embedding is not null").count() == 2


def test_layout(spark):
    words = [(1, "1", 103.0, 100.0, 110.9), (1, "Hydro-", 214.0, 92.0, 102.9), (1, "logie", 214.0, 108.0, 118.9), (1, "A", 362.0, 100.0, 110.9), (1, "2", 103.0, 150.0, 160.9), (1, "Two", 214.0, 150.0, 160.9), (1, "words", 240.0, 151.0, 161.9), (1, "far", 214.0, 400.0, 410.9)]
    columns = [(1, "#", 103.0), (1, "lab", 214.0), (1, "team", 362.0)]
    got = {(r.row_number, r.name): r.value for r in layout.table_rows(spark.createDataFrame(words, "page int, text string, x0 double, top double, bottom double"), spark.createDataFrame(columns, "page int, name string, start double")).collect()}
    assert got == {(1, "lab"): "Hydrologie", (1, "team"): "A", (2, "lab"): "Two words"}
    assert [r.n for r in layout.sequence_gaps(spark.createDataFrame([(1,), (3,)], "n int"), "n", F.lit(4)).orderBy("n").collect()] == [2, 4]


def test_enrichment_order(spark):
    given = "key string, doi string, external_url string, pdf_url string, abstract string, abstract_source string, abstract_status string, journal string, conference string, publisher string"
    records = spark.createDataFrame([("k", None, None, "http://x/10.1000/p", "short", "own", "truncated", None, None, None), ("f", "10.1000/f", None, None, "y" * 90, "own", "found", None, "V", None)], given)
    answer = "key string, status string, doi string, abstract string, journal string, publisher string"
    first = spark.createDataFrame([("k", "ok", "10.1000/other", "longer but cut " * 9 + "...", None, "P")], answer)
    second = spark.createDataFrame([("k", "ok", None, "x" * 100, "J", "Q")], answer)
    got = {r.key: r for r in enrich.enrich(records, [("one", first), ("two", second)]).collect()}
    k, f = got["k"], got["f"]
    assert (k.doi, k.journal, k.publisher, k.abstract, k.abstract_source, k.abstract_status, k.final) == ("10.1000/p", "J", "P", "x" * 100, "two", "found", True)
    assert [(a.source, a.status) for a in k.attempts] == [("one", "found"), ("two", "found")] and f.attempts == [] and f.journal is None


def test_prefer_and_violations(spark):
    p = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    f = spark.createDataFrame([(1, "y"), (2, "z"), (3, None)], "k int, v string")
    got = {r.k: (r.v, r.data_source) for r in relational.prefer(p, f, "k", F.col("v").isNotNull(), ["v"]).collect()}
    assert got == {1: ("x", "primary"), 2: ("z", "fallback"), 3: (None, "none")}
    assert [r.field for r in relational.violations(p, "k", {"v": (F.col("v").isNull(), "empty"), "k": (F.col("k") > 5, "large")}).collect()] == ["v"]


def test_robots(spark):
    rules = spark.createDataFrame([("/private", False), ("/private/open", True), ("/*.pdf$", False), ("/tie", False), ("/tie", True)], "pattern string, allow boolean")
    urls = spark.createDataFrame([("/",), ("/private/x",), ("/private/open/x",), ("/a.pdf",), ("/a.pdf?x",), ("/tie",)], "path string")
    assert [r.allowed for r in payloads.robots_allowed(urls, rules).collect()] == [True, False, True, False, True, True]


def test_scholar_id_is_the_mode(spark):
    html = "x?citation_for_view=AAAAAAAAAAAA:1 citation_for_view=BBBBBBBBBBBB:1 citation_for_view=BBBBBBBBBBBB:2"
    df = spark.createDataFrame([(html,), ("?user=CCCCCCCCCCCC",), ("none",)], "h string").select(payloads.scholar_id(F.col("h")).alias("i"))
    assert [r.i for r in df.collect()] == ["BBBBBBBBBBBB", "CCCCCCCCCCCC", None]


def test_state_versions(spark, tmp_path):
    run = upsert_into(str(tmp_path / "state"), "k", "t", "e")
    run(spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "k int, t int, e int"), 0)
    second = spark.createDataFrame([(1, 5, 3)], "k int, t int, e int")
    run(second, 1)
    run(second, 1)  # a batch that is run again
    assert sorted((r.k, r.t) for r in read_state(spark, str(tmp_path / "state")).collect()) == [(1, 5), (2, 1)]


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    from tessera.plans.shared import materialise, scratch

    with scratch() as steps:
        a = materialise(spark.range(3))
        b = steps.keep(materialise(a.where("id > 0")))
    assert not Path(a._tessera_path).exists() and b.count() == 2
