"""Backends over a local server and saved pages, settings, the command line, and the smaller operators."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.operators import charts, embed, matching, records
from tessera.sources import backends, calls, payloads, readers

PROFILE = '<div id="gsc_prf_in">Ann Lee</div><tr class="gsc_a_tr"><td><a class="gsc_a_at" href="/c?citation_for_view=u:1">T</a></td></tr><button id="gsc_bpf_more">'


@pytest.fixture
def site():
    asked = []

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body, code = {"/robots.txt": ("User-agent: *\nDisallow: /citations?view_op=view_citation\n", 200)}.get(self.path, (PROFILE, 200))
            if "user=gone" in self.path:
                code = 404
            elif "user=stop" in self.path:
                code = 429
            elif "user=robot" in self.path:
                body = "Please show you are NOT A ROBOT"
            elif "user=late" in self.path and sum("user=late" in p for p in asked) < 3:
                code = 503
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_http_backend(site):
    address, asked = site
    waits = []
    backend = backends.make("http", site=address, agent="tests", wait=(1, 1), sleep=waits.append)
    assert "Ann Lee" in backend.profile("u") and backend.profile("gone") is None and "Ann Lee" in backend.profile("late")
    with pytest.raises(calls.Disallowed):
        backend.detail("u:1")
    for person in ("stop", "robot"):
        with pytest.raises(calls.Blocked):
            backend.profile(person)
    assert asked[0] == "/robots.txt" and len(waits) >= 5 and sum("user=late" in p for p in asked) == 3
    pages = list(backends.profile_pages(backend, "u", 3, lambda html: (2, True)))
    assert len(pages) == 2 and any("cstart=2" in p for p in asked)
    closed = backends.Http("http://127.0.0.1:1", "tests", retries=0, sleep=waits.append)
    with pytest.raises(calls.Disallowed):  # rules that cannot be read forbid all
        closed.profile("u")
    assert payloads.permitted([("/a", False), ("/a/b", True), ("/*.pdf$", False)], "/a/b") and not payloads.permitted([("/*.pdf$", False)], "/x.pdf")
    with pytest.raises(ValueError, match="no backend"):
        backends.make("other")


def test_pages_as_a_data_source(spark, tmp_path):
    (tmp_path / "profile-a-0.html").write_bytes(PROFILE.encode() + b"\xff")
    spark.dataSource.register(backends.PageSource)
    found = spark.read.format("pages").option("folder", str(tmp_path)).option("keys", json.dumps(["a", "b"])).option("parts", "2").load()
    got = {r.key: (r.status, r.name) for r in found.withColumn("name", payloads.profile(F.col("html"))["name"]).collect()}
    assert got == {"a": ("ok", "Ann Lee"), "b": ("not_found", None)}


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"a": {"b": 1}}')
    (tmp_path / ".env").write_text("KEY=abc\nBLANK=\n# NO=1\nQ='x y'\n")
    assert backends.settings(str(tmp_path / "s.json"), str(tmp_path / ".env")) == {"a": {"b": 1}, "env": {"KEY": "abc", "Q": "x y"}}


def test_encoders_are_checked():
    waits, seen = [], []

    def flaky(texts):
        seen.append(texts)
        if len(seen) == 1:
            raise calls.Transient("busy")
        return [[1.0, 2.0]] * len(texts)

    assert embed.checked(flaky, 2, "m", "m", sleep=waits.append)(["a", "b"]).shape == (2, 2) and len(waits) == 1
    with pytest.raises(calls.Unreadable):
        embed.checked(lambda t: [[float("nan")]] * len(t), 1)(["a"])
    with pytest.raises(ValueError, match="model"):
        embed.checked(flaky, 2, "m", "other")


def test_attached_vectors(spark):
    nested = spark.createDataFrame([("p", [("a1", "T"), ("a2", "U")]), ("q", [])], "chercheur_id string, articles array<struct<article_id:string,titre:string>>")
    vectors = spark.createDataFrame([("a1", [0.1234567, 1.0])], "article_id string, embedding array<double>")
    got = {r.chercheur_id: [(x.article_id, x.titre, x.embedding) for x in r.articles] for r in embed.attach(nested, vectors).collect()}
    assert got == {"p": [("a1", "T", [0.12346, 1.0]), ("a2", "U", None)], "q": []}
    assert all(x.embedding is None for r in embed.attach(nested, vectors, "false").collect() for x in r.articles)
    articles = spark.createDataFrame([("a2", "x", "title_only"), ("a1", None, "none"), ("a0", "y", "title_only")], "article_id string, embedding_text string, embedding_source string")
    assert [r.article_id for r in embed.embeddable(articles, 1).collect()] == ["a0"]
    manifest = spark.createDataFrame([(0, "a1"), (1, "a2")], "row int, article_id string")
    rows = spark.createDataFrame([(0, [1.0])], "row int, embedding array<double>")
    assert readers.vectors_with_manifest(rows, manifest.where("row = 0")).count() == 1
    with pytest.raises(ValueError, match="manifest"):
        readers.vectors_with_manifest(rows, manifest)


def test_templates_are_asked_in_order(spark):
    rows = [("p", "a", 0.9, 0.9, 2), ("p", "b", 0.9, 0.2, 1), ("q", "a", 0.9, 0.9, 1), ("q", "b", 0.9, 0.85, 2), ("r", "a", 0.1, 0.9, 1)]
    got = {r.person: (r.status, r.candidate_id, r.asked) for r in matching.decide_by_templates(spark.createDataFrame(rows, "person string, candidate_id string, name_score double, score double, template_rank int"), "person", 2).collect()}
    assert got == {"p": ("matched", "a", 2), "q": ("matched", "a", 1), "r": ("not_found", None, 2)}


def test_collected_publications(spark):
    pub = "array<struct<raw_pub_id:string,titre:string,annee:int,doi:string,external_url:string,pdf_url:string,abstract:string,abstract_source:string,abstract_status:string,journal:string,conference:string,publisher:string>>"
    state = f"chercheur_id string, scholar_profile_status string, publications {pub}"
    one = lambda i: (i, "Shared work title", 2020, None, None, None, None, None, "not_found", None, None, None)
    primary = spark.createDataFrame([("p", "matched", [one("p::1")]), ("q", "ambiguous", [])], state)
    fallback = spark.createDataFrame([("q", "matched", [one("q::1")]), ("p", "matched", [])], state)
    from tessera.operators.enrich import work_key

    key = spark.range(1).select(work_key(F.lit("shared work title"), F.lit(2020)).alias("k")).first().k
    answer = spark.createDataFrame([(key, "ok", "10.1000/x", "y" * 90, "J", None)], "key string, status string, doi string, abstract string, journal string, publisher string")
    found, states, fresh = records.collected(primary, fallback, [("one", answer)])
    assert sorted((r.raw_pub_id, r.doi, r.abstract_status) for r in found.collect()) == [("p::1", "10.1000/x", "found"), ("q::1", "10.1000/x", "found")]
    assert fresh.count() == 1 and {r.chercheur_id: r.data_source for r in states.collect()} == {"p": "primary", "q": "fallback"}


def test_command_line(spark, tmp_path):
    from tests.test_records import RAW, _raw

    spark.createDataFrame([_raw(0, "Deep nets for rivers", annee=2015), _raw(1, "Deep nets for rivers", annee=2015), _raw(2, "Water in the long basin", annee=2016)], RAW).write.parquet(str(tmp_path / "raw"))
    out = str(tmp_path / "out")
    main(["clean", "--records", str(tmp_path / "raw"), "--output", out], spark)
    assert spark.read.parquet(f"{out}/articles").count() == 2 and spark.read.parquet(f"{out}/errors").count() == 0
    main(["embed", "--articles", f"{out}/articles", "--output", f"{out}/vectors"], spark)
    main(["index", "--vectors", f"{out}/vectors", "--output", f"{out}/index"], spark)
    assert spark.read.parquet(f"{out}/index/vectors").count() == 2
    people = spark.createDataFrame([("p0", "Ann", "Lab A | Lab B", ["nets"], 5, 3, "matched"), ("p1", "Bo", None, [], None, None, "pending")], "chercheur_id string, nom_complet string, laboratoire string, interests array<string>, citations_totales int, h_index int, scholar_profile_status string")
    tables = charts.chart_tables(people, spark.read.parquet(f"{out}/articles"), spark.read.parquet(f"{out}/links"))
    got = {k: [tuple(r) for r in t.collect()] for k, t in tables.items()}
    assert got["publications_by_person"] == [("Ann", 2), ("Bo", 1)] and got["publications_by_lab"][0][1] == 2 and got["articles_by_year"] == [(2015, 1), (2016, 1)] and got["citations_by_person"] == [("Ann", 5)]
    with pytest.raises(SystemExit):
        main(["unknown"], spark)


def test_json_has_no_nan(spark, tmp_path):
    from tessera.sources import sinks

    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")], (float("nan"), "x"), {"k": float("-inf")})], "i int, a double, b array<double>, s struct<x:double,y:string>, m map<string,double>")
    sinks.json_lines(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert "NaN" not in text and "Infinity" not in text and json.loads(text)["b"] == [1.0, None] and json.loads(text)["s"] == {"y": "x"}
    sinks.csv(df.select("i", "b"), str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), "i int, b string").first().i == 1


def test_best_titles(spark):
    items = spark.createDataFrame([("a", "deep nets for rivers", 2015), ("b", "nothing alike", None)], "item string, title_key string, year int")
    found = spark.createDataFrame([("a", 0, "deep nets for rivers", 2019), ("a", 1, "deep net for rivers", 2016), ("a", 2, "deep nets for river", None), ("b", 0, "other words", 2015)], "item string, pos int, title_key string, year int")
    assert [(r.item, r.pos) for r in matching.best_title(items, found, "item").collect()] == [("a", 1)]
