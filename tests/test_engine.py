import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import engine, roster
from tessera.operators.embed import hashed_words


def test_engine(spark, tmp_path):
    titles = {"a1": "river water flow", "a2": "river basin water", "a3": "lamp and stone", "a4": "stone house lamp"}
    vectors = spark.createDataFrame([(k, [float(x) for x in 3 * v]) for k, v in zip(titles, hashed_words(list(titles.values())), strict=True)], "article_id string, embedding array<double>")
    info = engine.save_index(vectors, str(tmp_path / "index"), "article_id").first()
    assert (info.n, info.dim) == (4, 128)
    records = spark.createDataFrame([(k, t, "word " * 100, 2020, None, "10.1/x" if k == "a1" else None, "http://u") for k, t in titles.items()], "article_id string, title string, abstract string, year int, citations int, doi string, url string")
    people = spark.createDataFrame([("p1", "Ann", "L1", None), ("p2", "Bo", "L1", "T2")], "person_id string, name string, lab string, team string")
    links = spark.createDataFrame([("a1", "p2", 0), ("a1", "p1", 1), ("a2", "p1", 0), ("a3", "p2", 0), ("a3", "gone", 1)], "article_id string, person_id string, position int")
    found = engine.Engine.load(spark, str(tmp_path / "index"), records, people, links)

    hits = found.search(["  river water flow ", "lamp"], 2).collect()
    assert [(r.query_id, r.rank) for r in hits] == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert hits[0].article_id == "a1" and hits[0].score == 1.0 and hits[0].people == ["Bo", "Ann"] and hits[0].labs == ["L1"] and hits[0].teams == ["T2"]
    assert hits[0].url == "https://doi.org/10.1/x" and hits[1].url == "http://u" and len(hits[0].abstract) <= 301
    third = next(r for r in hits if r.article_id == "a3")
    assert third.person_ids == ["p2", "gone"] and third.people == ["Bo"]
    assert next(r for r in hits if r.article_id == "a4").people == []

    q = hashed_words(["river water flow"])[0]
    cosine = {k: float(np.dot(q, v)) for k, v in zip(titles, hashed_words(list(titles.values())), strict=True)}
    ranked = found.search_people("river water flow", 5).collect()
    want = {"p1": (cosine["a1"] + cosine["a2"]) / 3, "p2": (cosine["a1"] + cosine["a3"]) / 3, "gone": cosine["a3"] / 3}
    assert [r.person_id for r in ranked] == sorted(want, key=want.get, reverse=True)
    assert all(abs(r.owner_score - want[r.person_id]) < 1e-4 for r in ranked)
    assert [t.article_id for t in ranked[0].top_items] == ["a1", "a2"]

    for bad in (" ", [], ["ok", ""]):
        with pytest.raises(ValueError):
            found.search(bad)
    with pytest.raises(ValueError):
        engine.save_index(vectors.unionByName(vectors), str(tmp_path / "bad"), "article_id")


def test_roster(spark):
    rows = spark.createDataFrame(
        [(1, "p", "P", "H", "L2", None, "k", False), (2, "p", "P.", "H", "L1", "T", None, False), (3, "p", "P", "H", "L2", " ", "k", True), (4, "q", "Q", "H", None, "T", "k", False), (5, "r", "R", None, "L1", None, "k", False)],
        "row int, person string, name string, home string, lab string, team string, kind string, is_repeat boolean",
    )
    got = {r.person: (r.name, r.n_rows, r.lab, r.team) for r in roster.one_per_person(rows, "person", "row", ["name"], ["lab", "team"]).collect()}
    assert got == {"p": ("P", 3, "L2 | L1", "T"), "q": ("Q", 1, None, "T"), "r": ("R", 1, "L1", None)}
    counts = {(r.metric, r.label): r.n for r in roster.member_counts(rows, "person", "row", "home", "coalesce(home, '') = 'H'").collect()}
    assert counts["rows", None] == 5 and counts["people", None] == 3 and counts["repeats", None] == 1 and counts["home people", None] == 2
    assert counts["home labs", None] == 2 and counts["home teams", None] == 4 and counts["people of several rows", None] == 1
    assert counts["people by lab", "L2"] == 1 and counts["people by lab", "(non renseigné)"] == 1 and ("people by lab", "L1") not in counts
    assert counts["people by team", "L1 / T"] == 1 and counts["rows by home", "H"] == 4 and counts["missing kind", None] == 1
    ids = lambda x: spark.createDataFrame(x, "person string, ext string")
    people = rows.select("person").distinct()
    filled = {r.person: r.ext for r in roster.fill_ids(people, ids([("p", " o "), ("q", "o")]), ids([("q", "n")]), "person", "ext").collect()}
    assert filled == {"p": "o", "q": "n", "r": ""}
    states = spark.createDataFrame([("p", "matched"), ("x", "matched")], "person string, status string")
    assert {r.status: r.n for r in roster.status_counts(people, states, "person").collect()} == {"matched": 1, "pending": 2}
    assert roster.one_per_person(rows.where(F.lit(False)), "person", "row", ["name"], ["lab"]).count() == 0
