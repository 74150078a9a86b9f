"""Queries of the catalog on tables made here, against their SQL or brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql.functions import udf

from tessera import catalog, catalog_records  # noqa: F401
from tessera.operators import dedup, topics, vectors
from tessera.plans.shared import materialise, tidy


def test_decisions_round_as_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(30 + 50 * k, k, 1000.0 * k + half + 0.5) for k, half in enumerate([*range(495, 520), 0, 999, 123])]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    columns = ["person", "status", "confidence", "candidate_id", "listing"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL['match_decisions']})").fetchall()
    got = catalog.QUERIES["match_decisions"](spark, str(tmp_path)).select(columns).collect()
    assert len(got) == len(rows) and sorted(tuple(r) for r in got) == sorted(want)


def _counted(spark, df, column):
    """df with a column passed through Python, and the count of values that passed."""
    seen = spark.sparkContext.accumulator(0)

    @udf("string")
    def passed(x):
        seen.add(1)
        return x

    return df.withColumn(column, passed.asNondeterministic()(column)), seen


def test_titles_are_made_once_for_all_edges(spark):
    rnd = random.Random(4)
    rows = [(k, " ".join(rnd.choices(["deep", "nets", "for", "rivers", "of", "water", "basin"], k=5)), 2015 + k % 2, None) for k in range(60)]
    given, seen = _counted(spark, spark.createDataFrame(rows, "rid long, title_key string, year int, doi string"), "title_key")
    grouped = dedup.group_records(given).select("rid", "root").collect()
    assert len(grouped) == 60 and seen.value <= 120


def test_groups_of_copies_years_and_dois_by_hand(spark):
    # the ratio depends on the order of titles, and a copy may stand on the other side of a record than the first
    rnd = random.Random(11)
    base = [" ".join("".join(rnd.choices("abcd", k=rnd.randrange(3, 9))) for _ in range(rnd.randrange(4, 9))) for _ in range(6)]

    def turned(x):
        k = rnd.randrange(len(x))
        return " ".join((x[:k] + rnd.choice(["", "a", "b", x[k] * 2, " "]) + x[k + 1 :]).split())

    titles = base + [turned(rnd.choice(base)) for _ in range(30)] + ["tide of a river by the long sea", "diet of a river by the long sea"]
    one_way = ["".join(rnd.choices("ab", k=7)) for _ in range(9)]
    pairs = [(" ".join(one_way), " ".join(one_way[:k] + ["".join(rnd.choices("ab", k=7))] + one_way[k + 1 :])) for k in range(9) for _ in range(30)]
    passes = lambda a, b: dedup.SequenceMatcher(None, a, b).ratio() >= dedup.THRESHOLD
    odd = [(a, b) if passes(a, b) else (b, a) for a, b in pairs if passes(a, b) != passes(b, a)]
    assert odd
    a, b = odd[0]
    # only a copy of a stands before b, and of b only a copy with a DOI stands behind a
    rows = [(0, b, 2000, None), (1, a, 2000, "d0"), (2, a, 2000, None), (3, b, 2000, None), (4, b, 2001, "d1"), (5, a, 2007, None), (6, b, 2007, "d2"), (7, a, 2009, "d3"), (8, b, 2009, None), (9, a, 2009, None)]
    rows += [(k, rnd.choice(titles), rnd.choice([None, 2010, 2010, 2011, 2012]), rnd.choice([None, None, "x", "y", f"z{k % 40}"])) for k in range(10, 260)]
    root = list(range(len(rows)))

    def find(k):
        return k if root[k] == k else find(root[k])

    for i, x, yx, dx in rows:
        for j, y, yy, dy in rows[i + 1 :]:
            clash = bool(dx and dy and dx != dy)
            link = bool(dx and dx == dy) or (x == y and len(x.split()) >= 3 and (yx is None or yy is None or yx == yy) and not clash)
            p, q = set(x.split()), set(y.split())
            if not link and not clash and yx and yy and abs(yx - yy) <= 1 and min(len(p), len(q)) >= 4 and len(p & q) / len(p | q) >= 0.6:
                link = passes(x, y) if yx <= yy else passes(y, x)
            if link:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    got = {r.rid: r.root for r in dedup.group_records(spark.createDataFrame(rows, "rid long, title_key string, year int, doi string")).collect()}
    assert got == {k: find(k) for k in range(len(rows))}


def test_dois_of_near_titles_are_not_paired(spark):
    # 800 points with DOIs, of which no two may be linked by their titles
    store = spark.sparkContext._jsc.sc().statusStore()
    sent = lambda: store.executorSummary("driver").totalShuffleWrite()
    title = " ".join(f"long{k} words{k}" for k in range(20))
    rows = [(k, title + " river" * (k % 2), 2015 + k % 3, f"d{k}") for k in range(800)] + [(900, title, 2015, None), (901, title + " river", 2016, None)]
    given = spark.createDataFrame(rows, "rid long, title_key string, year int, doi string")
    before = sent()
    grouped = dedup.group_records(given).select("rid", "root").collect()
    assert sent() - before < 2_000_000
    # bare 900 reaches the years 2015 and 2016 of both titles, bare 901 all of them
    assert {r.root for r in grouped} == {0} and len(grouped) == 802


def test_titles_of_one_shared_word_are_not_read(spark, monkeypatch):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choices("abcdefghij", k=8))
    rows = [(k, " ".join([f"rare{k % 5}"] + [word() for _ in range(30)]), 2015, None) for k in range(200)]
    written, plain = {}, dedup.materialise

    def kept(df, name="step"):
        out = plain(df, name)
        if name == "pairs":
            written[name] = out.count()
        return out

    monkeypatch.setattr(dedup, "materialise", kept)
    given = spark.createDataFrame(rows, "rid long, title_key string, year int, doi string")
    assert dedup.group_records(given).where("rid <> root").count() == 0 and written["pairs"] == 0


def test_tidy_sets_the_deletion_of_shuffles(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    with tidy(spark):
        assert spark.conf.get(setting) == "true"
        assert materialise(spark.range(1000).repartition(3, "id"), "t").count() == 1000
    assert spark.conf.get(setting, None) == before


def test_articles_are_made_once_for_their_numbers(spark):
    rows = [(k, f"the river {k % 7}", 2000 + k % 3) for k in range(100)]
    given, seen = _counted(spark, spark.createDataFrame(rows, "root long, title_key string, year int"), "title_key")
    got = {r.root: r.article_id for r in dedup.number_articles(given).collect()}
    want = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    assert got == {r[0]: f"art_{k:05d}" for k, r in enumerate(want, 1)} and seen.value <= 200


def test_histogram_counts_all_pairs_of_many_rows(spark, monkeypatch):
    # 1.1e7 pairs one by one as Spark rows take minutes
    monkeypatch.setattr(vectors, "SLICE_BYTES", 1 << 20)
    x = np.random.default_rng(3).normal(size=(4800, 64)) + 0.3
    x[7] = x[5]
    df = spark.createDataFrame([(k, [float(c) for c in row]) for k, row in enumerate(x)] + [(9000, None), (9001, [None] * 64)], "vec_id long, embedding array<double>")
    plans = []
    monkeypatch.setattr(vectors, "dot", lambda *a: plans.append(a))  # no pair is a row
    got = {r.bin: r.n for r in vectors.similarity_histogram(df, sample=5000).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = np.round((u @ u.T)[np.triu_indices(len(u), 1)], 9)
    want = np.bincount(np.minimum(20, np.floor((cosine + 1) * 10).astype(int) + 1))
    assert got == {k: int(v) for k, v in enumerate(want) if v} and not plans
    few = vectors.similarity_histogram(df, sample=100).collect()
    assert sum(r.n for r in few) == 100 * 99 // 2


def _terms_by_hand(rows, stop, top, least):
    each, texts = defaultdict(Counter), Counter(r[1] for r in rows)
    for key, cluster, text in rows:
        words = [w for w in (text or "").lower().split() if len(w) > 1 and w not in stop]
        each[key, cluster].update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = Counter(t for c in each.values() for t in c)
    value = {k: {t: n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items() if df[t] >= least} for k, c in each.items()}
    length = Counter()
    for (key, _), v in value.items():
        length[key] += sum(x * x for x in v.values())
    sums = defaultdict(Counter)
    for (key, cluster), v in value.items():
        for t, x in v.items():
            sums[cluster][t] += x / math.sqrt(length[key])
    return {(c, k): (t, round(w / texts[c], 9)) for c, s in sums.items() if c is not None for k, (t, w) in enumerate(sorted(s.items(), key=lambda x: (-round(x[1], 9), x[0]))[:top], 1)}


@pytest.mark.parametrize("repeated", [False, True])
def test_cluster_terms_by_hand(spark, monkeypatch, repeated):
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcde", k=1 + k % 4)) for k in range(80)]
    rows = [(k // 2 if repeated else k, rnd.choice(["x", "y", None]), " ".join(rnd.choices(words, weights=range(80), k=rnd.randrange(1, 40)))) for k in range(150)] + [(900, "x", None), (901, "z", "alone alone")]
    want = _terms_by_hand(rows, ["abc"], 6, 2)
    for listed, chars in ((512, 1 << 20), (8, 300)):
        monkeypatch.setattr(topics, "LISTED", listed, raising=False)
        monkeypatch.setattr(topics, "RANGE_CHARS", chars, raising=False)
        found = topics.cluster_terms(spark.createDataFrame(rows, "k long, c string, t string").repartition(3), "k", "t", "c", ["abc"]).collect()
        assert {(r.c, r["rank"]): (r.term, round(r.weight, 9)) for r in found} == want


def test_cluster_terms_send_hashes_once(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    sent = lambda: store.executorSummary("driver").totalShuffleWrite()
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefghij", k=8)) for _ in range(3000)]
    rows = [(k, "xy"[k % 2], " ".join(rnd.choices(words, k=150))) for k in range(2000)]
    before = sent()
    assert len(topics.cluster_terms(spark.createDataFrame(rows, "k long, c string, t string"), "k", "t", "c", []).collect()) == 12
    assert sent() - before < 20 * 600_000
