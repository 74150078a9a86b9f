"""The training-data operators against brute force, and on odd rows: nulls, empty texts, ties, repeats, no rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import blocks, decontaminate, html, lm, mixing, neighbours, pii, quality, simhash, substring, suffixes, textbytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rnd = random.Random(4)
    vocabulary = ["the", "of", "And", "é", "straße", "x"] + [f"w{k}" for k in range(60)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = prose(400)
    return [
        (1, base, "b"), (2, None, None), (3, "", "a"), (4, " \n\t ", "a"), (5, base, "b"), (6, base[:500] + " cut " + base[900:], "a"), (7, prose(12), "b"),
        (8, "a" * 400, "c"), (9, "ab cd " * 120, "c"), (10, prose(30) + " " + base[200:600], "a"), (11, "one", "b"), (12, "é", "b"), (13, prose(5000), "b"), (14, "One", "B"), (15, base.upper(), "é"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns with names that the operators use themselves
    return spark.createDataFrame([(*r, 0, "p", "k") for r in corpus()], "doc_id long, text string, source string, block int, print string, key string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_block_packing():
    keys = np.sort(np.array([0, 1, 5, 5, 2**63, 2**64 - 1], np.uint64))
    assert (blocks.unpack_sorted(blocks.pack_sorted(keys))[0] == keys).all()
    values = np.array([-5, 3, 2**40], np.int64)
    assert (blocks.unpack_values(blocks.pack_values(values), 3, 0)[0] == values).all()
    counts = np.array([0, 1, 2, 3, 254, 257, 258, 70000, 1], np.int64)
    assert (blocks.unpack_counts(blocks.pack_counts(counts), 9)[0] == counts).all()
    table = pa.table({"doc_id": pa.array([3, 1, None, 1, 2], pa.int64()), "text": ["c", "b", "x", None, ""]})
    assert blocks.canonical(table).equals(blocks.canonical(table.take([4, 2, 0, 3, 1])))
    assert blocks.unbundle(blocks.bundle([b"a", b"", b"bc"])) == [b"a", b"", b"bc"]
    rng = np.random.default_rng(3)
    for wide in (1 << 20, 1 << 63):
        x = rng.integers(0, wide, 5000, dtype=np.uint64) | np.uint64(wide)
        x[:900] = x[900:1800]
        assert (textbytes.stable_order(x) == np.argsort(x, kind="stable")).all()


def test_words_and_windows():
    texts = [r[1] for r in corpus()]
    data, offsets = textbytes.column_bytes(pa.array(texts))
    starts, ends, bounds = textbytes.word_bounds(data, offsets)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in texts for w in WORD.findall(t or "")]
    joined, a, b = textbytes.joined_words(data, starts, ends)
    assert [joined[i:j].tobytes().decode() for i, j in zip(a, b, strict=True)] == words
    hashes = textbytes.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words))


# ---------------------------------------------------------------- 1


def test_quality(spark, empty):
    rnd = random.Random(1)
    good = lambda: " ".join(rnd.choice(["the", "of", "river", "stone", "in", "a", "house", "and", "lamp", "was"]) + str(rnd.choice(["", "", "ing", "er"])) for _ in range(60)) + "."
    bad = [lambda: "$$ ## | " * 40, lambda: "word " * 60, lambda: " | ".join(f"c{rnd.random()}" for _ in range(30)), lambda: "BUY NOW!! " * 30]
    rows = [(k, good() if k % 5 else bad[k // 5 % 4](), k % 5 > 0) for k in range(600)] + [(600, None, True), (601, "", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    got = {r.doc_id: r for r in quality.classify(df).collect()}
    assert len(got) == 602 and sum(got[k].keep == g for k, _, g in rows[:600]) >= 590
    assert quality.accepted(df).columns == df.columns
    assert quality.classify(empty).count() == 0


def test_quality_of_a_small_sample(spark):
    ids = spark.range(4_000_000)
    assert 1 <= ids.where(quality.picked(F.col("id"), 9e-6 / 10)).count() <= 12
    good = "the lamp of the house was in the old garden, and it is by the river that we sat. "
    rows = [(k, good + f"word{k} of the day.") for k in range(50)] + [(50 + k, "### $$$ ||| " * 9 + "!!! " * 9) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep, r.score == r.weak_posterior) for r in quality.classify(df, sample=0).collect()}
    assert all(got[k] == (k < 50, True) for k in range(70))


# ---------------------------------------------------------------- 2


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(700, 24)).astype(np.float32).round(2)
    vectors[300:340] = vectors[0]  # ties
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors)] + [(1000, None, 0), (1100, [0.0] * 24, 0), (1200, [float("nan")] * 24, 0), (1300, [1.0, 2.0], 0), (1301, [1.0, 3.0], 0), (None, [1.0, 3.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df).orderBy("query_id", "rank").collect()]
    want = []
    x = vectors.astype(np.float64)
    for q in range(0, 700, 100):
        d = neighbours.exact_distance(np.repeat(x[q : q + 1], 700, 0), x)
        best = sorted((d[k], k) for k in range(700) if k != q)[:10]
        want += [(q, i + 1, k, v) for i, (v, k) in enumerate(best)]
    want.append((1300, 1, 1301, 1.0))
    assert got == want


def test_neighbours_of_repeated_ids_and_huge_components(spark):
    rows = [(100, [3.0, 0.0], "a"), (100, [1.0, 0.0], "b"), (1, [1.0, 1.0], "c"), (2, [2.0, 0.0], "d"), (200, [1e150, 0.0], "e"), (3, [1e150, 1e140], "f"), (300, [1e200, 0.0], "g")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(df).collect()}
    assert got[100, 1] == (1, 1.0) and got[100, 2] == (2, 1.0) and got[200, 1] == (3, 1e140) and got[200, 2] == (1, 1e150) and got[300, 1] == (1, float("inf")) and (300, 6) in got
    assert neighbours.nearest(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 3


def test_decontamination(spark, empty):
    rnd = random.Random(3)
    words = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(18 + 4 * k)).capitalize() + ".") for k in range(6)] + [(7, None), (8, ""), (9, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    edited = items[2][1].split()
    edited[4], edited[15] = "changed", "also"
    del edited[9]
    rows = [(0, filler(400)), (1, f"{filler(50)} {items[1][1]} {filler(9)}"), (2, f"{filler(30)}\n{' '.join(edited)} {filler(80)}"), (3, None), (4, ""), (5, items[5][1].upper()), (6, f"x two, words y {items[0][1]}"), (None, items[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id): (r.first_word, r.distance) for r in decontaminate.matches(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (5, 5), (6, 9), (6, 0), (None, 3)}
    assert got[1, 1] == (50, 0) and 2 <= got[2, 2][1] <= 5
    assert [r.doc_id for r in decontaminate.clean(df, bench).collect()] == [0, 3, 4]
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(df, bench.limit(0)).count() == 0


def test_edit_distance_and_lsh_recall():
    rnd = random.Random(6)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
        return row[-1]

    for _ in range(200):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(9))] for _ in range(2))
        assert decontaminate.edit_distance(a, b, 3) == min(plain(a, b), 4)
    words = [f"u{k}" for k in range(500)]
    found = 0
    for trial in range(60):
        item = [rnd.choice(words) for _ in range(30)]
        copy = list(item)
        for _ in range(4):
            copy[rnd.randrange(30)] = "other"
        found += len(decontaminate.Matcher([trial], [" ".join(item)]).find(pa.array([" ".join(["pre"] * 7 + copy + ["post"] * 5)])))
    assert found >= 54


def test_long_items_at_the_full_distance():
    rnd = random.Random(16)
    words = [f"u{k}" for k in range(500)]
    for n in (100, 200, 300, 500):
        for trial in range(6):
            item = [rnd.choice(words) for _ in range(n)]
            copy = list(item)
            for k in rnd.sample(range(n), n // 5):
                copy[k] = "other"
            text = ["pre"] * 7 + copy + ["post"] * 5
            ((_, _, first, distance),) = decontaminate.Matcher([trial], [" ".join(item)]).find(pa.array([" ".join(text)]))
            assert first == 7 and distance == n // 5


# ---------------------------------------------------------------- 4


def test_golay_keys_lose_nothing():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
    for bits in (0, 1, 2, 3):
        other = base.copy()
        for i in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(int(b))
        sides = []
        for x in (base, other):
            keys, owner = simhash.bucket_keys(x)
            sides.append({(int(o), int(k)) for o, k in zip(owner, keys, strict=True)})
        assert {o for o, _ in sides[0] & sides[1]} == set(range(400))


def test_large_bucket_is_connected():
    rng = np.random.default_rng(8)
    prints = np.unique(np.bitwise_xor.accumulate(np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)))
    a, b = simhash.bucket_links(np.zeros(len(prints), np.int64), prints)
    assert len(a) <= len(prints) - 1 and (np.bitwise_count(a ^ b) <= 3).all() and len(a) == len(prints) - 1


def test_simhash(docs, empty, spark):
    prints = {}
    for i, t, _ in corpus():
        w = WORD.findall((t or "").translate(LOWER))
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else [])]
        prints[i] = sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))
    label = {i: i for i in prints}
    for _ in prints:
        label = {i: min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in prints}
    assert simhash.near_duplicates(empty).count() == 0
    repeated = docs.unionByName(docs.where("doc_id in (5, 13)")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    kept = [r.doc_id for r in simhash.one_of_each(repeated, shingle=3).collect()]
    assert sorted(kept, key=str) == sorted([*{i for i in label if label[i] == i}, None], key=str)


# ---------------------------------------------------------------- 5 and 10


def test_substring(docs, empty):
    rows = corpus()
    first = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    for options in ({"block_bytes": 300}, {}, {"block_bytes": 300, "messages": 1}):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeated_windows(docs, **options).collect()}
        assert got == want
    assert substring.remove_repeated_windows(empty).count() == 0
    same = docs.unionByName(docs.where("doc_id = 13"))
    assert {r.n_removed for r in substring.remove_repeated_windows(same).where("doc_id = 13").collect()} == {0}


def _bytes_kept(rows, length):
    first, want = {}, {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], (i, k))
    for i, t, _ in rows:
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (i, k):
                gone.update(range(k, k + length))
        want[i] = (len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in gone)).hexdigest())
    return want


@pytest.mark.parametrize("options", [{}, {"block_bytes": 500}, {"block_bytes": 500, "messages": 1}, {"stride": 20}, {"length": 40, "gram": 10, "stride": 8, "block_bytes": 700}])
def test_suffixes(docs, empty, options):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeated_strings(docs, **options).collect()}
    assert got == _bytes_kept(corpus(), options.get("length", 100))
    assert suffixes.remove_repeated_strings(empty).count() == 0


def test_a_text_over_16_mb(spark):
    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert (suffixes.anchors_at(hashes, 77, 300) == suffixes.anchors_at(hashes, 77)).all()
    text = rng.integers(97, 123, 17_000_000, dtype=np.uint8).tobytes().decode()
    rows = [(1, text), (2, "x" * 5 + text[-300:]), (3, text[16_777_100:16_777_400])]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (17_000_000, 0), 2: (305, 300), 3: (300, 300)}


# ---------------------------------------------------------------- 6


def test_html():
    page = "<title>T</title><body><h1>Hi &amp; ho</h1>a <b>bold</b> x<p>one<p>two<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul><table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>z<td>22</table><pre> keep\n  this</pre><div hidden>no</div><span style='display:none'>no</span>end<br>line 1 < 2"
    assert html.render(page) == "Hi & ho\n\na bold x\n\none\n\ntwo\n\n- a\n- b\n\n  1. x\n  2. y\n- c\n\nName      | N\nlong name | 1\nz         | 22\n\n keep\n  this\n\nend\nline 1 < 2"
    assert html.render(None) is None and html.render("") == "" and html.render("<<>&amp;<") == "<<>&<"
    assert html.render("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    assert html.render("<script>var x = '<p>no</p>';</script>yes<style>p{}") == "yes"


def test_html_costs_grow_with_the_page():
    import time

    began = time.process_time()
    assert html.render("<div>" * 60000 + "x") == "x" and html.render("<p><table><td>" + "<div>" * 30000 + "y").endswith("y")
    assert html.render("a" + "<!x" * 60000) == "a" and html.render("<b>" * 30000 + "</i>" * 30000 + "z") == "z"
    assert time.process_time() - began < 30
    wide = "<table>" + f"<tr><td>{'w' * 5000}<td>n" + "<tr><td>a<td>b" * 2000 + "<tr><td>long<td>c</table>"
    out = html.render(wide)
    assert len(out) < 60_000 and "w" * 5000 + " | n" in out and "a    | b" in out


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a"), (2, None, None), (1, "u", "<p>a")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html.extract(df).where("text is not null").collect()) == [(1, "a", 1), (1, "a", 1)]
    assert html.extract(df).count() == 3 and html.extract(df.limit(0)).count() == 0


def test_head_without_its_end():
    assert html.render("<head><title>T</title><p>Hello") == "Hello"
    assert html.render("<html><head> <meta charset=x><style>p{}</style>\n<script>1</script> Hi <b>you</b></head> there") == "Hi you there"
    assert html.render("<head><title>T</title><noscript><p>no</p></noscript><link href=x></head><body>yes") == "yes"
    assert html.render("<p>a <span aria-hidden=true>b</span>") == "a b"


# ---------------------------------------------------------------- 7


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in corpus()}
    assert {r.doc_id: r.size for r in rows} == sizes
    total, taken, target = Counter(), Counter(), {}
    for r in rows:
        total[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, open_, rest = {}, set(order), sum(total.values())
    while True:  # caps found one after the other
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * total[s]
            rest -= 3 * total[s]
        open_ -= over
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - math.floor(want[s] + 1e-9)) <= 1
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, rows))
    assert mixing.mix(empty).count() == 0


# ---------------------------------------------------------------- 8


def test_lm(docs, empty):
    rows = corpus()
    token = lambda t: [*WORD.findall((t or "").translate(LOWER)), 0]
    one, two, three = Counter(), Counter(), Counter()
    for i, t, _ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            padded = [1, 1, *token(t)]
            one.update(padded[2:])
            two.update(zip(padded[1:], padded[2:]))
            three.update(zip(padded, padded[1:], padded[2:]))
    n, v = sum(one.values()), len(one)
    state = Counter()  # histories, by what follows them
    for gram, c in (two + three).items():
        state[gram[:-1]] += c
    for options in ({"block_bytes": 600}, {"block_bytes": 600, "messages": 1}):
        for r in lm.score(docs, **options).collect():
            t = token(dict((i, t) for i, t, _ in rows)[r.doc_id])
            base = walk = 0.0
            history = (1, 1)
            for w in t:
                root = (one[w] + 1) / (n + v + 1)
                base += math.log10(root)
                pair = (two[history[1], w] + 4 * root) / (state[history[1:]] + 4)
                here = history
                while here and not (three if len(here) == 2 else two)[(*here, w)]:  # the automaton, arc by arc
                    walk += math.log10(4 / (state[here] + 4))
                    here = here[1:]
                walk += math.log10((three[(*here, w)] + 4 * pair) / (state[here] + 4) if len(here) == 2 else pair if here else root)
                history = (history[1], w)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(t), sum(one[w] > 0 for w in t), n)
            assert r.base_score == pytest.approx(base) and r.score == pytest.approx(walk)
    assert lm.score(empty).count() == 0


# ---------------------------------------------------------------- 9


def test_pii(spark, empty):
    texts = ["a@b.c_x@d.e 1.2.3.4.5.6.7.8 +1 (234) 555-1234. GB82 WEST 1234 5698 7654 32 end é4111 1111-11111111 x 4111111111111112 999.1.1.1 0001.02.3.255", None, "", "@a.b +12345678 a@b.c.d@e.f", "5555 5555 5555 4444 4111111111111111", "1 " * 9000 + "a" * 20000 + "@x.y", "12.3.4.5.6"]
    df = spark.createDataFrame([(k, t, "k") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda s: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0
    patterns = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))), "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)}
    for r in pii.digest(df).collect():
        t = texts[r.doc_id] or ""
        if len(t) > 20000:
            assert r.n_email == 1
            continue
        spans = [f"{kind}:{m.start()}:{m.end()}" for kind, (p, fine) in patterns.items() for m in re.finditer(p, t) if fine(m.group())]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in spans) for k in patterns)
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(r.spans.split(",")) | {""}
    assert "iban:47:74" in pii.digest(df).where("doc_id = 0").first().spans
    hidden = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert hidden[0].startswith("[EMAIL][EMAIL] [IP].[IP] [PHONE]. [IBAN] end é") and hidden[1] is None and hidden[3] == "@a.b [PHONE] [EMAIL]@e.f"
    assert pii.digest(empty).count() == 0


def test_context_decides(spark):
    texts = ["my SSN is 123-45-6789", "part 123-45-6789 of the list", "social security: 000-45-6789 and 123-00-6789", "write to a.b@c.de", "a.b@c.de", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.scores) for r in pii.digest(df).collect()}
    assert got == {0: ("ssn:10:21", "0.70"), 1: ("", ""), 2: ("", ""), 3: ("email:9:17", "1.00"), 4: ("email:0:8", "0.70"), 5: ("", "")}


def test_hiding_keeps_every_column(spark):
    df = spark.createDataFrame([("a@b.cd", 1, "s", "b", "r", "n"), (None, 2, "s", "b", "r", "n")], "text string, doc_id long, spans string, _body string, _row string, none string")
    got = pii.redact(df.unionByName(df))
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([("[EMAIL]", 1, "s", "b", "r", "n"), (None, 2, "s", "b", "r", "n")] * 2, key=str)
    assert pii.find(df).columns == ["text", "doc_id", "_body", "_row", "none", "spans"]


def test_iban_before_capitals_and_digits(spark):
    texts = ["IBAN DE89370400440532013000 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00 Please", "DE89 3704 0044 0532 0130 00 2024", "GB82WEST12345698765432 FR14 2004 1010 0505 0001 3M02 606 X", "NO9386011117947, DE89370400440532013001"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in sorted(pii.redact(df).collect())]
    assert got[:4] == ["IBAN [IBAN] BIC COBADEFFXXX", "[IBAN] Please", "[IBAN] 2024", "[IBAN] [IBAN] X"]
    assert got[4].startswith("[IBAN], DE89")


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    good = lambda n=60: " ".join(rnd.choice(["the", "of", "river", "stone", "in", "a", "house", "and", "lamp", "was"]) + rnd.choice(["", "", "ing", "er", "s"]) for _ in range(n)) + "."
    item = good(25)
    rows = [(k, good(), "en", f"s{k % 3}", 0) for k in range(200)] + [(200 + k, "word " * 70, "en", "s0", 0) for k in range(30)]
    rows += [(300, rows[5][1], "en", "s1", 0), (301, good(20) + " " + item + " " + good(20), "en", "s1", 0), (302, good() + " mail a.b@c.de", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert not set(range(200, 230)) & set(seen[0]) and len(seen[0]) >= 195
    assert 300 in seen[0] and 300 not in seen[1] and 301 in seen[1] and 301 not in seen[2]
    assert seen[3][302].endswith("mail [EMAIL]")
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert mixed and all(r.taken > 0 for r in mixed) and {r.doc_id for r in mixed} <= set(seen[3])


def test_decontamination_in_capitals(spark):
    item = "La. Éai éonleeau pour an éonqueê aivi ai, éenaitreoiaux éoiré anvitre èenreré èéèquepaè ñle straße"
    docs = spark.createDataFrame([(1, "Un début! " + item.upper().replace("STRASSE", "STRAßE") + "!! FIN"), (2, None), (3, "rien de pareil ici"), (4, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(1, 7, 0), (4, 7, 0)}
