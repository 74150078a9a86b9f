"""Near copies of similarity 0.8 against brute force, and on odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import nearcopies, simhash


def edited(rnd, words, share):
    """The words with some of them, evenly spread, replaced."""
    out = list(words)
    step = max(1, round(1 / share))
    for k in range(rnd.randrange(step), len(out), step):
        out[k] = f"new{rnd.randrange(10**6)}"
    return out


def jaccard(a, b):
    cut = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    texts = []
    for _ in range(60):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(150, 500))]
        texts += [base, edited(rnd, base, 0.012), edited(rnd, base, 0.2)]
    return texts


def test_pairs_of_similarity_are_found(spark, rows):
    docs = spark.createDataFrame([(k, " ".join(w).upper() if k % 2 else "  ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    near = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a], rows[b]) >= 0.8]
    far = {a for a in range(len(rows)) if max(jaccard(rows[a], rows[b]) for b in range(len(rows)) if b != a) < 0.6}
    assert len(near) >= 50 and sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)
    assert len(far) >= 50 and all(got[a] == a for a in far) and all(c <= i for i, c in got.items())


def test_odd_rows(spark):
    long = " ".join(f"w{k % 9973}" for k in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "one", "x"), (5, "ONE", None), (6, "one two three", "x"), (7, long, "x"), (8, long + " end", "x"), (8, "other text", "x"), (None, "one", "x"), (9, "word " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print string").withColumn("node", F.lit(1)).withColumn("component_id", F.lit("c"))
    got = sorted((r.doc_id, r.component_id) for r in nearcopies.near_copies(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (8, 8), (9, 9)]
    kept = nearcopies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 6, 7, 9, None], key=str)
    assert nearcopies.one_of_each(docs.limit(0)).count() == 0


def test_margins_and_buckets():
    text = " ".join(f"v{k % 700}" for k in range(900))
    data, offsets = nearcopies.tb.column_bytes(nearcopies.pa.array([text, None, text[:200], text]))
    whole = nearcopies.margins(data, offsets, 5)
    alone = nearcopies.margins(*nearcopies.tb.column_bytes(nearcopies.pa.array([text[:200]])), 5)
    assert (whole[0] == whole[3]).all() and not whole[1].any() and (whole[2] == alone[0]).all()
    assert (abs(whole[0]) <= 896).all() and (whole[0] % 2 == 0).all() and abs(whole[0]).max() < 300
    rng = np.random.default_rng(3)
    chain = np.cumsum(rng.random((200, nearcopies.BITS)) < 0.05, axis=0) % 2
    prints = np.packbits(chain.astype(bool), axis=1).view(np.uint64)
    pairs = nearcopies.bucket_links(np.zeros(200, np.int64), np.arange(200), prints)
    assert len(pairs) == 199 and all(nearcopies._distance(prints[a], prints[b]) <= nearcopies.MAX_BITS for a, b in pairs)


@pytest.mark.parametrize("size", [9, 10, 11, 40, 47])
def test_hot_buckets_in_pieces_link_as_whole_ones(spark, size):
    rng = np.random.default_rng(size)
    steps = np.cumsum(rng.random((size, nearcopies.BITS)) < 0.12, axis=0) % 2  # neighbours in the chain are near, few others are
    prints = np.packbits(steps.astype(bool), axis=1)
    codes = np.zeros((size, nearcopies.TABLES * nearcopies.PAIRED, nearcopies.NEAREST), np.int16)
    codes[:, :, 1:] = [1, 2]
    codes[size // 2 :, 2:, 0] = 7  # some buckets hold all, others half
    order = rng.permutation(size)
    rows = [(int(order[k]), prints[k].tobytes(), codes[k].tobytes()) for k in range(size)]
    classes = spark.createDataFrame(rows, "node long, print binary, codes binary")

    def groups(links):
        root = list(range(size))
        for a, b in {(r.src, r.dst) for r in links.collect()}:
            assert nearcopies._distance(prints[list(order).index(a)], prints[list(order).index(b)]) <= nearcopies.MAX_BITS
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return {frozenset(k for k in range(size) if root[k] == r) for r in root}

    assert groups(nearcopies.links(classes, chunk=10)) == groups(nearcopies.links(classes))


def test_hot_ranges_of_fingerprints_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = lambda: sum(np.uint64(1) << np.uint64(b) for b in rng.choice(18, rng.integers(0, 5), replace=False) + 46) or np.uint64(0)
    prints = np.unique(np.array([c ^ flips() for c in centres for _ in range(150)] + rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist(), np.uint64))
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long").repartition(6)

    def groups(pairs):
        root = {int(p): int(p) for p in prints}
        for a, b in pairs:
            assert (a ^ b).bit_count() <= 3
            old, new = root[a], root[b]
            root = {p: new if r == old else r for p, r in root.items()}
        return {frozenset(p for p in root if root[p] == r) for r in root.values()}

    links = lambda **small: groups({(r.src % (1 << 64), r.dst % (1 << 64)) for r in simhash.links(table, len(prints), **small).collect()})
    every = groups([(int(a), int(b)) for a in prints for b in prints if a < b and (int(a) ^ int(b)).bit_count() <= 3])
    assert links() == every
    assert links(limit=500, large=20, chunk=32) == every


def test_groups_are_those_of_the_exact_similarity(spark):
    rnd = random.Random(31)
    texts = []
    for _ in range(60):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(150, 500))]
        texts.append(base)
        for changes in (0.8, 0.9, 1.0, 1.1, 1.2, 1.4):  # about as many shingles as make 0.8
            copy = list(base)
            for k in rnd.sample(range(5, len(base) - 5), round(changes * len(base) / 45)):
                copy[k] = f"new{rnd.randrange(10**6)}"
            texts.append(copy)
        texts.append(base[: len(base) * 5 // 6])
    line = [f"line{k}" for k in range(9)]
    for _ in range(2):  # unlike but for a line that is repeated
        texts.append(line * 60 + [f"o{rnd.randrange(10**6)}" for _ in range(80)])
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a - a % 8, a):
            if want[a] != want[b] and jaccard(texts[a], texts[b]) >= 0.8:
                low, high = sorted((want[a], want[b]))
                want = [low if w == high else w for w in want]
    alone = sum(w == k for k, w in enumerate(want))
    assert 100 < alone < 400
    joined = [(a, b) for a in range(len(texts)) for b in range(a) if got[a] == got[b]]
    assert all(want[a] == want[b] for a, b in joined)
    assert len(joined) >= 0.99 * sum(want[a] == want[b] for a in range(len(texts)) for b in range(a))
