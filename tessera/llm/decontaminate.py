"""Benchmark passages in documents: item-sized windows, filtered without loss, ordered by CGK embedding, verified exactly.

Words are compared: lower-case letters of any script, ASCII punctuation as space.  An item of n words is found where a
window of n words has a word edit distance of at most k = floor(share * n) from it.

1. Filter without loss: k edits leave one of k + 1 stretches of the item untouched, so a match shares a run of
   ceil((n - k) / (k + 1)) words with the item (at most GRAM are used).  Documents are scanned for these grams;
   a shared gram fixes the window's start up to k words either way.
2. Bound without loss: a window's distance is at least its length (or the item's, if greater) less the number of its
   words that the item has.  Windows whose bound is beyond k are dropped.
3. The others and the items are embedded by the walk of Chakraborty, Goldenberg and Koucky (STOC 2016): at step j copy
   the current word, and move on by a random bit of (j, word).  Sampled positions of the embedding are hash keys.  Edit
   distance k becomes a Hamming distance of order k to k squared, so the keys of long items at the full distance
   seldom collide.  Therefore they only give the order: windows that collide are verified first.
4. Windows are verified by exact edit distance (Myers's bit vectors), but for those whose bound is no better than what
   the item's best window in the text has.  So no match is lost, whatever the length of the item.

The items reach the tasks in slices of a fixed number of bytes, one pass over the documents for each slice.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from . import textbytes as tb

SHARE, GRAM, RECALL = 0.2, 4, 0.99
SLICE_BYTES = 8 << 20
_BREAK = tb.SPACE.copy()
_BREAK[[c for c in range(128) if not chr(c).isalnum()]] = True
#: Sampled positions in a key, and the share of positions that differ for a pair that is to be verified early.
_SAMPLE, _FAR = 4, 0.35
#: Cells of a matrix of words, and diagonals, that are held at once.
_CELLS = 1 << 19


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column and each row's bounds among them."""
    data, offsets = tb.column_bytes(pc.utf8_lower(column))
    data = np.where(_BREAK[data], np.uint8(32), data)
    starts, ends, bounds = tb.word_bounds(data, offsets)
    return tb.word_hashes(data, starts, ends), bounds


def allowed(n: int, share: float) -> int:
    return math.floor(share * n + 1e-9)


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Levenshtein distance if it is at most `most`, else most + 1; a row of the table is a pair of bit vectors."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not b:
        return len(a)
    where: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        where[x] |= 1 << j
    full, top, distance = (1 << len(b)) - 1, 1 << len(b) - 1, len(b)
    up, down = full, 0
    for x in a:
        same = where.get(x, 0)
        across = ((same & up) + up ^ up) | same
        right, left = down | ~(across | up) & full, up & across
        if right & top:
            distance += 1
        elif left & top:
            distance -= 1
        right, left = (right << 1 | 1) & full, left << 1 & full
        either = same | down
        up, down = left | ~(either | right) & full, right & either
    return min(distance, most + 1)


def embed(words: np.ndarray, lengths: np.ndarray, walk: int, places: np.ndarray) -> np.ndarray:
    """Chosen places of the CGK embedding of windows (rows of word hashes, zero padded) along one random walk."""
    m, n = words.shape
    padded = np.concatenate([words, np.zeros((m, 1), np.uint64)], axis=1).ravel()
    base, at = np.arange(m) * (n + 1), np.zeros(m, np.int64)
    out = np.zeros(places.shape, np.uint64)
    for j in range(int(places.max(initial=-1)) + 1):
        here = padded[base + np.minimum(at, lengths)]
        chosen = places == j
        if chosen.any():
            out = np.where(chosen, here[:, None], out)
        salt = np.uint64((walk * 0x9E3779B97F4A7C15 + j * 0xC2B2AE3D27D4EB4F + 1) % (1 << 64))
        at += (tb.mix64(here ^ salt) >> np.uint64(63)).astype(np.int64)
    return out


class Matcher:
    """Grams, lengths and LSH keys of a slice of the benchmark; built once, on the driver."""

    def __init__(self, item_ids: list, texts: list[str], share: float = SHARE, recall: float = RECALL, seed: int = 5):
        hashes, bounds = _words(pa.array(texts, pa.string()))
        items = [(i, hashes[a:b]) for i, a, b in zip(item_ids, bounds[:-1], bounds[1:], strict=True) if b > a]
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        self.kinds = [np.unique(w) for w in self.words]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.slack = np.array([allowed(n, share) for n in self.lengths.tolist()], np.int64)
        self.tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - _FAR) ** _SAMPLE))
        self.draws = np.random.Generator(np.random.PCG64(seed)).random((self.tables, _SAMPLE))
        places: dict[int, list] = defaultdict(list)  # by gram length: (grams, item, offsets)
        for k, words in enumerate(self.words):
            n, slack = len(words), int(self.slack[k])
            q = min(GRAM, math.ceil((n - slack) / (slack + 1)))
            found = tb.window_hashes(words, np.arange(n - q + 1), q)
            places[q].append((found, np.full(len(found), k), np.arange(len(found))))
        self.grams = {}  # by gram length: grams, and for each a range of (item, offset)
        for q, parts in places.items():
            gram, item, offset = (np.concatenate(side) for side in zip(*parts, strict=True))
            order = np.argsort(gram, kind="stable")
            head = np.flatnonzero(bl.groups(gram[order]))
            self.grams[q] = gram[order][head], np.append(head, len(order)), item[order], offset[order]
        self.keys = np.zeros((len(items), self.tables), np.uint64)
        by_length = np.argsort(self.lengths, kind="stable")
        at = 0
        while at < len(items):  # items of like lengths, so that the matrix is of their words
            to = at + 1
            while to < len(items) and (to + 1 - at) * int(self.lengths[by_length[to]]) <= _CELLS:
                to += 1
            some = by_length[at:to]
            matrix = np.zeros((len(some), int(self.lengths[some[-1]])), np.uint64)
            for row, k in enumerate(some.tolist()):
                matrix[row, : self.lengths[k]] = self.words[k]
            self.keys[some] = self._lsh(matrix, self.lengths[some], self.lengths[some])
            at = to

    def _lsh(self, windows: np.ndarray, have: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A key for each window and table: sampled places of the first 2n steps, which read n words on average."""
        out = np.empty((len(windows), self.tables), np.uint64)
        for t in range(self.tables):
            places = (self.draws[t][None, :] * 2 * lengths[:, None]).astype(np.int64)
            walk = embed(windows, have, t, places)
            key = np.full(len(windows), t, np.uint64)
            for j in range(_SAMPLE):
                key = tb.mix64(key * np.uint64(31) + walk[:, j])
            out[:, t] = key
        return out

    def _candidates(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, first word) of the item-sized windows around shared grams."""
        found = [np.zeros((0, 3), np.int64)]
        for q, (grams, bound, of_item, offsets) in self.grams.items():
            seen = np.zeros(1 << 20, bool)
            seen[grams >> np.uint64(44)] = True
            at = tb.window_starts(bounds, q)
            hashes = tb.window_hashes(words, at, q)
            hit = np.flatnonzero(seen[hashes >> np.uint64(44)])
            place = np.minimum(np.searchsorted(grams, hashes[hit]), len(grams) - 1)
            hit, place = hit[grams[place] == hashes[hit]], place[grams[place] == hashes[hit]]
            many = bound[place + 1] - bound[place]
            # a gram of many items is many diagonals: so many at a time
            cuts = np.unique(np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + 1, _CELLS // 4))).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(hit)], strict=True):
                some = many[lo:hi]
                entry = np.repeat(bound[place[lo:hi]] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))
                start = np.repeat(at[hit[lo:hi]], some) - offsets[entry]
                rows = np.repeat(np.searchsorted(bounds, at[hit[lo:hi]], "right") - 1, some)
                d = np.unique(np.stack([rows, of_item[entry], start], axis=1), axis=0)
                slack = self.slack[d[:, 1]]
                d = np.repeat(d, 2 * slack + 1, axis=0)
                shift = np.arange(len(d)) - np.repeat(np.cumsum(2 * slack + 1) - (2 * slack + 1), 2 * slack + 1) - np.repeat(slack, 2 * slack + 1)
                d[:, 2] += shift
                found.append(np.unique(d[(d[:, 2] >= bounds[d[:, 0]]) & (d[:, 2] < bounds[d[:, 0] + 1])], axis=0))
        every = np.unique(np.concatenate(found), axis=0)
        return every[:, 0], every[:, 1], every[:, 2]

    def _bounds(self, words: np.ndarray, rows: np.ndarray, items: np.ndarray, at: np.ndarray, have: np.ndarray) -> np.ndarray:
        """For each window a distance from its item that it cannot be below.  Windows come by row and item."""
        out = np.empty(len(rows), np.int64)
        cuts = [*np.flatnonzero(bl.groups(rows, items)).tolist(), len(rows)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = self.kinds[items[a]]
            begin, ends = int(at[a]), at[a:b] + have[a:b]
            part = words[begin : int(ends.max())]
            before = np.concatenate([[0], np.cumsum(own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part)])
            out[a:b] = self.lengths[items[a]] - (before[ends - begin] - before[at[a:b] - begin])  # no window is longer
        return out

    def _collide(self, words: np.ndarray, items: np.ndarray, at: np.ndarray, have: np.ndarray) -> np.ndarray:
        """Which windows share a key with their item."""
        out = np.zeros(len(items), bool)
        order = np.argsort(have, kind="stable")
        k = 0
        while k < len(items):
            step = max(1, _CELLS // max(1, int(have[order[min(len(items) - 1, k + 255)]])))
            some = order[k : k + min(step, 256)]
            item, start, size = items[some], at[some], have[some]
            wide = np.arange(int(size.max(initial=0)))
            matrix = np.where(wide < size[:, None], words[np.minimum(start[:, None] + wide, len(words) - 1)], np.uint64(0))
            out[some] = (self._lsh(matrix, size, self.lengths[item]) == self.keys[item]).any(axis=1)
            k += len(some)
        return out

    def find(self, column) -> list[tuple[int, object, int, int]]:
        """(row, item id, first word, distance) of the best window of each item in each text."""
        words, bounds = _words(column)
        rows, items, at = self._candidates(words, bounds)
        have = np.minimum(self.lengths[items], bounds[rows + 1] - at)
        least = self._bounds(words, rows, items, at, have)
        near = least <= self.slack[items]
        rows, items, at, have, least = rows[near], items[near], at[near], have[near], least[near]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        far = ~self._collide(words, items, at, have)
        order = np.lexsort((at, least, far))
        for r, i, s, h, low in zip(*(x[order].tolist() for x in (rows, items, at, have, least)), strict=True):
            if (r, i) in best and (low, s) >= best[r, i]:
                continue
            window, goal, most = words[s : s + h], self.words[i], int(self.slack[i])
            distance = 0 if np.array_equal(window, goal) else edit_distance(window.tolist(), goal.tolist(), most)
            if distance <= most and ((r, i) not in best or (distance, s) < best[r, i]):
                best[r, i] = (distance, s)
        return [(r, self.ids[i], s - int(bounds[r]), d) for (r, i), (d, s) in sorted(best.items())]


def _slices(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col)) + 16), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / SLICE_BYTES))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _matchers(benchmark: DataFrame, item_col: str, text_col: str, share: float) -> list[Matcher]:
    out = []
    for part in _slices(benchmark, item_col, text_col):  # each of about SLICE_BYTES
        rows = sorted((-1 if r["item_id"] is None else r["item_id"], r["text"]) for r in part.collect())
        out.append(Matcher([r[0] for r in rows], [r[1] for r in rows], share))
    return out


def _pieces(batch: pa.RecordBatch, text: str, rows: int = 512, most: int = 1 << 20):
    """The batch in pieces of some rows and about a megabyte of text; a longer text is a piece of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, first_word, distance): each item in each document that holds it, at its best window.

    Items or texts that are null or have no word match nothing; a document of equal text gives equal rows.
    """
    out = None
    for matcher in _matchers(benchmark, item_col, item_text, share):

        def scan(batches, matcher=matcher):
            for batch in batches:
                for piece in _pieces(batch, "text"):
                    found = matcher.find(piece.column("text"))
                    ids = piece.column("doc_id").to_pylist()
                    yield pa.record_batch({"doc_id": pa.array([ids[f[0]] for f in found], pa.int64()), "item_id": pa.array([f[1] for f in found], pa.int64()), "first_word": pa.array([f[2] for f in found], pa.int32()), "distance": pa.array([f[3] for f in found], pa.int32())})

        part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "doc_id long, item_id long, first_word int, distance int")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item."""
    for matcher in _matchers(benchmark, item_col, item_text, share):

        def scan(batches, matcher=matcher):
            for batch in batches:
                for piece in _pieces(batch, text_col):
                    keep = np.ones(piece.num_rows, bool)
                    keep[[f[0] for f in matcher.find(piece.column(text_col))]] = False
                    yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
