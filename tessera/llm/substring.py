"""Removal of word passages that an earlier document has: count-min prefilter, then exact groups.

Round one: each block of documents makes a count-min sketch of its windows, ROWS rows of 2**bits counters of which only
those in use are sent, and the ranges merge the sketches by adding.  A merged counter is never below the number of
documents with a window, nor is the least of its ROWS counters, the estimate; so a window whose estimate stays under
two occurs in one document only and is dropped.  Round two groups what is left by 96 bits of window hash and finds
each window's smallest document.  No window that repeats is lost; the sketch only saves traffic.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as bl
from . import textbytes as tb

WINDOW = 13
#: Rows of the sketch, and the counters of a row for each window of the corpus, as a power of two.
ROWS, SPARE_BITS = 2, 5


def sketch_bits(windows: float) -> int:
    return min(62, max(16, math.ceil(math.log2(max(windows, 1))) + SPARE_BITS))


class _Sketch:
    """One row of a block's sketch: the counters in use, each with one or more documents."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, row: int, bits: int):
        cell = tb.mix64(keys ^ np.uint64(row * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits)
        order = np.argsort(cell, kind="stable")
        new = bl.groups(cell[order])
        first = np.flatnonzero(new)
        self.cells = cell[order][first]
        self.cell_of = np.empty(len(cell), np.int64)
        self.cell_of[order] = np.cumsum(new) - 1
        docs = ids[order]
        low, high = (np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)) if len(first) else (docs, docs)
        self.many = low != high


class _Windows:
    """Words, windows and sketch of one block."""

    def __init__(self, table: pa.Table, window: int, bits: int):
        data, offsets = tb.column_bytes(table["text"])
        self.starts, self.ends, self.bounds = tb.word_bounds(data, offsets)
        self.data = data
        self.at = tb.window_starts(self.bounds, window)
        self.key = tb.window_hashes(tb.word_hashes(data, self.starts, self.ends, 0), self.at, window, 0)
        self.ids = bl.ids(table)[np.searchsorted(self.bounds, self.at, "right") - 1]
        self.rows = [_Sketch(self.key, self.ids, row, bits) for row in range(ROWS)]


def _bits(buf: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.unpackbits(np.frombuffer(buf, np.uint8, (n + 7) // 8, at), count=n).astype(bool)


def _sketch_payloads(rows: list[_Sketch], ranges: int, bits: int) -> list[bytes]:
    """Of each row the counters of each range, one row after the other."""
    cuts = [bl.range_cuts(row.cells, ranges, bits) for row in rows]
    return [b"".join(bl.pack_sorted(row.cells[c[r] : c[r + 1]]) + np.packbits(row.many[c[r] : c[r + 1]]).tobytes() for row, c in zip(rows, cuts, strict=True)) for r in range(ranges)]


def _merge_sketches(payloads: list[bytes]) -> list[bytes]:
    """For each payload and row which counters are two or more, all blocks' added up."""
    out, at = [b""] * len(payloads), [0] * len(payloads)
    for _ in range(ROWS):
        cells, weight = [], []
        for i, p in enumerate(payloads):
            keys, to = bl.unpack_sorted(p, at[i])
            cells.append(keys)
            weight.append(1 + _bits(p, len(keys), to).astype(np.int64))
            at[i] = to + (len(keys) + 7) // 8
        flat = np.concatenate(cells)
        order = np.argsort(flat, kind="stable")
        new = bl.groups(flat[order])
        group = np.cumsum(new) - 1
        count = np.bincount(group, weights=np.concatenate(weight)[order]) if len(group) else np.zeros(0)
        repeated = np.empty(len(order), bool)
        repeated[order] = count[group] >= 2
        out = [o + np.packbits(x).tobytes() for o, x in zip(out, bl.split_back(repeated, [len(c) for c in cells]), strict=True)]
    return out


def _estimated_repeated(rows: list[_Sketch], answers: list[bytes], ranges: int, bits: int) -> np.ndarray:
    """Which windows have no counter under two."""
    found, at = None, [0] * ranges
    for row in rows:
        cuts = bl.range_cuts(row.cells, ranges, bits)
        sizes = np.diff(cuts).tolist()
        row_bits = np.concatenate([np.zeros(0, bool), *(_bits(a, n, t) for a, n, t in zip(answers, sizes, at, strict=True))])
        at = [t + (n + 7) // 8 for t, n in zip(at, sizes, strict=True)]
        here = row_bits[row.cell_of]
        found = here if found is None else found & here
    return found


def _group_exactly(payloads: list[bytes]) -> list[bytes]:
    """The places of the windows that a smaller document has, of each payload."""
    high, low, doc, place, known = [], [], [], [], []
    for p in payloads:
        keys, at = bl.unpack_sorted(p)
        n = len(keys)
        high.append(keys)
        low.append(np.frombuffer(p, "<u4", n, at))
        ids, at = bl.unpack_values(p, n, at + 4 * n)
        spots, at = bl.unpack_values(p, n, at)
        doc.append(ids)
        place.append(spots)
        known.append(p[at:])
    h, lo, d = np.concatenate(high), np.concatenate(low), np.concatenate(doc)
    order = np.lexsort((d, lo, h))
    new = bl.groups(h[order], lo[order])
    first = d[order][np.flatnonzero(new)]
    earlier = np.empty(len(order), bool)
    earlier[order] = first[np.cumsum(new) - 1] < d[order] if len(order) else False
    return [bl.pack_places(spots[gone]) + more for spots, gone, more in zip(place, bl.split_back(earlier, [len(x) for x in high]), known, strict=True)]


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = bl.BLOCK_BYTES, keep_text: bool = False, messages: int = bl.MESSAGES) -> DataFrame:
    """Remove each word covered by a window whose words also start a window of a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 (and kept_text).  A null text has no words; a null id
    counts as larger than every other; rows with the same id never remove each other's words.
    Two different windows of equal 96-bit hash would count as one (odds under 1e-12 for 1e8 windows).
    """
    count = bl.block_count(docs, text_col, block_bytes)
    plan = bl.Plan(count, max(1, math.ceil(count / 3)), messages)
    bits = sketch_bits(count * block_bytes / 6)
    split = bl.with_block(docs, id_col, text_col, count)

    def sketch(table, _):
        return _sketch_payloads(_Windows(table, window, bits).rows, plan.ranges, bits)

    def exact(table, answers):
        w = _Windows(table, window, bits)
        cand = np.flatnonzero(_estimated_repeated(w.rows, answers, plan.ranges, bits))
        high, doc, at = w.key[cand], w.ids[cand], w.at[cand]
        low = (tb.window_hashes(tb.word_hashes(w.data, w.starts, w.ends, 1), at, window, 1) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((doc, low, high))
        high, low, doc, at = high[order], low[order], doc[order], at[order]
        new = bl.groups(high, low)
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else doc
        behind = doc > least  # a smaller document of the same block has the window; the others ask
        cuts, late = bl.range_cuts(high[~behind], plan.ranges), bl.range_cuts(high[behind], plan.ranges)
        high, low, doc, mine, known = high[~behind], low[~behind], doc[~behind], at[~behind], at[behind]
        for r in range(plan.ranges):
            part = slice(cuts[r], cuts[r + 1])
            # what is known, and the places asked about, come back: the last step needs no hashes
            yield bl.pack_sorted(high[part]) + low[part].astype("<u4").tobytes() + bl.pack_values(doc[part]) + bl.pack_values(mine[part]) + bl.pack_places(known[late[r] : late[r + 1]])

    def result(table, answers):
        data, offsets = tb.column_bytes(table["text"])
        starts, ends, bounds = tb.word_bounds(data, offsets)
        at = np.concatenate([np.zeros(0, np.int64), *(x for a in answers for x in bl.unpack_places(a))])
        kept = ~tb.ranges_to_mask(len(starts), at, at + window)
        kept_before = np.concatenate([[0], np.cumsum(kept)])
        n_words = np.diff(bounds)
        n_kept = np.diff(kept_before[bounds])
        text, _, text_ends = tb.joined_words(data, starts[kept], ends[kept])
        text_ends = np.concatenate([[0], text_ends + 1])
        raw, hashes, texts = text.tobytes(), [], []
        for a, b in zip(kept_before[bounds[:-1]], kept_before[bounds[1:]], strict=True):
            piece = raw[text_ends[a] : text_ends[b] - 1] if b > a else b""
            hashes.append(hashlib.sha256(piece).hexdigest())
            if keep_text:
                texts.append(piece.decode())
        out = {"doc_id": bl.id_array(bl.ids(table)), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_words - n_kept, pa.int64()), "kept_sha256": pa.array(hashes, pa.string())}
        if keep_text:
            out["kept_text"] = pa.array(texts, pa.string())
        return pa.table(out)

    first = bl.exchange(split, plan, sketch, _merge_sketches)
    second = bl.exchange(split, plan, exact, _group_exactly, first)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return bl.finish(split, plan, second, result, schema)
