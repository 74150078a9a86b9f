"""Language-model scoring with a weighted backoff automaton over words, pairs and triples.

States are the histories of at most ORDER - 1 tokens that training has.  A state h has an arc for each token w that
follows it in training, of probability (c(h, w) + mu * p(w | h')) / (c(h) + mu), and a failure arc of weight
mu / (c(h) + mu) to the state h', which is h without its oldest token.  The arcs of the root are the smoothed single
words p(w) = (c(w) + 1) / (N + V + 1).  Taking the arc of w leads to the longest end of h w that is a state.

All words, pairs and triples of all training documents are in the model, which is spread over ranges of their keys.  A
block of documents fetches the counts that its path may meet, and walks all its texts left to right: the state goes
along, a missing arc costs the failure weight and is tried again from the shorter state.  The state after a token
depends on the last ORDER - 1 tokens alone, so the states and arcs of all places are found at once.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as bl
from . import textbytes as tb

ORDER = 3
#: Bits of the keys of words, and of the keys of longer n-grams beyond those that number them.
WORD_BITS, SPARE_BITS = 62, 18
_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MULTIPLIERS = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def key_bits(tokens: float) -> int:
    return min(WORD_BITS, max(32, math.ceil(math.log2(max(tokens, 1) * (ORDER - 1))) + SPARE_BITS))


class _Keys:
    """Distinct keys, which of them each n-gram has, and how often training texts of the block have them."""

    def __init__(self, flat: np.ndarray, learn: np.ndarray, bits: int):
        flat = flat >> np.uint64(64 - bits)
        order = tb.stable_order(flat)
        new = bl.groups(flat[order])
        head = np.flatnonzero(new)
        self.bits, self.keys = bits, flat[order][head]
        self.place = np.empty(len(flat), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.learnt = np.add.reduceat(learn[order], head, dtype=np.int64) if len(head) else np.zeros(0, np.int64)

    def cuts(self, ranges: int) -> np.ndarray:
        return bl.range_cuts(self.keys, ranges, self.bits)

    def payload(self, part: slice) -> bytes:
        return bl.pack_sorted(self.keys[part]) + bl.pack_counts(self.learnt[part])


class _Tokens:
    """The tokens of a block, the keys of its words and of the longer n-grams that end at each token."""

    def __init__(self, table: pa.Table, folds: int, held: int, bits: int):
        data, offsets = tb.column_bytes(table["text"])
        starts, ends, bounds = tb.word_bounds(data, offsets)
        words = tb.word_hashes(tb.LOWER[data], starts, ends, 0)
        self.ids = bl.ids(table)
        n = len(self.ids)
        self.held = np.array([zlib.crc32(b"" if i == bl.NO_ID else str(i).encode()) % folds == held for i in self.ids.tolist()], bool)
        token = np.empty(len(words) + n, np.uint64)
        doc = np.searchsorted(bounds, np.arange(len(words)), "right") - 1
        token[np.arange(len(words)) + doc] = words
        self.last, self.first = bounds[1:] + np.arange(n), bounds[:-1] + np.arange(n)
        token[self.last] = _END
        self.count = np.diff(np.append(self.first, len(token)))
        history, grams = token, []
        for k in range(1, ORDER):
            before = np.empty_like(token)
            before[k:] = token[:-k]
            for j in range(k):  # a text begins after the start
                before[(self.first + j)[j < self.count]] = _START
            history = tb.mix64(history * _MULTIPLIERS[0] + before * _MULTIPLIERS[1] + np.uint64(k))
            grams.append(history)
        learn = np.repeat(~self.held, self.count)
        self.words = _Keys(tb.mix64(token), learn, WORD_BITS)
        self.longer = _Keys(np.concatenate(grams), np.tile(learn, ORDER - 1), bits)

    def counts(self, words: np.ndarray, longer: np.ndarray) -> list[np.ndarray]:
        """For each order how often training has the n-gram that ends at each token, given the counts of the keys."""
        return [words[self.words.place], *longer[self.longer.place].reshape(ORDER - 1, -1)]

    def histories(self, counts: list[np.ndarray]) -> list[np.ndarray]:
        """For orders from 2 how often training has the history of each token: the n-gram that ends one token earlier.
        Before a text's first token it is the start, which is there as often as the end."""
        out = []
        for seen in counts[:-1]:
            state = np.empty_like(seen)
            state[1:] = seen[:-1]
            state[self.first] = counts[0][self.last]
            out.append(state)
        return out


def _add(payloads: list[bytes]) -> list[bytes]:
    """For each payload the number of words and of their occurrences in the range, and its keys' counts, all blocks' added up."""
    out, at, head = [b""] * len(payloads), [0] * len(payloads), b""
    for kind in range(2):
        keys, counts = [], []
        for i, p in enumerate(payloads):
            k, to = bl.unpack_sorted(p, at[i])
            c, at[i] = bl.unpack_counts(p, len(k), to)
            keys.append(k)
            counts.append(c)
        flat = np.concatenate(keys)
        order = tb.stable_order(flat)
        new = bl.groups(flat[order])
        begin = np.flatnonzero(new)
        total = np.add.reduceat(np.concatenate(counts)[order], begin) if len(begin) else np.zeros(0, np.int64)
        if kind == 0:
            head = struct.pack("<QQ", int((total > 0).sum()), int(total.sum()))
        found = np.empty(len(order), np.int64)
        found[order] = total[np.cumsum(new) - 1] if len(begin) else 0
        out = [o + bl.pack_counts(x) for o, x in zip(out, bl.split_back(found, [len(k) for k in keys]), strict=True)]
    return [head + o for o in out]


def walk(arcs: list[np.ndarray], states: list[np.ndarray], root: np.ndarray, mu: float) -> np.ndarray:
    """log10 of what each token costs.  arcs[k] and states[k]: how often the n-gram of k + 2 tokens that ends here, and
    its history, were seen in training."""
    weights = [root]  # of the arc of the token out of the state of each length, by interpolation with the shorter one
    for arc, state in zip(arcs, states, strict=True):
        weights.append((arc + mu * weights[-1]) / (state + mu))
    cost = np.zeros(len(root))
    left = np.ones(len(root), bool)
    for arc, state, weight in list(zip(arcs, states, weights[1:], strict=True))[::-1]:
        take = left & (arc > 0)
        cost[take] += np.log10(weight[take])
        left &= ~take
        fail = left & (state > 0)  # a history that was not seen is no state: the walk is in a shorter one already
        cost[fail] += np.log10(mu / (state[fail] + mu))
    cost[left] += np.log10(root[left])
    return cost


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, mu: float = 4.0, block_bytes: int = bl.BLOCK_BYTES, messages: int = bl.MESSAGES) -> DataFrame:
    """Scores of every text under the model of the documents whose crc32(id) mod folds is not `held`.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (single words, add one) and score, both
    log10.  Null texts are empty: one token, the end.  A null id has the empty text as its name.  Rows of one id are
    texts of their own.  Words are told apart by hashes of 62 bits, longer n-grams by SPARE_BITS bits more than number them.
    """
    count = bl.block_count(docs, text_col, block_bytes)
    plan = bl.Plan(count, max(1, math.ceil(count / 3)), messages)
    bits = key_bits(count * block_bytes / 5)
    split = bl.with_block(docs, id_col, text_col, count)

    def ask(table, _):
        t = _Tokens(table, folds, held, bits)
        words, longer = t.words.cuts(plan.ranges), t.longer.cuts(plan.ranges)
        for r in range(plan.ranges):
            yield t.words.payload(slice(words[r], words[r + 1])) + t.longer.payload(slice(longer[r], longer[r + 1]))

    def result(table, answers):
        t = _Tokens(table, folds, held, bits)
        types = tokens = 0
        kinds = (t.words, t.longer)
        found = [np.zeros(len(k.keys), np.int64) for k in kinds]
        cuts = [k.cuts(plan.ranges) for k in kinds]
        for r, a in enumerate(answers):
            v, n = struct.unpack_from("<QQ", a)
            types, tokens, at = types + v, tokens + n, 16
            for values, cut in zip(found, cuts, strict=True):
                values[cut[r] : cut[r + 1]], at = bl.unpack_counts(a, int(cut[r + 1] - cut[r]), at)
        counts = t.counts(*found)
        known = counts[0]
        root = (known + 1) / (tokens + types + 1)
        cost = walk(counts[1:], t.histories(counts), root, mu)
        total = lambda x: np.add.reduceat(x, t.first) if len(t.first) else x[:0]
        return pa.table(
            {
                "doc_id": bl.id_array(t.ids),
                "held_out": pa.array(t.held, pa.bool_()),
                "n_tokens": pa.array(t.count, pa.int64()),
                "n_known": pa.array(total((known > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(t.ids), tokens), pa.int64()),
                "base_score": pa.array(total(np.log10(root)), pa.float64()),
                "score": pa.array(total(cost), pa.float64()),
            }
        )

    answers = bl.exchange(split, plan, ask, _add)
    return bl.finish(split, plan, answers, result, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
