"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document.  The votes are counted by pattern
(at most 3 to the number of labellers, whatever the corpus), and expectation-maximisation on these counts
(Dawid and Skene, 1979) estimates the accuracies of the labellers and the posterior of each pattern.  The
posteriors are the labels of a hashed linear scorer, fitted on a bounded sample of documents, which then scores
every document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

#: Documents the scorer is fitted on, at most, chosen by hash of the id.
SAMPLE = 6000
HASH_BITS = 11
#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = "the of and to in is that it for on with as was be by this are or an at from der die und den das von ist mit sich des ein eine nicht auf für le la les de des et un une du en que qui dans pour par sur el los las y se del con una su".split()
LABELLERS = ("signs", "capitals", "shouting", "repeats", "variety", "stop_words", "table_bars", "sentences")
#: For each labeller the bounds of a vote for bad and for good: bad beyond the first, good within the second.
#: A first bound above the second reads "high is bad", otherwise "low is bad".
BOUNDS = {"signs": (0.06, 0.01), "capitals": (0.5, 0.15), "shouting": (0.02, 0.002), "repeats": (0.2, 0.05), "variety": (0.25, 0.4), "stop_words": (0.01, 0.08), "table_bars": (0.1, 0.001), "sentences": (0.005, 0.02)}
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#$%&*+/<=>@\\^_`{|}~")] = True
_LEAST_WORDS = 8
_DIM = 1 << HASH_BITS
_COLUMNS = _DIM + 3 * len(LABELLERS) + 1


def _stop_hashes() -> np.ndarray:
    data, offsets = tb.column_bytes(pa.array(STOP_WORDS))
    starts, ends, _ = tb.word_bounds(data, offsets)
    return np.unique(tb.word_hashes(data, starts, ends))


_STOP = _stop_hashes()


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """What each labeller looks at, for each text, and the number of words."""
    lower = tb.LOWER[data]
    starts, ends, bounds = tb.word_bounds(data, offsets)
    words = tb.word_hashes(lower, starts, ends)
    n = np.diff(bounds)
    per_word, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    upper = (data >= 65) & (data <= 90)
    letters = np.maximum(_sums((lower >= 97) & (lower <= 122), offsets), 1)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    first = bounds[:-1][n > 0]
    same[first] = False
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    distinct = np.unique(doc << np.uint64(40) | words >> np.uint64(24)) >> np.uint64(40)
    kinds = np.bincount(distinct.astype(np.int64), minlength=len(n))
    length = np.maximum(ends - starts, 1)
    last = data[ends - 1] if len(ends) else data[:0]
    stops = _STOP[np.minimum(np.searchsorted(_STOP, words), len(_STOP) - 1)] == words
    bar = (length == 1) & (last == 124)
    found = {
        "signs": _sums(_SIGNS[data], offsets) / size,
        "capitals": _sums(upper, offsets) / letters,
        "shouting": _sums(data == 33, offsets) / size,
        "repeats": _sums(same, bounds) / per_word,
        # long texts repeat words by nature: compare with a vocabulary that grows as a power of the length
        "variety": kinds / per_word**0.85,
        "stop_words": _sums(stops, bounds) / per_word,
        "table_bars": _sums(bar, bounds) / per_word,
        "sentences": _sums((last == 46) | (last == 63), bounds) / per_word,
    }
    return found, n


def votes(found: dict[str, np.ndarray], n: np.ndarray) -> np.ndarray:
    """0 for nothing, 1 for bad, 2 for good; texts of a few words get no votes but on signs and capitals."""
    out = np.zeros((len(n), len(LABELLERS)), np.int64)
    for j, name in enumerate(LABELLERS):
        bad, good = BOUNDS[name]
        x = found[name]
        is_bad, is_good = (x > bad, x < good) if bad > good else (x < bad, x > good)
        out[:, j] = np.where(is_bad, 1, np.where(is_good, 2, 0))
        if name not in ("signs", "capitals"):
            out[n < _LEAST_WORDS, j] = 0
    few = out[:, LABELLERS.index("stop_words")]
    few[(n < 3 * _LEAST_WORDS) & (few == 1)] = 0
    out[n == 0] = 0
    return out


def _code(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


def _decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, table[labeller, class, vote], prior of good); class 1 is good."""
    good, bad = (patterns == 2).sum(1), (patterns == 1).sum(1)
    post = np.clip(0.5 + 0.15 * good - 0.35 * bad, 0.02, 0.98)
    for _ in range(rounds):
        prior = float((post * counts).sum() / max(counts.sum(), 1e-9))
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        table = np.empty((patterns.shape[1], 2, 3))
        for vote in (1, 2):
            is_vote = (patterns == vote).astype(float) * counts[:, None]
            table[:, 1, vote] = (is_vote * post[:, None]).sum(0) + 0.5
            table[:, 0, vote] = (is_vote * (1 - post)[:, None]).sum(0) + 0.5
        table[:, :, 1:] /= table[:, :, 1:].sum(2, keepdims=True)
        table[:, :, 0] = 1
        post = posterior(patterns, table, prior)
    return post, table, prior


def posterior(patterns: np.ndarray, table: np.ndarray, prior: float) -> np.ndarray:
    """Odds of good given the votes; a labeller that gives no vote says nothing."""
    log, j = np.log(table), np.arange(patterns.shape[1])
    odds = math.log(prior / (1 - prior)) + (log[j, 1, patterns] - log[j, 0, patterns]).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def features(data: np.ndarray, offsets: np.ndarray, vote: np.ndarray) -> np.ndarray:
    """Root frequencies of hashed byte triples, the votes and a constant: one row for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, _COLUMNS), np.float32)
    if len(data) > 2:
        b = data.astype(np.uint32)
        triple = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(32 - HASH_BITS)
        size = np.diff(offsets)
        doc = np.repeat(np.arange(n), size)[:-2]
        inside = doc == np.repeat(np.arange(n), size)[2:]
        counts = np.bincount(doc[inside] * _DIM + triple[inside], minlength=n * _DIM).reshape(n, _DIM)
        out[:, :_DIM] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    rows = np.arange(n)
    for j in range(len(LABELLERS)):
        out[rows, _DIM + 3 * j + vote[:, j]] = 1
    out[:, -1] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, step: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient descent."""
    w = np.zeros(x.shape[1], np.float32)
    ahead, t = w.copy(), 1.0
    scale = step / max(float((x * x).sum(1).mean()) / 4, 1e-9) / 4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - scale * (x.T @ (p - y) / max(len(y), 1) + decay * ahead)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + np.float32((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    return w


def _pieces(column):
    data, offsets = tb.column_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, at + 256, max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1))
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Model:
    """Labeller accuracies and scorer weights; small, of a fixed size.  Without weights the posterior is the score."""

    def __init__(self, table: np.ndarray, prior: float, weights: np.ndarray | None):
        self.table, self.prior, self.weights = table, prior, weights

    def score(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of the votes, score of the linear model) for each text, both as odds of good in [0, 1]."""
        post, score = [np.zeros(0)], [np.zeros(0)]
        for data, offsets in _pieces(column):
            v = votes(*measures(data, offsets))
            post.append(posterior(v, self.table, self.prior))
            score.append(post[-1] if self.weights is None else 1 / (1 + np.exp(-np.clip((features(data, offsets, v) @ self.weights).astype(float), -50, 50))))
        return np.concatenate(post), np.concatenate(score)


def picked(id_col: Column, share: float) -> Column:
    """Whether the id's hash, of 63 bits, is in the share."""
    return F.shiftrightunsigned(F.xxhash64(id_col.cast("string"), F.lit(3)), 1) < int(share * 2**63) if share < 1 else F.lit(True)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit labeller accuracies on the votes over all documents, then the scorer on at most `sample` of them."""
    rows = docs.count()
    share = min(1.0, 0.9 * sample / max(rows, 1))
    pick = picked(F.col(id_col), share)
    text = F.col(text_col).cast("string").alias("text")

    def count(batches):
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for data, offsets in _pieces(batch.column("text")):
                total += np.bincount(_code(votes(*measures(data, offsets))), minlength=len(total))
        codes = np.flatnonzero(total)
        yield pa.record_batch({"code": pa.array(codes, pa.int32()), "n": pa.array(total[codes], pa.int64())})

    def take(batches):
        for batch in batches:
            for data, offsets in _pieces(batch.column("text")):
                v = votes(*measures(data, offsets))
                x = features(data, offsets, v)[:, :_DIM].astype(np.float16)
                codes, rows = _code(v), [r.tobytes() for r in x]
                yield pa.record_batch({"code": pa.array(codes, pa.int32()), "x": pa.array(rows, pa.binary()), "key": pa.array([xxhash.xxh64_intdigest(r, 3) >> 1 for r in rows], pa.int64())})

    seen = sorted(tuple(r) for r in docs.select(text).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n")).collect())
    patterns, counts = _decode(np.array([s[0] for s in seen], np.int64)), np.array([s[1] for s in seen], float)
    post, table, prior = expectation_maximisation(patterns, counts)
    known = {s[0]: p for s, p in zip(seen, post.tolist(), strict=True)}
    drawn = sorted((tuple(r) for r in docs.where(pick).select(text).mapInArrow(take, "code int, x binary, key long").orderBy("key", "code").limit(sample).drop("key").collect()), key=lambda r: (r[0], r[1]))
    if not drawn:
        return Model(table, prior, None)
    codes = np.array([d[0] for d in drawn], np.int64)
    x = np.zeros((len(drawn), _COLUMNS), np.float32)
    x[:, :_DIM] = np.frombuffer(b"".join(bytes(d[1]) for d in drawn), np.float16).reshape(len(drawn), _DIM)
    v = _decode(codes)
    for j in range(len(LABELLERS)):
        x[np.arange(len(v)), _DIM + 3 * j + v[:, j]] = 1
    x[:, -1] = 1
    return Model(table, prior, fit(x, np.array([known[c] for c in codes.tolist()], np.float32)))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, weak_posterior, score, keep) for every document; keep is score >= 0.5.

    A null or wordless text gets no votes and the score of its empty features.  An empty table gives no rows.  Rows of equal
    text get equal scores, whatever their ids; should more than `sample` rows be drawn (rows of one id are drawn
    together), those of least feature hash are fitted.
    """
    model = train(docs, id_col, text_col, sample)

    def apply(batches):
        for batch in batches:
            post, score = model.score(batch.column("text"))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "weak_posterior": pa.array(post), "score": pa.array(score), "keep": pa.array(score >= 0.5)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(apply, "doc_id long, weak_posterior double, score double, keep boolean")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps."""
    model = train(docs, id_col, text_col, sample)

    def apply(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(text_col))[1] >= 0.5))

    return docs.mapInArrow(apply, docs.schema)
