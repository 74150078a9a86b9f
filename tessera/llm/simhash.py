"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits (the last padded with zeros).  The
binary Golay code of length 23 is perfect: each word lies within 3 bits of exactly one codeword.  Take as
keys of a word its nearest codeword and, if that is 3 bits off, the five codewords 4 bits off.  Of two
words that differ in at most one bit, the nearest codeword of either is a key of the other.

Pigeonhole: if two fingerprints differ in at most 3 bits, either each segment differs in one bit, or one
segment is equal and another differs in at most one.  Hence two kinds of buckets, of 35 and 36 bits and
more: (equal segment, codeword of another) and (three codewords).  Where a segment differs in one bit its
parity differs, so only words of even parity emit the farther keys.  Buckets verify the real distance and
return a spanning forest of their links, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.plans.shared import materialise, scratch

from . import blocks as bl
from . import textbytes as tb

MAX_BITS = 3
_GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_PIECE = 1 << 16
LIMIT = 1 << 22
LARGE = 1024
CHUNK = 16_384
_SENT = pa.schema({"src": pa.int64(), "dst": pa.int64(), "key": pa.int64(), "piece": pa.int32()})


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes by 12- and 11-bit halves, and for each syndrome the error patterns of its keys, -1 padded."""
    unit = [_remainder(1 << b) for b in range(23)]
    halves = np.zeros((2, 4096), np.int64)
    for v in range(4096):
        for b in range(12):
            if v >> b & 1:
                halves[0, v] ^= unit[b]
                if b < 11:
                    halves[1, v] ^= unit[12 + b]
    patterns = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = e = 0
            for b in bits:
                s ^= unit[b]
                e |= 1 << b
            patterns[s, used[s]] = e
            used[s] += 1
    return halves[0], halves[1], patterns


_LOW, _HIGH, _PATTERNS = _golay_tables()


def codewords(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the indexes of its key codewords, nearest first, -1 where there are fewer than six."""
    patterns = _PATTERNS[_LOW[words & 4095] ^ _HIGH[words >> 12]]
    return np.where(patterns >= 0, (words[:, None] ^ patterns) >> 11, -1)


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of their fingerprint) of all buckets that the fingerprints enter."""
    x = prints.astype(np.uint64)
    part = [(x & np.uint64((1 << 23) - 1)).astype(np.int64), (x >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64), (x >> np.uint64(46)).astype(np.int64)]
    code = [codewords(p) for p in part]
    odd = [np.bitwise_count(p) & 1 == 1 for p in part]
    keys, owners = [], []

    def emit(key: np.ndarray, valid: np.ndarray) -> None:
        owner, _ = np.nonzero(valid)
        keys.append(key[valid])
        owners.append(owner)

    kind = 1
    for equal in range(3):
        for near in range(3):
            if equal != near:
                valid = code[near] >= 0
                valid[:, 1:] &= ~odd[near][:, None]
                emit(kind << 56 | part[equal][:, None] << 12 | np.maximum(code[near], 0), valid)
                kind += 1
    # all three differ in one bit: the side that is even in the first segment emits every combination
    even = ~odd[0]
    side = odd[1].astype(np.int64) * 2 + odd[2]
    side = np.where(even, side, 3 - side)
    first, second, third = (np.maximum(c, 0) for c in code)
    combined = kind << 56 | side[:, None, None, None] << 36 | first[:, :, None, None] << 24 | second[:, None, :, None] << 12 | third[:, None, None, :]
    valid = (code[0] >= 0)[:, :, None, None] & (code[1] >= 0)[:, None, :, None] & (code[2] >= 0)[:, None, None, :]
    nearest = np.zeros((6, 6, 6), bool)
    nearest[0, 0, 0] = True
    valid &= even[:, None, None, None] | nearest
    n = len(x)
    emit(combined.reshape(n, 216), valid.reshape(n, 216))
    return np.concatenate(keys), np.concatenate(owners)


def _fingerprints(column, shingle: int) -> np.ndarray:
    """64-bit fingerprints of all texts of an Arrow column."""
    data, offsets = tb.column_bytes(column)
    n = len(offsets) - 1
    counts, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    at = 0
    while at < n:  # some megabytes at a time
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 21), "right")) - 1)
        piece = tb.LOWER[data[offsets[at] : offsets[to]]]
        starts, ends, bounds = tb.word_bounds(piece, offsets[at : to + 1] - offsets[at])
        text, starts, ends = tb.joined_words(piece, starts, ends)
        words = np.diff(bounds)
        number = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
        doc = np.repeat(np.arange(to - at), number)
        before = np.concatenate([[0], np.cumsum(number)])
        first = np.arange(len(doc)) - before[doc] + bounds[doc]
        last = first + np.minimum(words[doc], shingle) - 1
        raw = text.tobytes()
        total[at:to] = number
        for k in range(0, len(doc), _PIECE):
            part = slice(k, k + _PIECE)
            h = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts[first[part]].tolist(), ends[last[part]].tolist(), strict=True)), np.uint64, len(first[part]))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = doc[part]
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            counts[at + own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
        at = to
    set_bits = counts * 2 > total[:, None]
    return (set_bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, print): print is the fingerprint as a signed long; no words: zero."""

    def make(batches):
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "print": pa.array(_fingerprints(batch.column("text"), shingle).view(np.int64), pa.int64())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(make, "doc_id long, print long")


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within one large bucket."""
    left, edges, queue = prints, [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= MAX_BITS
        found = left[near]
        left = left[~near]
        edges += [(at, y) for y in found]
        queue += list(found)
    return edges


def distinct_rows(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order and without repeats: one fingerprint may enter a bucket twice."""
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    new = bl.groups(keys, prints)
    return keys[new], prints[new]


def bucket_links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most 3 bits among the fingerprints that share a key."""
    keys, prints = distinct_rows(keys, prints)
    new = np.flatnonzero(bl.groups(keys))
    sizes = np.diff(np.append(new, len(keys)))
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    small = np.repeat(sizes <= 48, sizes)
    k, p = keys[small], prints[small]
    live = np.arange(len(k))
    for step in range(1, 48):
        live = live[live + step < len(k)]
        live = live[k[live + step] == k[live]]
        if not len(live):
            break
        x, y = p[live], p[live + step]
        near = np.bitwise_count(x ^ y) <= MAX_BITS
        a.append(x[near])
        b.append(y[near])
    for at, size in zip(new[sizes > 48], sizes[sizes > 48], strict=True):
        edges = _forest(prints[at : at + size])
        a.append(np.array([e[0] for e in edges], np.uint64))
        b.append(np.array([e[1] for e in edges], np.uint64))
    x, y = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def meetings(sent: DataFrame, forest: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Links (src, dst) of a table of links and of rows (key, piece, ...) of hot buckets, which bring no link yet.

    Each piece of a bucket meets every other one in a group of its own, to which forest() is applied; where there is
    but one, it is alone.  So a task holds two pieces, and a hot bucket is spread over many tasks.  A column most, the
    number of the bucket's last piece, spares a join.
    """
    hot = sent.where(F.col("key").isNotNull())
    if "most" not in sent.columns:
        hot = hot.join(hot.groupBy("key").agg(F.max("piece").alias("most")), "key")
    meets = hot.withColumn("other", F.explode(F.sequence(F.lit(0), "most"))).where("other <> piece or most = 0")
    across = meets.groupBy("key", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j")).applyInArrow(forest, "src long, dst long")
    return sent.where(F.col("key").isNull()).select("src", "dst").unionByName(across)


def links(prints: DataFrame, count: int, limit: int = LIMIT, large: int = LARGE, chunk: int = CHUNK) -> DataFrame:
    """Links (src, dst) between distinct fingerprints; enough of them to connect whatever is within 3 bits.

    A task streams what its range of buckets was sent.  Whenever it holds more than `limit` rows, buckets of `large`
    rows and more leave it unverified, in pieces of at most `chunk` rows, and meet elsewhere; no bucket is cut short.
    """
    ranges = max(1, math.ceil(count / 12_000))  # some 100 keys of 16 bytes each

    def scatter(batches):
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(every), 4096):
                x = every[k : k + 4096]
                keys, owner = bucket_keys(x)
                place = tb.mix64(keys.astype(np.uint64)) >> np.uint64(40)
                rng = (place * np.uint64(ranges) >> np.uint64(24)).astype(np.int32)
                order = np.argsort(rng, kind="stable")
                cuts = np.searchsorted(rng[order], np.arange(ranges + 1))
                keys, own = keys[order], x[owner[order]]
                payload = [keys[a:b].astype("<i8").tobytes() + own[a:b].astype("<u8").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                keep = [r for r in range(ranges) if payload[r]]
                yield pa.record_batch({"rng": pa.array(keep, pa.int32()), "payload": pa.array([payload[r] for r in keep], pa.binary())})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        sent: dict[int, int] = {}  # pieces that have left, by bucket
        size, most = 0, limit

        def leave(keys, prints, which):
            """The buckets in `which`, (begin, end) each, as pieces."""
            for begin, end in which:
                for at in range(begin, end, chunk):
                    n, key = min(chunk, end - at), int(keys[at])
                    sent[key] = sent.get(key, -1) + 1
                    yield pa.record_batch([pa.array(prints[at : at + n].view(np.int64)), pa.nulls(n, pa.int64()), pa.array(keys[at : at + n]), pa.array(np.full(n, sent[key], np.int32))], _SENT)

        def relieved():
            """Send large buckets and those of which a part has left; keep the rest."""
            nonlocal held
            keys, prints = distinct_rows(*(np.concatenate(side) for side in zip(*held, strict=True)))
            begin = np.flatnonzero(bl.groups(keys))
            end = np.append(begin[1:], len(keys))
            out = (end - begin >= large) | np.isin(keys[begin], np.fromiter(sent, np.int64, len(sent)))
            stay = np.repeat(~out, end - begin)
            yield from leave(keys, prints, zip(begin[out].tolist(), end[out].tolist(), strict=True))
            held = [(keys[stay], prints[stay])]

        for batch in batches:
            for p in batch.column("payload").to_pylist():
                held.append((np.frombuffer(p, "<i8", len(p) // 16), np.frombuffer(p, "<u8", len(p) // 16, len(p) // 2)))
                size += len(p) // 16
                if size > most:
                    yield from relieved()
                    size = len(held[0][0])
                    most = max(limit, 2 * size)
        if sent:
            yield from relieved()
        a, b = bucket_links(*(np.concatenate(side) for side in zip(*held, strict=True)))
        yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())], _SENT)

    def between(table: pa.Table) -> pa.Table:
        met = np.unique(table["src"].to_numpy()).view(np.uint64)  # a fingerprint may be in both pieces
        edges = np.array(_forest(met), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"src": pa.array(edges[:, 0]), "dst": pa.array(edges[:, 1])})

    scattered = prints.select("print").mapInArrow(scatter, "rng int, payload binary")
    return meetings(materialise(scattered.groupBy("rng").applyInArrow(gather, "src long, dst long, key long, piece int"), "links"), between)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable over links of at most 3 bits.

    Texts that are null or have no word get fingerprint zero and are linked like any other.  Equal
    fingerprints are one node, so a group of copies of any size adds no links.  A null id is never the least.
    """
    with scratch() as steps:
        each = steps.keep(materialise(fingerprints(docs, id_col, text_col, shingle), "prints"))
        classes = steps.keep(materialise(each.groupBy("print").agg(F.min("doc_id").alias("least")), "classes"))
        labels = steps.keep(materialise(connected_components(links(classes, classes.count())), "labels"))
    rooted = classes.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "component").select("print", "component_id")
    return each.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, near: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, without those whose component_id in `near` is a smaller id; of rows with the same id one stays.

    Rows with a null id stay: they cannot be named as copies.
    """
    by_id = materialise(near.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "groups")
    gone = by_id.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).hint("merge")
    kept = docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")  # sort-merge at every size: the ids have no bound
    again = by_id.where("n > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return kept
    single = kept.join(again, F.col(id_col) == F.col("_again"), "left_anti")
    return single.unionByName(kept.join(again, F.col(id_col) == F.col("_again"), "left_semi").dropDuplicates([id_col]))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of docs without those linked to a smaller id over fingerprints; see keep_least."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col, shingle), id_col)
