"""Near copies at a shingle similarity of 0.8 and more: proposed by SimHash and soft Golay decoding, decided exactly.

The similarity is the Jaccard similarity of the sets of shingles.  Two texts of similarity 0.8 differ in some 15 % of
the bits of the SimHash of their sets, far more than the few that error patterns of hard-decided bits can bridge.  So
the segments are decoded softly: a bit's margin (how far its sum over the shingles is from a tie) says how likely it is
to flip, and a segment's keys are the three Golay codewords of length 23 that agree best with its margins.  Two texts
of similarity 0.8 share one of them in 74 % of the segments.  A bucket is a pair of segments, nine keys for each text;
of eight such pairs at least one is shared by 99.8 % of the texts of similarity 0.8.

Bits only propose.  Texts in one bucket within MAX_BITS of 384 bits are linked, a limit three standard errors above the
mean for a similarity of 0.8 and short texts (five shingles), more for longer ones.  Within each component of these
links, pairs within MAX_BITS are decided by the exact similarity of their sets, and the components of what is accepted
are the groups.  Groups are transitive.

Buckets are rows shuffled by key, so their number follows the input; a bucket returns a spanning forest of its
links, one beyond CHUNK rows in pieces that meet pairwise in tasks of their own.  Proposed components beyond
PIECE_SHINGLES are dealt into pieces by hash and meet in the same way.  With PAIRED segments to a key there are 4096**PAIRED buckets a table:
take 3 beyond some 10**8 texts, and more BITS and TABLES with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.plans.shared import materialise, scratch

from . import blocks as bl
from . import simhash
from . import textbytes as tb

BITS = 384
MAX_BITS = 96
SIMILARITY = 0.8
TABLES = 8
PAIRED = 2
NEAREST = 3
_LANES = np.uint64(0x0101010101010101)
_LANE_MOST = 255
#: Buckets of at most so many rows return all their links, larger ones a forest.
SMALL = 4
CHUNK = 16_384
_SENT = pa.schema({"src": pa.int64(), "dst": pa.int64(), "key": pa.int64(), "piece": pa.int32(), "print": pa.binary()})
PIECE_SHINGLES = 1 << 20
#: Rows of two numbers up to which a table is broadcast.
BROADCAST = 1 << 18
_DOCS = 128
_BYTES = 1 << 20


def _codebook() -> np.ndarray:
    """Rows of +1 and -1 for the 4096 codewords, one column for each bit."""
    words = np.array([index << 11 | simhash._remainder(index << 11) for index in range(4096)])
    return (2.0 * (words[:, None] >> np.arange(23) & 1) - 1).astype(np.float32)


_CODEBOOK = _codebook()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's distinct shingles, ascending, text after text, and the bounds of the texts."""
    lower = tb.LOWER[data]
    starts, ends, bounds = tb.word_bounds(lower, offsets)
    words = np.diff(bounds)
    number = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    before = np.concatenate([[0], np.cumsum(number)])
    doc = np.repeat(np.arange(len(words)), number)
    first = np.arange(before[-1]) - before[doc] + bounds[doc]
    hashes = tb.run_hashes(tb.word_hashes(lower, starts, ends), first, first + np.minimum(words[doc], shingle))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = bl.groups(doc, hashes)
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(words)))]).astype(np.int64)


def set_names(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits that name each set: two sums of its hashes, mixed differently."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k in (0, 1):
            out[full, k] = np.add.reduceat(tb.mix64(hashes ^ np.uint64(0xD6E8FEB86659FD93 * (k + 1) % (1 << 64))), bounds[:-1][full])
    return [row.tobytes() for row in out]


def _margins(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    number = np.diff(before)
    out = np.zeros((len(number), BITS), np.int64)
    full = np.flatnonzero(number)
    if not len(full):
        return out
    # a lane of one byte counts up to 255 shingles
    parts = -(-number[full] // _LANE_MOST)
    part_of = np.concatenate([[0], np.cumsum(parts)])
    begin = np.repeat(before[full], parts) + _LANE_MOST * (np.arange(part_of[-1]) - np.repeat(part_of[:-1], parts))
    sums = np.empty((len(begin), BITS), np.uint8)
    for group in range(BITS // 64):
        h = tb.mix64(hashes + np.uint64((group + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        for bit in range(8):
            lanes = np.add.reduceat(h >> np.uint64(bit) & _LANES, begin)
            sums[:, group * 64 + bit : group * 64 + 64 : 8] = lanes.view(np.uint8).reshape(-1, 8)
    out[full] = 2 * np.add.reduceat(sums, part_of[:-1], axis=0, dtype=np.int64) - number[full, None]
    return out


def margins(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """For each text and bit, the distinct shingles that set the bit less those that do not."""
    return _margins(*shingle_sets(data, offsets, shingle))


def nearest_codewords(margin: np.ndarray) -> np.ndarray:
    """Indexes of the NEAREST best codewords of each segment that keys use: (texts, segments, NEAREST)."""
    segments = TABLES * PAIRED
    fit = margin[:, : 23 * segments].reshape(-1, 23).astype(np.float32) @ _CODEBOOK.T
    rows, out = np.arange(len(fit)), np.empty((len(fit), NEAREST), np.int16)
    for k in range(NEAREST):
        out[:, k] = best = fit.argmax(axis=1)
        fit[rows, best] = -np.inf
    return out.reshape(len(margin), segments, NEAREST)


def keys_of(codes: np.ndarray) -> np.ndarray:
    """The bucket keys of each text: (texts, TABLES * NEAREST**PAIRED)."""
    n = len(codes)
    keys = []
    for table in range(TABLES):
        key = np.full((n, 1), table, np.int64)
        for segment in range(table * PAIRED, (table + 1) * PAIRED):
            key = (key[:, :, None] << 12 | codes[:, None, segment, :].astype(np.int64)).reshape(n, -1)
        keys.append(key)
    return np.concatenate(keys, axis=1)


def _parts(column, shingle: int):
    """(from, to, hashes, bounds): the shingle sets of a few rows of a text column at a time."""
    data, offsets = tb.column_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, at + _DOCS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + _BYTES, "right")) - 1))
        yield at, to, *shingle_sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], shingle)
        at = to


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, name, n, print, codes) for each of docs (doc_id, text): the name and size of its shingle set, its
    fingerprint and the codewords of its keys, packed."""

    def make(batches):
        for batch in batches:
            for at, to, hashes, bounds in _parts(batch.column("text"), shingle):
                margin = _margins(hashes, bounds)
                prints = np.packbits(margin > 0, axis=1, bitorder="little")
                codes = nearest_codewords(margin)
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(at, to - at), "name": pa.array(set_names(hashes, bounds), pa.binary()), "n": pa.array(np.diff(bounds)), "print": pa.array([p.tobytes() for p in prints], pa.binary()), "codes": pa.array([c.tobytes() for c in codes], pa.binary())})

    return docs.mapInArrow(make, "doc_id long, name binary, n long, print binary, codes binary")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(name, shingles) for each of docs (doc_id, text), the hashes packed."""

    def make(batches):
        for batch in batches:
            for _, _, hashes, bounds in _parts(batch.column("text"), shingle):
                yield pa.record_batch({"name": pa.array(set_names(hashes, bounds), pa.binary()), "shingles": pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})

    return docs.mapInArrow(make, "name binary, shingles binary")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _forest(nodes: np.ndarray, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links within one large bucket."""
    left, queue, out = np.argsort(nodes, kind="stable"), [], []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = _distance(prints[left], prints[at]) <= MAX_BITS
        found, left = left[near], left[~near]
        out.append((np.full(len(found), nodes[at]), nodes[found]))
        queue += found.tolist()
    return out


def bucket_links(keys: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Links (rows of two nodes) within the buckets; keys are sorted."""
    new = np.flatnonzero(bl.groups(keys))
    sizes = np.diff(np.append(new, len(keys)))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    live = np.arange(len(small))
    for step in range(1, SMALL):
        live = live[live + step < len(small)]
        live = live[keys[small[live]] == keys[small[live + step]]]
        if not len(live):
            break
        a, b = small[live], small[live + step]
        near = _distance(prints[a], prints[b]) <= MAX_BITS
        out.append((nodes[a[near]], nodes[b[near]]))
    for at, size in zip(new[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        out += _forest(nodes[at : at + size], prints[at : at + size])
    a, b = (np.concatenate(side) for side in zip(*out, strict=True))
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


def links(classes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (src, dst) between classes (node, print, codes), enough to connect what buckets verify.

    A task streams its buckets in the order of their keys and holds one of at most `chunk` rows.  A larger one leaves
    it unverified, in pieces of `chunk` rows; each pair of its pieces is a group, and so a unit of work, of its own.
    """

    def scatter(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.int16).reshape(part.num_rows, TABLES * PAIRED, NEAREST)
                keys = keys_of(codes)
                rows = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                yield pa.record_batch({"key": pa.array(keys.ravel()), "node": part.column("node").take(rows), "print": part.column("print").take(rows)})

    def gather(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows of the bucket that the next batch may continue
        sent = 0  # pieces of that bucket that have left

        def verified(parts):
            pairs = bucket_links(*(np.concatenate(side) for side in zip(*parts, strict=True)))
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(pa.nulls(len(pairs), kind) for kind in (pa.int64(), pa.int32(), pa.binary()))], _SENT)

        def pieces(least: int):
            """Pieces of `chunk` rows of the held bucket, while it has `least` rows."""
            nonlocal held, sent
            if sum(len(part[0]) for part in held) < least:
                return
            keys, nodes, prints = (np.concatenate(side) for side in zip(*held, strict=True))
            at = 0
            while len(keys) - at >= least:
                n = min(chunk, len(keys) - at)
                yield pa.record_batch([pa.array(nodes[at : at + n]), pa.nulls(n, pa.int64()), pa.array(keys[at : at + n]), pa.array(np.full(n, sent, np.int32)), pa.array([p.tobytes() for p in prints[at : at + n]], pa.binary())], _SENT)
                at, sent = at + n, sent + 1
            held = [(keys[at:], nodes[at:], prints[at:])] if at < len(keys) else []

        last_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            whole = (keys, batch.column("node").to_numpy(), np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint64).reshape(-1, BITS // 64))
            same = int(np.searchsorted(keys, last_key, "right")) if last_key is not None and keys[0] == last_key else 0
            if same:
                held.append(tuple(side[:same] for side in whole))
            if same < len(keys):
                if sent:
                    yield from pieces(1)
                last = max(same, int(np.searchsorted(keys, keys[-1])))
                done = [*held, tuple(side[same:last] for side in whole)]
                if any(len(part[0]) for part in done):
                    yield verified(done)
                held, sent, last_key = [tuple(side[last:] for side in whole)], 0, keys[-1]
            yield from pieces(chunk)
        if sent:
            yield from pieces(1)
        elif held:
            yield verified(held)

    def between(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        prints = np.frombuffer(b"".join(table["print"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        edges = _forest(table["src"].to_numpy(), prints)
        a, b = (np.concatenate(side) for side in zip(*edges, strict=True))
        return pa.table({"src": pa.array(a), "dst": pa.array(b)})

    keyed = classes.select("node", "print", "codes").mapInArrow(scatter, "key long, node long, print binary")
    sent = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(gather, "src long, dst long, key long, piece int, print binary")
    return simhash.meetings(materialise(sent, "links"), between)


def alike(at: int, others: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of the other sets have a similarity of SIMILARITY and more to the set `at`."""
    own, sizes = hashes[bounds[at] : bounds[at + 1]], np.diff(bounds)[others]
    out = (np.minimum(sizes, len(own)) >= SIMILARITY * np.maximum(sizes, len(own)) - 1e-9) & (sizes > 0)
    if not out.any():
        return out
    some, sizes = others[out], sizes[out]
    ends = np.cumsum(sizes)
    theirs = hashes[np.repeat(bounds[some] - (ends - sizes), sizes) + np.arange(ends[-1])]
    common = np.add.reduceat(own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs, ends - sizes, dtype=np.int64)
    out[out] = common >= SIMILARITY * (sizes + len(own) - common) - 1e-9
    return out


def exact_forest(nodes: np.ndarray, prints: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within MAX_BITS whose sets are alike."""
    left, queue, out = np.argsort(nodes, kind="stable"), [], [(nodes[:0], nodes[:0])]
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.flatnonzero(_distance(prints[left], prints[at]) <= MAX_BITS)
        near = near[alike(at, left[near], hashes, bounds)]
        found, left = left[near], np.delete(left, near)
        out.append((np.full(len(found), nodes[at]), nodes[found]))
        queue += found.tolist()
    a, b = (np.concatenate(side) for side in zip(*out, strict=True))
    return a, b


def accepted_links(docs: DataFrame, classes: DataFrame, proposed: DataFrame, shingle: int) -> DataFrame:
    """Links (src, dst) between nodes of one proposed component (node, component), by the exact similarity of their sets."""
    named = proposed.join(classes.select("node", "doc_id", "name", "n", "print"), "node")
    sizes = named.groupBy("component").agg(F.ceil(F.sum("n") / PIECE_SHINGLES).alias("pieces")).where("pieces > 1")
    large = materialise(sizes.withColumnRenamed("component", "_large"), "large")
    # few as a rule; a join by component would bring the members of a large one to one task
    large = F.broadcast(large) if large.count() <= BROADCAST else large
    told = named.join(large, F.col("component") == F.col("_large"), "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    dealt = {"piece": F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"), "most": (F.col("pieces") - 1).cast("int")}
    members = materialise(told.withColumns(dealt).drop("_large", "pieces"), "members")
    texts = docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = _sets(texts, shingle).join(members, "name").dropDuplicates(["node"])
    rows = sets.select(F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), F.col("component").alias("key"), "piece", "most", "print", "shingles")

    def decide(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        prints = np.frombuffer(b"".join(table["print"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        packed = table["shingles"].to_pylist()
        bounds = np.concatenate([[0], np.cumsum([len(p) // 8 for p in packed])]).astype(np.int64)
        a, b = exact_forest(table["src"].to_numpy(), prints, np.frombuffer(b"".join(packed), np.uint64), bounds)
        return pa.table({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})

    return simhash.meetings(materialise(rows, "sets"), decide)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id and component_id, the least doc_id reachable over links, for each row whose id is not null.

    Texts are lower-cased (A-Z) and cut into words as the fingerprint operator does; with fewer words than a
    shingle the whole text is one.  Null, empty and wordless texts are copies of each other.  Equal sets of shingles
    are one class, so groups of copies of any size add no links.  No rows: no rows.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch() as steps:
        each = steps.keep(materialise(sketches(texts, shingle), "sketches"))
        grouped = each.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("print").alias("print"), F.min("codes").alias("codes"))
        classes = steps.keep(materialise(grouped.withColumn("node", F.xxhash64("name")), "classes"))
        proposed = connected_components(links(classes))
        labels = steps.keep(materialise(connected_components(accepted_links(texts, classes, proposed, shingle)), "labels"))
    least = labels.join(classes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = classes.select("name", "node", "doc_id").join(labels, "node", "left").join(least, "component", "left").select("name", F.coalesce("least", "doc_id").alias("component_id"))
    return each.select("doc_id", "name").join(named, "name").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of docs, all columns, without near copies of a smaller id; see simhash.keep_least."""
    return simhash.keep_least(docs, near_copies(docs, id_col, text_col, shingle), id_col)
