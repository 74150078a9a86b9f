"""Exchange of packed keys between blocks of documents and ranges of a key space.

A corpus is cut into blocks of documents, by hash, of some megabytes of text.  Each block sends its
distinct keys, sorted and packed, to the ranges of the key space; each range merges what all blocks
sent and answers each block, key by key and in the same order.  A frequent key is one entry for each
block, so no key, source or group of copies makes a range large.  The number of blocks and ranges
follows the bytes of text, so what one task holds stays the same at every size.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
#: Messages of a round beyond which they go by way of groups.
MESSAGES = 1 << 20


def block_count(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks needed for the text: one aggregate, of one row."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    return max(1, math.ceil((total["n"] + 16 * total["rows"]) / block_bytes))


def with_block(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """(block, doc_id, text).  The text is hashed too, so rows of one id or none are not one block."""
    return docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(7)), F.lit(blocks)).cast("long").alias("block"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as fixed-width differences."""
    if not len(keys):
        return struct.pack("<IBQ", 0, 1, 0)
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    body = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    return struct.pack("<IBQ", len(keys), width, int(keys[0])) + body


def unpack_sorted(buf: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    n, width, first = struct.unpack_from("<IBQ", buf, at)
    at += 13
    if n == 0:
        return np.zeros(0, np.uint64), at
    steps = np.zeros((n - 1, 8), np.uint8)
    steps[:, :width] = np.frombuffer(buf, np.uint8, (n - 1) * width, at).reshape(n - 1, width)
    keys = np.empty(n, np.uint64)
    keys[0] = first
    np.cumsum(steps.view("<u8").ravel(), out=keys[1:])
    keys[1:] += np.uint64(first)
    return keys, at + (n - 1) * width


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in two bits each; those of three and more follow in a byte, and of these the largest in eight."""
    code = np.zeros(-(-len(counts) // 4) * 4, np.uint8)
    code[: len(counts)] = np.minimum(counts, 3)
    more = counts[counts >= 3] - 3
    quarters = code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    return np.bitwise_or.reduce(quarters, axis=1).tobytes() + np.minimum(more, 255).astype(np.uint8).tobytes() + more[more >= 255].astype("<i8").tobytes()


def unpack_counts(buf: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    size = (n + 3) // 4
    quarters = np.frombuffer(buf, np.uint8, size, at)
    counts = (quarters[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()[:n].astype(np.int64)
    large = np.flatnonzero(counts == 3)
    more = np.frombuffer(buf, np.uint8, len(large), at + size).astype(np.int64)
    at += size + len(large)
    big = more == 255
    k = int(big.sum())
    more[big] = np.frombuffer(buf, "<i8", k, at)
    counts[large] += more
    return counts, at + 8 * k


def range_cuts(keys: np.ndarray, ranges: int, bits: int = 64) -> np.ndarray:
    """Bounds of each range among ascending keys of so many bits."""
    width = (1 << bits) / ranges
    edges = np.array([min(int(i * width), (1 << 64) - 1) for i in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def bundle(parts: list[bytes]) -> bytes:
    """Several payloads as one."""
    return struct.pack("<I", len(parts)) + np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def unbundle(buf: bytes) -> list[bytes]:
    n = int.from_bytes(buf[:4], "little")
    sizes = np.frombuffer(buf, "<u4", n, 4).astype(np.int64)
    ends = 4 + 4 * n + np.cumsum(sizes)
    return [buf[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


class Plan:
    """How many blocks and ranges there are, and how many ranges and blocks share a hop (0: no hops).

    Each block has something for each range.  Up to `most` messages a round go straight.  Beyond that they take two
    hops: fan = sqrt(ranges) ranges are one coarse range and fan blocks one group; a block writes to coarse ranges, and
    each pair of a group and a coarse range deals what it got to the ranges, so a round has blocks * sqrt(ranges) messages.
    """

    def __init__(self, blocks: int, ranges: int, most: int = MESSAGES):
        self.blocks, self.ranges = blocks, ranges
        self.fan = math.ceil(math.sqrt(ranges)) if blocks * ranges > most else 0


def canonical(table: pa.Table) -> pa.Table:
    """A block's rows by id and text: a shuffle gives them in any order, but the places of a round have to hold in the next."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def _rows(number: str, values, **more) -> pa.Table:
    kinds = {"rng": pa.int32(), "block": pa.int64(), "grp": pa.int64(), "payload": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in {number: values, **more}.items()})


def _in_order(table: pa.Table, column: str) -> tuple[np.ndarray, list[bytes]]:
    order = np.argsort(table[column].to_numpy(), kind="stable")
    return table[column].to_numpy()[order], table["payload"].take(pa.array(order)).to_pylist()


def exchange(blocks: DataFrame, plan: Plan, send: Callable, answer: Callable, previous: DataFrame | None = None) -> DataFrame:
    """One round: send(text table, answers or None) gives a block's payloads for all ranges, in order; answer(payloads)
    gives an equally long list for a range.  Returns rows (block, rng, payload) for the next round or for finish()."""
    fan = plan.fan

    def rows(block: int, payloads) -> pa.Table:
        payloads = list(payloads)
        if fan:
            payloads = [bundle(payloads[k : k + fan]) for k in range(0, len(payloads), fan)]
        return _rows("rng", range(len(payloads)), block=[block] * len(payloads), payload=payloads)

    sent_schema = "rng int, block long, payload binary"
    if previous is None:
        sent = blocks.groupBy("block").applyInArrow(lambda table: rows(table["block"][0].as_py(), send(canonical(table), None)), sent_schema)
    else:
        def resend(table: pa.Table, answers: pa.Table) -> pa.Table:
            return rows(table["block"][0].as_py(), send(canonical(table), by_range(answers, fan))) if table.num_rows else rows(0, [])

        sent = blocks.groupBy("block").cogroup(previous.groupBy("block")).applyInArrow(resend, sent_schema)

    def reply(table: pa.Table) -> pa.Table:
        block, payloads = _in_order(table, "block")
        return _rows("block", block, rng=[table["rng"][0].as_py()] * len(block), payload=answer(payloads))

    if not fan:
        return sent.groupBy("rng").applyInArrow(reply, "block long, rng int, payload binary")

    def deal(table: pa.Table) -> pa.Table:
        """What a group of blocks sent to a coarse range, to its ranges."""
        block, payloads = _in_order(table, "block")
        parts, first = [unbundle(p) for p in payloads], table["rng"][0].as_py() * fan
        names = block.astype("<i8").tobytes()
        out = [bundle([names, *(p[k] for p in parts)]) for k in range(len(parts[0]))]
        return _rows("rng", range(first, first + len(out)), grp=[int(block[0]) // fan] * len(out), payload=out)

    def reply_to_groups(table: pa.Table) -> pa.Table:
        grp, payloads = _in_order(table, "grp")
        parts = [unbundle(p) for p in payloads]
        out, at = answer([x for p in parts for x in p[1:]]), 0
        back = []
        for p in parts:
            back.append(bundle([p[0], *out[at : at + len(p) - 1]]))
            at += len(p) - 1
        return _rows("grp", grp, rng=[table["rng"][0].as_py()] * len(grp), payload=back)

    def hand_back(table: pa.Table) -> pa.Table:
        """The answers of a coarse range's ranges to a group of blocks, to the blocks."""
        rng, payloads = _in_order(table, "rng")
        parts = [unbundle(p) for p in payloads]
        block = np.frombuffer(parts[0][0], "<i8")
        out = [bundle([p[k + 1] for p in parts]) for k in range(len(block))]
        return _rows("block", block, rng=[int(rng[0]) // fan] * len(block), payload=out)

    dealt = sent.groupBy("rng", F.floor(F.col("block") / fan).alias("grp")).applyInArrow(deal, "rng int, grp long, payload binary")
    answered = dealt.groupBy("rng").applyInArrow(reply_to_groups, "grp long, rng int, payload binary")
    return answered.groupBy("grp", F.floor(F.col("rng") / fan).alias("coarse")).applyInArrow(hand_back, "block long, rng int, payload binary")


def by_range(answers: pa.Table, fan: int) -> list[bytes]:
    payloads = _in_order(answers, "rng")[1]
    return [x for p in payloads for x in unbundle(p)] if fan else payloads


def finish(blocks: DataFrame, plan: Plan, answers: DataFrame, result: Callable, schema: str) -> DataFrame:
    """result(text table, payloads by range) makes the rows of a block."""

    def apply(table: pa.Table, replies: pa.Table) -> pa.Table:
        return result(canonical(table), by_range(replies, plan.fan))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply, schema)


NO_ID = (1 << 63) - 1


def ids(table: pa.Table) -> np.ndarray:
    """Document ids; a null id counts as larger than all others."""
    return np.asarray(table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False), np.int64)


def id_array(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def pack_values(values: np.ndarray) -> bytes:
    """Signed values as their least and fixed-width distances from it."""
    if not len(values):
        return struct.pack("<BQ", 1, 0)
    low = values.min()
    far = values.astype(np.uint64) - np.uint64(low.astype(np.uint64))
    width = max(1, (int(far.max()).bit_length() + 7) // 8)
    return struct.pack("<BQ", width, int(low.astype(np.uint64))) + np.ascontiguousarray(far.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_values(buf: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    width, low = struct.unpack_from("<BQ", buf, at)
    at += 9
    far = np.zeros((n, 8), np.uint8)
    far[:, :width] = np.frombuffer(buf, np.uint8, n * width, at).reshape(n, width)
    return (far.view("<u8").ravel() + np.uint64(low)).astype(np.int64), at + n * width


def groups(*columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in columns sorted together."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def split_back(flags: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    return np.split(flags, np.cumsum(lengths)[:-1]) if lengths else []


def pack_places(places: np.ndarray) -> bytes:
    """A list of places in a block, which may follow others."""
    return struct.pack("<I", len(places)) + pack_values(places)


def unpack_places(buf: bytes) -> list[np.ndarray]:
    """All lists of a payload."""
    out, at = [], 0
    while at < len(buf):
        n = int.from_bytes(buf[at : at + 4], "little")
        places, at = unpack_values(buf, n, at + 4)
        out.append(places)
    return out
