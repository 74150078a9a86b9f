"""Removal of byte strings that occur earlier, by merging Burrows-Wheeler transforms of shards.

Round one, a filter that loses nothing.  Of the grams of GRAM bytes in each string of LENGTH bytes the one of least
hash, the first of equals, is its anchor; equal strings have equal anchors at equal places.  Anchors are counted over
the corpus.  A string whose anchor occurs once occurs once.

Round two.  Consecutive strings with one anchor are a piece of text; pieces with repeated anchors go to ranges of the
anchor's hash, so equal strings meet.  A range receives the pieces of each block as one shard.  Each shard's
suffixes are sorted and its multi-string Burrows-Wheeler transform is taken (symbols are grams of STRIDE bytes, read at
that stride).  The transforms are then merged by iterative interleave refinement (Holt and McMillan, Bioinformatics
2014): beginning with the shards one after the other, each round reads the symbols in the order of the interleave and
deals the shard numbers out by symbol.  After r rounds the merged order is by the first r symbols; the bounds of runs
that agree in them, kept along, are the places where the common prefix is shorter.  After LENGTH / STRIDE rounds each
run is a repeated interval: all suffixes that begin with the same LENGTH bytes.  No suffixes of two shards are ever
compared.  The earliest place of an interval stays, the others are covered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as bl
from . import textbytes as tb

LENGTH, GRAM, STRIDE = 100, 40, 50
BLOCK_BYTES = 2 << 20
_PLACE_BITS = 15


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours (van Herk): two running minima over chunks."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    chunks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(chunks, axis=1).ravel()
    behind = np.minimum.accumulate(chunks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors_at(hashes: np.ndarray, width: int, places: int = (1 << _PLACE_BITS) - 1) -> np.ndarray:
    """For each `width` neighbours the place of the least, by the hash's high bits and then the place.

    Stretches of at most `places` hashes, overlapping by width - 1, so the bits compared are the same in a block of any size.
    """
    low = np.uint64((1 << _PLACE_BITS) - 1)
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(hashes) - width + 1, places - width + 1):
        part = hashes[at : at + places]
        out.append((sliding_least((part & ~low) | np.arange(len(part), dtype=np.uint64), width) & low).astype(np.int64) + at)
    return np.concatenate(out)


class _Pieces:
    """The pieces of one block: consecutive strings that share an anchor, in order of the anchors' hashes."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        data, offsets = tb.column_bytes(table["text"])
        n = len(data)
        hashes = tb.every_byte_window(data, gram)
        least = anchors_at(hashes, length - gram + 1)
        valid = np.zeros(max(0, n - length + 1), bool)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            valid[a : max(a, b - length + 1)] = True
        at = np.flatnonzero(valid)
        anchor = least[at]
        new = bl.groups(anchor) if len(at) else np.zeros(0, bool)
        if len(at):
            new[1:] |= at[1:] != at[:-1] + 1
        head = np.flatnonzero(new)
        value = tb.mix64(hashes[anchor[head]])  # the hash of the anchor, mixed again: the least are all small
        order = tb.stable_order(value)
        self.value, self.first, self.size = value[order], at[head][order], np.diff(np.append(head, len(at)))[order]

    def payloads(self, ranges: int):
        """The pieces of each range: hash of the anchor, first string and number of strings."""
        cuts = bl.range_cuts(self.value, ranges)
        for r in range(ranges):
            part = slice(cuts[r], cuts[r + 1])
            yield bl.pack_sorted(self.value[part]) + self.size[part].astype(np.uint8).tobytes() + bl.pack_values(self.first[part])


def _repeated_anchors(payloads: list[bytes]) -> list[bytes]:
    """Of each payload the pieces whose anchor occurs again: hash of the anchor, first string and number of strings."""
    values = [bl.unpack_sorted(p) for p in payloads]
    flat = np.concatenate([v for v, _ in values])
    order = tb.stable_order(flat)
    new = bl.groups(flat[order])
    again = ~new
    again[:-1] |= ~new[1:]
    repeated = np.empty(len(order), bool)
    repeated[order] = again
    out = []
    for p, (v, at), mine in zip(payloads, values, bl.split_back(repeated, [len(v) for v, _ in values]), strict=True):
        size = np.frombuffer(p, np.uint8, len(v), at)
        out.append(bl.pack_sorted(v[mine]) + size[mine].tobytes() + bl.pack_values(bl.unpack_values(p, len(v), at + len(v))[0][mine]))
    return out


def _asked(table: pa.Table, answers: list[bytes], length: int):
    """For each range what a block asks it: the text of its pieces with repeated anchors.  Of equal texts in the block
    the earliest asks; what lies behind it is known to be removed and goes along, to come back with the answer."""
    data, offsets = tb.column_bytes(table["text"])
    doc_ids = bl.ids(table)
    values, firsts, sizes = [], [], []
    for a in answers:
        value, at = bl.unpack_sorted(a)
        values.append(value)
        sizes.append(np.frombuffer(a, np.uint8, len(value), at).astype(np.int64))
        firsts.append(bl.unpack_values(a, len(value), at + len(value))[0])
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in firsts])])
    value, first, size = np.concatenate(values), np.concatenate(firsts), np.concatenate(sizes)
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(first.tolist(), (first + size + length - 1).tolist(), strict=True)]
    name_a, name_b = tb.names_of(texts).T
    doc = np.searchsorted(offsets, first, "right") - 1
    doc_id, place = doc_ids[doc], first - offsets[doc]
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        order = lo + np.lexsort((place[lo:hi], doc_id[lo:hi], name_b[lo:hi], name_a[lo:hi]))
        lead = order[np.flatnonzero(new := bl.groups(name_a[order], name_b[order]))][np.cumsum(new) - 1] if len(order) else order
        behind = (doc_id[order] != doc_id[lead]) | (place[order] != place[lead])
        mine, known = np.sort(order[~behind]), order[behind]
        yield bl.pack_sorted(value[mine]) + size[mine].astype(np.uint8).tobytes() + bl.pack_values(doc_id[mine]) + bl.pack_values(place[mine]) + bl.pack_values(first[mine]) + bl.pack_places(first[known]) + size[known].astype(np.uint8).tobytes() + b"".join([texts[k] for k in mine.tolist()])


def _unpack(buf: bytes, length: int):
    """(value, size, ids, place, first, texts) of the pieces asked about, and (first, size) of those known to be removed."""
    value, at = bl.unpack_sorted(buf)
    n = len(value)
    size = np.frombuffer(buf, np.uint8, n, at).astype(np.int64)
    ids, at = bl.unpack_values(buf, n, at + n)
    place, at = bl.unpack_values(buf, n, at)
    first, at = bl.unpack_values(buf, n, at)
    m = int.from_bytes(buf[at : at + 4], "little")
    known, at = bl.unpack_values(buf, m, at + 4)
    known_size = np.frombuffer(buf, np.uint8, m, at).astype(np.int64)
    ends = at + m + np.cumsum(size + length - 1)
    texts = [buf[a:b] for a, b in zip((ends - size - length + 1).tolist(), ends.tolist(), strict=True)]
    return value, size, ids, place, first, texts, known, known_size


def _ranks(symbols: np.ndarray) -> np.ndarray:
    """Dense ranks of symbols; 0 is the end and ranks first."""
    order = tb.stable_order(symbols)
    out = np.empty(len(symbols), np.uint64)
    new = bl.groups(symbols[order])
    out[order] = np.cumsum(new) - (1 if len(order) and symbols[order[0]] == 0 else 0)
    return out


def shard_transforms(symbols: np.ndarray, sequence: np.ndarray, shard: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of each shard in order, shard after shard, and the symbol before each: their transforms.

    symbols are ranks, the sequences one after the other, each ended by 0; the order is by `deep` symbols.
    """
    n = len(symbols)
    keys, ahead = [], symbols
    last = np.ones(n, bool)
    last[:-1] = sequence[1:] != sequence[:-1]
    for _ in range(deep):
        keys.append(ahead)
        ahead = np.where(last, np.uint64(0), np.append(ahead[1:], np.uint64(0)))
    order = np.arange(n)
    for key in (*keys[::-1], shard.astype(np.uint64)):  # equal suffixes stay in the order of their sequences
        order = order[tb.stable_order(key[order])]
    before = np.zeros(n, np.uint64)
    before[1:] = np.where(sequence[1:] == sequence[:-1], symbols[:-1], np.uint64(0))
    return order, before[order]


def merge_transforms(transforms: np.ndarray, shard: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes (numbered shard after shard, in their shard's order) in the order of their first
    `rounds` symbols, and for each how many of these it has in common with the one before it.

    transforms are the symbols before the suffixes, shard the shard numbers, ascending.
    """
    n = len(shard)
    interleave, common = shard.astype(np.uint64), np.zeros(n, np.int64)
    for done in range(rounds + 1):
        read = tb.stable_order(interleave)  # the k-th of a shard in the interleave is its k-th suffix
        order = np.empty(n, np.int64)
        order[read] = np.arange(n)
        if done == rounds:
            return order, common
        symbols = transforms[order]
        deal = tb.stable_order(symbols)
        interleave, symbols = interleave[deal], symbols[deal]
        # a prefix of one symbol more is common as far as the suffixes after the symbol have one in common
        alike = np.zeros(n, bool)
        alike[1:] = (symbols[1:] == symbols[:-1]) & (symbols[1:] != 0)
        grown = alike.astype(np.int64)
        for depth in range(1, done + 1):
            run = np.cumsum(common < depth)[deal]
            alike[1:] &= run[1:] == run[:-1]
            grown += alike
        common = grown
    raise AssertionError


def repeated_strings(data: np.ndarray, size: np.ndarray, ids: np.ndarray, place: np.ndarray, shard: np.ndarray, length: int, stride: int) -> np.ndarray:
    """For each string of each piece, in order, whether it begins at an earlier place in another or the same piece."""
    begin = np.concatenate([[0], np.cumsum(size + length - 1)])[:-1]
    per = length // stride
    phases = np.minimum(size, stride)
    # one sequence for each piece and phase; as many symbols as its last string needs
    piece = np.repeat(np.arange(len(size)), phases)
    phase = np.arange(len(piece)) - np.repeat(np.cumsum(phases) - phases, phases)
    strings = (size[piece] - 1 - phase) // stride + 1
    count = strings - 1 + per + 1  # with the end
    sequence = np.repeat(np.arange(len(piece)), count)
    step = np.arange(len(sequence)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[piece][sequence] + phase[sequence] + step * stride
    real = step < count[sequence] - 1
    symbols = np.zeros(len(sequence), np.uint64)
    symbols[real] = tb.byte_window_hashes(data, at[real], stride) | np.uint64(1)
    own = shard[piece][sequence]
    suffixes, transforms = shard_transforms(_ranks(symbols), sequence, own, per)
    order, common = merge_transforms(transforms, own[suffixes], per)
    # a repeated interval: suffixes that have the whole length in common, each with the one before it
    interval = np.empty(len(sequence), np.int64)
    interval[suffixes[order]] = np.cumsum(common < per)
    starts = np.flatnonzero(step < strings[sequence])
    where_piece = piece[sequence[starts]]
    offset = phase[sequence[starts]] + step[starts] * stride
    run, doc, pos = interval[starts], ids[where_piece], place[where_piece] + offset
    order = tb.stable_order(run.astype(np.uint64))
    run, doc, pos = run[order], doc[order], pos[order]
    new = bl.groups(run)
    head, group = np.flatnonzero(new), np.cumsum(new) - 1
    first_doc = np.minimum.reduceat(doc, head)[group] if len(head) else doc
    first_pos = np.minimum.reduceat(np.where(doc == first_doc, pos, bl.NO_ID), head)[group] if len(head) else pos
    flat = np.concatenate([[0], np.cumsum(size)])[:-1]
    out = np.zeros(int(size.sum()), bool)
    out[(flat[where_piece] + offset)[order]] = (doc != first_doc) | (pos != first_pos)
    return out


def _judge(payloads: list[bytes], length: int, stride: int) -> list[bytes]:
    """For each payload the runs of strings to be removed: first string and number of strings.

    Of equal pieces of several blocks the earliest goes on, all strings of the others occur earlier.  Where an anchor
    has one text alone, none of its strings occurs twice: equal strings have their anchor at the same place, so two of
    one piece would begin at one place.  The others are merged, each block a shard.
    """
    parts = [_unpack(p, length) for p in payloads]
    value, size, ids, place, first = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:5])
    texts = [t for p in parts for t in p[5]]
    shard = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    a, b = tb.names_of(texts).T
    order = np.lexsort((place, ids, b, a))
    new = bl.groups(a[order], b[order])
    head = order[np.flatnonzero(new)]
    lead = np.empty(len(order), np.int64)
    lead[order] = head[np.cumsum(new) - 1] if len(order) else order
    behind = (ids != ids[lead]) | (place != place[lead])
    alone = np.sort(head)
    _, anchor, several = np.unique(value[alone], return_inverse=True, return_counts=True)
    merged = alone[several[anchor] > 1]
    data = np.frombuffer(b"".join([texts[k] for k in merged.tolist()]), np.uint8)
    flat = np.cumsum(size) - size
    judged = np.zeros(int(size.sum()), bool)
    judged[np.repeat(flat[merged] - (np.cumsum(size[merged]) - size[merged]), size[merged]) + np.arange(int(size[merged].sum()))] = repeated_strings(data, size[merged], ids[merged], place[merged], shard[merged], length, stride)
    # a piece that is no head has its head's answers, and true everywhere if it lies behind it
    piece_of = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(piece_of)) - flat[piece_of]
    gone = judged[flat[lead][piece_of] + within] | behind[piece_of]
    opens = gone.copy()
    opens[1:] &= ~gone[:-1] | (within[1:] == 0)
    at = np.flatnonzero(opens)
    run = np.diff(np.append(np.cumsum(gone)[at] - 1, gone.sum())) if len(at) else np.zeros(0, np.int64)
    start = first[piece_of[at]] + within[at]
    cuts = np.searchsorted(at, np.concatenate([[0], np.cumsum([int(p[1].sum()) for p in parts])]))
    out = []
    for (*_, known, known_size), lo, hi in zip(parts, cuts[:-1], cuts[1:], strict=True):
        places, strings = np.concatenate([start[lo:hi], known]), np.concatenate([run[lo:hi], known_size])
        out.append(bl.pack_places(places) + strings.astype(np.uint8).tobytes())
    return out


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, stride: int = STRIDE, block_bytes: int = BLOCK_BYTES, messages: int = bl.MESSAGES) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts earlier: in a smaller id, or before.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256.  A null text is empty; a null id counts as larger than
    every other; rows with one id are the same place and do not remove each other's bytes.  stride must divide length.
    Grams are told apart by hashes of 64 bits, pieces by 128.
    """
    if length % stride or gram > length or length - gram + 1 > 255:
        raise ValueError("stride must divide length, and length - gram be under 255")
    count = bl.block_count(docs, text_col, block_bytes)
    plan = bl.Plan(count, max(1, (count + 1) // 2), messages)
    split = bl.with_block(docs, id_col, text_col, count)

    def result(table, answers):
        data, offsets = tb.column_bytes(table["text"])
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in answers:
            n = int.from_bytes(a[:4], "little")
            first, at = bl.unpack_values(a, n, 4)
            starts.append(first)
            ends.append(first + np.frombuffer(a, np.uint8, n, at) + (length - 1))
        removed = tb.ranges_to_mask(len(data), np.concatenate(starts), np.concatenate(ends))
        edge = np.zeros(len(removed), bool)
        edge[offsets[:-1][offsets[:-1] < len(removed)]] = True
        opens = removed.copy()
        opens[1:] &= ~removed[:-1] | edge[1:]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        n_removed, n_bytes = total(removed), np.diff(offsets)
        kept = data[~removed].tobytes()
        cuts = np.concatenate([[0], np.cumsum(n_bytes - n_removed)]).tolist()
        hashes = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"doc_id": bl.id_array(bl.ids(table)), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(total(opens), pa.int64()), "kept_sha256": pa.array(hashes, pa.string())})

    first = bl.exchange(split, plan, lambda table, _: _Pieces(table, length, gram).payloads(plan.ranges), _repeated_anchors)
    second = bl.exchange(split, plan, lambda table, answers: _asked(table, answers, length), lambda payloads: _judge(payloads, length, stride), first)
    return bl.finish(split, plan, second, result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
