"""Vectorised work on whole batches of UTF-8 text: word bounds, word hashes, window hashes.

A batch is one byte array with document offsets.  Words are runs of bytes other than
space and 0x09-0x0D; these bytes are ASCII, so they never lie inside a longer UTF-8 character.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash


def _keep_freed_memory(most: int = 64 << 20) -> None:
    """Let the C library hold some freed memory: arrays of some megabytes that come and go cost a page fault a page."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, most)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 2 * most)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library has its own ways
        return


_keep_freed_memory()

#: The separators of words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = _RNG.integers(1, 2**62, size=4, dtype=np.uint64) * np.uint64(4) + np.uint64(3)
_POWERS: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its len+1 offsets; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays([c.cast(pa.large_string()) for c in arr.chunks])
    arr = arr.cast(pa.large_string()).fill_null("")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = arr.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document its range of words (len+1 bounds)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = ~space
    end = start.copy()
    start[1:] &= space[:-1] | edge[1:n]
    end[:-1] &= space[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def _tables(k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For a base and its inverse: powers 0 to 65535, and powers of the power 65536."""
    if k not in _POWERS:
        base = int(_BASES[k])
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = []
            for start in (b, pow(b, 1 << 16, 1 << 64)):
                p = np.full(1 << 16, start, np.uint64)
                p[0] = 1
                steps.append(np.multiply.accumulate(p))
            out.append((steps[0], steps[1]))
        _POWERS[k] = out
    return _POWERS[k]


def _power_run(k: int, n: int) -> np.ndarray:
    """The first n powers of a base."""
    low, high = _tables(k)[0]
    return (high[: (n >> 16) + 1, None] * low).ravel()[:n] if n > 1 << 16 else low[:n]


def _inverse_powers(k: int, at: np.ndarray) -> np.ndarray:
    low, high = _tables(k)[1]
    return high[at >> 16] * low[at & 0xFFFF]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stable_order(keys: np.ndarray) -> np.ndarray:
    """argsort(keys, kind="stable") of uint64 keys.

    The high bits of the keys and their places are sorted in one array, many times faster than an argsort; keys that
    agree in the high bits only are put right after.
    """
    n = len(keys)
    if n < 2:
        return np.arange(n)
    ahead = np.uint64(64 - int(keys.max()).bit_length())
    low = np.uint64((1 << (n - 1).bit_length()) - 1)
    order = (np.sort((keys << ahead) & ~low | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
    there = keys[order]
    return order[np.argsort(there, kind="stable")] if (there[1:] < there[:-1]).any() else order


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of values[s:e] for each range."""
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    weighted = _power_run(k, len(values)) * values
    np.cumsum(weighted, out=total[1:])
    del weighted
    out = total[ends]
    out -= total[starts]
    del total
    out *= _inverse_powers(k, np.asarray(starts, np.int64))
    out += (ends - starts).astype(np.uint64)
    return mix64(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return _ranges(_BYTE_VALUES[which][data], starts, ends, which)


def window_hashes(symbols: np.ndarray, starts: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hashes of symbols[s : s + length] for each s."""
    return _ranges(symbols, starts, starts + length, 2 + which)


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of symbols[s:e] for each pair of bounds."""
    return _ranges(symbols, starts, ends, 2 + which)


def byte_window_hashes(data: np.ndarray, starts: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    return _ranges(_BYTE_VALUES[which][data], starts, starts + length, 2 + which)


def every_byte_window(data: np.ndarray, length: int, which: int = 0, step: int = 1 << 15) -> np.ndarray:
    """byte_window_hashes() of every start, by stretches that stay in the processor's cache."""
    out = np.empty(max(0, len(data) - length + 1), np.uint64)
    powers, inverse = (table[0] for table in _tables(2 + which))
    for at in range(0, len(out), step):
        n = min(step, len(out) - at)
        total = np.zeros(n + length, np.uint64)
        np.cumsum(_BYTE_VALUES[which][data[at : at + n + length - 1]] * powers[: n + length - 1], out=total[1:])
        out[at : at + n] = mix64((total[length:] - total[:n]) * inverse[:n] + np.uint64(length))
    return out


def names_of(pieces: list[bytes]) -> np.ndarray:
    """128 bits for each piece of text, as two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.uint64).reshape(-1, 2)


def window_starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """Indexes at which a window of so many units starts and ends in one document."""
    n = int(bounds[-1]) if len(bounds) else 0
    ok = np.ones(n, bool)
    for k in range(1, length):
        last = bounds[1:] - k
        ok[last[last >= bounds[:-1]]] = False
    return np.flatnonzero(ok)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, each followed by one space, and their bounds in that array."""
    lengths = ends - starts
    new_starts = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1] + 1, out=new_starts[1:])
    total = int(lengths.sum()) + len(starts)
    out = np.full(total, 32, np.uint8)
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1  # a word ends before the next one starts, or where it starts at a document's edge
    # words of two documents may touch: count in and out separately
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool) if len(data) else np.zeros(0, bool)
    keep = np.ones(total, bool)
    keep[new_starts + lengths] = False
    out[keep] = data[inside]
    return out, new_starts, new_starts + lengths


def ranges_to_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True at the indexes that lie in one of the ranges, which may overlap."""
    if n == 0:
        return np.zeros(0, bool)
    change = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(change[:n]) > 0
