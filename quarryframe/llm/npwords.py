"""Vectorised hashing of words and windows over Arrow string columns.

Hashes are polynomial prefix sums modulo 2**64 over a random table, finished by an avalanche step; every function works on
a slice of consecutive texts, so that memory is bounded by the slice and not by the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
try:
    _malloc_trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _malloc_trim = None
_rng = np.random.Generator(np.random.PCG64(20240607))
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE, WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
#: space and \x09-\x0D
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _inverse(odd: np.uint64) -> np.uint64:
    return U(pow(int(odd), -1, 1 << 64))


class _Powers:
    """base**i and base**-i for i below a size that grows on demand, by steps of STEP: they stay in memory between tasks."""

    STEP = 1 << 18

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            m = -(-n // self.STEP) * self.STEP
            for name, b in (("up", self.base), ("down", _inverse(self.base))):
                x = np.full(m, b, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(BASE), _Powers(WORD_BASE)


def trim() -> None:
    """Gives freed memory back to the system. Workers live on between tasks, and several of them share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and len + 1 offsets into them. Nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` bytes together, or of one longer text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


#: digits, ASCII letters and every byte of other characters
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions in data) of the words of consecutive texts, and len + 1 offsets of texts into them.
    A word is a maximal run of member bytes (by default all but space and \\x09-\\x0D); it never crosses texts."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    is_word = member[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:-1])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    keep = is_word[cuts[:-1]]
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    up, down = _BYTES.get(len(data) + 1)
    s = np.zeros(len(data) + 1, U)
    np.cumsum(TABLE[data] * up[:-1], out=s[1:])
    return mix((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(U))


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for every i; it may cross texts, callers mask that."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _WORDS.get(len(h) + 1)
    s = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[:-1], out=s[1:])
    return mix((s[k:] - s[:-k]) * down[:n] + U(k))


def byte_gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of data[i:i+k] for every i."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _BYTES.get(len(data) + 1)
    s = np.zeros(len(data) + 1, U)
    np.cumsum(TABLE[data] * up[:-1], out=s[1:])
    return mix((s[k:] - s[:-k]) * down[:n] + U(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every i."""
    if len(x) < w:
        return x[:0]
    m, size = x, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[: len(x) - w + 1], m[w - size : w - size + len(x) - w + 1])
    return m


def inside(offsets: np.ndarray, k: int, total: int) -> np.ndarray:
    """Whether positions i .. i+k of a concatenation lie in one text, for every i up to total - k."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    if k > 1:
        mark = np.zeros(n + 1, np.int32)
        cuts = offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < total)])
        lo, hi = np.maximum(cuts - k + 1, 0), np.minimum(cuts, n)
        good = lo < hi
        np.add.at(mark, lo[good], 1)
        np.add.at(mark, hi[good], -1)
        ok = np.cumsum(mark[:-1]) == 0
    return ok


def covered(starts: np.ndarray, k: int, total: int) -> np.ndarray:
    """Marks every position of a concatenation in some [start, start + k); starts ascend."""
    mark = np.zeros(total + 1, np.int32)
    if len(starts):
        np.add.at(mark, starts, 1)
        np.add.at(mark, np.minimum(starts + k, total), -1)
    return np.cumsum(mark[:-1]) > 0
