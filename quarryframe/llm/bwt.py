"""Burrows-Wheeler transforms of collections of strings, and their merge.

Symbols are bytes with 0 for the end of each string; collections that hold NUL bytes use 16-bit symbols, shifted by one. An
order of suffixes is needed to a depth only: suffixes that agree so far are one block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Transform:
    """Of the suffixes in order: the symbol before each (0 at a string's start), its place in the text, and its first few
    symbols as a number."""

    before: np.ndarray
    places: np.ndarray
    n_strings: int
    heads: np.ndarray


def with_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Concatenated strings that end at `ends`, an end symbol after each."""
    wide = bool(len(data)) and not data.all()
    symbols = data.astype(np.uint16) + np.uint16(1) if wide else data
    return np.insert(symbols, ends, 0)


def transform(text: np.ndarray, depth: int, base: int = 0) -> Transform:
    """The transform of one shard: suffixes sorted to `depth` by doubling. base is added to the places."""
    n = len(text)
    if not n:
        return Transform(text, np.zeros(0, np.int64), 0, np.zeros(0, np.uint64))
    stop = np.flatnonzero(text == 0)
    left = np.repeat(stop, np.diff(stop, prepend=-1)) - np.arange(n)  # symbols before the string's end
    bits = 9 if text.dtype == np.uint16 else 8
    span = 63 // bits
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([text, np.zeros(span, text.dtype)])
    for k in range(span):
        key <<= np.uint64(bits)
        key |= np.where(left >= k, padded[k : n + k], 0).astype(np.uint64)
    heads = key
    while True:
        order = np.argsort(key)
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        if span >= depth or new.all():
            break
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        after = np.zeros(n, np.uint64)
        far = left >= span
        after[far] = rank[np.flatnonzero(far) + span]
        key = rank * np.uint64(n + 1) + after
        span *= 2
    before = np.where(order > 0, text[order - 1], 0).astype(text.dtype)
    return Transform(before, order + base, len(stop), heads[order])


def merge(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray, np.ndarray]:
    """The transform of both, with the block of each suffix (equal to `depth` symbols) and its common prefix with the suffix
    before it (depth where that is longer).

    The interleaving starts in the order of the first few symbols, all of a before all of b where they agree. Reading the symbols before the suffixes in its order and dealing the
    suffixes out by them, stably, makes an order to one symbol more (Holt and McMillan 2014); no suffix is compared again.
    A boundary that appears in round h is a common prefix of h - 1, and stays."""
    n = len(a.before) + len(b.before)
    from_b = np.zeros(n, bool)
    from_b[len(a.before) :] = True
    block = np.zeros(n, np.int32)
    lcp = np.full(n, depth, np.int32)
    n_ends, n_blocks = a.n_strings + b.n_strings, 1
    wide = np.uint16 if np.uint16 in (a.before.dtype, b.before.dtype) else np.uint8
    symbol = np.empty(n, wide)
    heads = np.empty(n, np.uint64)
    known = min(depth, 63 // (9 if wide == np.uint16 else 8)) if a.before.dtype == b.before.dtype else 0
    if known and n:
        # both are in the order of their heads: this much is known without rounds
        from_b[:] = False
        from_b[np.searchsorted(a.heads, b.heads, "right") + np.arange(len(b.heads))] = True
        heads[~from_b], heads[from_b] = a.heads, b.heads
        differ = heads[1:] ^ heads[:-1]
        block[1:] = np.cumsum(differ != 0)
        bits = 9 if wide == np.uint16 else 8
        for k in range(63 // bits - 1, -1, -1):
            # differing in symbol k and in none before it
            first = np.uint64((63 // bits - 1 - k) * bits)
            lcp[1:][(differ >> first != 0) & (lcp[1:] > k)] = k
        lcp[0] = 0
        n_blocks = int(block[-1]) + 1
    for h in range(known + 1, depth + 1):
        symbol[~from_b] = a.before
        symbol[from_b] = b.before
        # strings' starts have the end symbol before them; all ends together are the first block
        dealt, c = _deal(symbol)
        dealt, c = dealt[n_ends:], c[n_ends:]
        was, group = from_b[dealt], block[dealt]
        from_b[:n_ends] = False
        from_b[a.n_strings : n_ends] = True
        from_b[n_ends:] = was
        new = np.zeros(n, bool)
        if n:
            new[0] = True
        if len(c):
            new[n_ends] = True
            new[n_ends + 1 :] = (c[1:] != c[:-1]) | (group[1:] != group[:-1])
        lcp[new & (lcp == depth)] = h - 1
        block = np.cumsum(new, dtype=np.int32) - 1
        now = int(block[-1]) + 1 if n else 0
        if now == n_blocks and h > 1 and now == n:
            break
        n_blocks = now
    symbol[~from_b] = a.before
    symbol[from_b] = b.before
    places = np.empty(n, np.int64)
    places[~from_b], places[from_b] = a.places, b.places
    heads[~from_b], heads[from_b] = a.heads, b.heads
    return Transform(symbol, places, n_ends, heads), block, lcp


def _deal(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their symbols, stably, and the symbols so."""
    if symbol.dtype == np.uint8 and len(symbol) < 1 << 24:
        # symbol and place in one number: sorting these is quicker than a stable sort of places
        both = np.sort((symbol.astype(np.uint32) << np.uint32(24)) | np.arange(len(symbol), dtype=np.uint32))
        return both & np.uint32(0xFFFFFF), (both >> np.uint32(24)).astype(np.uint8)
    order = np.argsort(symbol, kind="stable")
    return order, symbol[order]


def merge_shards(data: np.ndarray, ends: np.ndarray, depth: int, shards: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text with ends, places of its suffixes in order, block of each, common prefix with the one before) of strings: a
    transform for each shard of about equal size, merged one by one."""
    text = with_ends(data, ends)
    stops = np.flatnonzero(text == 0) + 1
    cuts = sorted({0, len(text), *(int(stops[np.searchsorted(stops, len(text) * k // shards)]) for k in range(1, shards) if len(stops))})
    parts = [transform(text[p:q], depth, p) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
    if len(parts) < 2:
        parts = [*parts, transform(text[:0], depth)][:2] if parts else [transform(text, depth), transform(text, depth)]
    whole, block, lcp = merge(parts[0], parts[1], depth)
    for more in parts[2:]:
        whole, block, lcp = merge(whole, more, depth)
    return text, whole.places, block, lcp
