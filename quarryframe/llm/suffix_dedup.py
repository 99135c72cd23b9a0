"""Byte strings of a given length that repeat across documents, by merged Burrows-Wheeler transforms.

Whole texts lie in chunks of bounded size by a hash of doc_id and text. A string of `length` bytes can repeat only if the least hash of
its pieces of `piece` bytes does; these are compared over all chunks first, 4 bytes each. Stretches of text under a shared
piece go, once for each chunk, to the bucket of the piece. There, stretches that differ are cut into shards, each shard is
transformed, and the transforms are merged by interleaving; the repeated intervals of the merge are the repeated strings, and
the least document of each interval keeps its copy. Stretches that are equal as a whole need no merge. A piece that very many
stretches share has its strings spread over all buckets one by one, by their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import merge_shards
from .common import columns, table, total_bytes
from .npwords import U, byte_gram_hash, inside, mix, sliding_min, slices, span_hash, text_arrays
from .substring_dedup import _isin, _known, groups, top

LENGTH, PIECE = 50, 16
#: A chunk's bytes, and the most of them. Each chunk has something for nearly each bucket, so that what passes between them grows
#: in number as the square of the chunks; so chunks grow before they become more than CHUNKS.
CHUNK_BYTES, MAX_CHUNK_BYTES, CHUNKS = 4 << 20, 16 << 20, 64
#: Stretches under one piece that make it hot, and bytes of stretches that are transformed and merged at a time.
HOT, MERGE_BYTES = 10_000, 1 << 20
#: Bytes that are hashed at a time: eight times as many, and a copy or two, stay in a core's cache.
SLICE = 1 << 17
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])
MASK = U(0xFFFFFFFF)


def packed(raw: bytes) -> bytes:
    """Stretches travel compressed; the shuffle's own codec gains little on them."""
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpacked(blob: pa.Buffer, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(blob, size, asbytes=True) if size else b"", np.uint8)


def name_of(key: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and low half of a hash in 64 bits."""
    return (top(key, n_buckets).astype(U) << U(32)) | (key & MASK)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one least piece in consecutive texts: (its hash, first position, number of strings)."""
    if len(data) < length:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z
    least = sliding_min(byte_gram_hash(data, piece), length - piece + 1)
    at = np.flatnonzero(inside(offsets, length, len(data)))
    if not len(at):
        return least[:0], at, at
    key = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    # a minimum of hashes is small; mixed again it spreads over all buckets
    return mix(key[first]), at[first], np.diff(first, append=len(at))


def _chunk_texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """doc_id (nulls largest), bytes and offsets of a chunk by doc_id, rows of one doc_id by text: always the same order."""
    doc = t.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
    order = np.argsort(doc, kind="stable")
    if len(np.unique(doc)) < len(doc):
        text = t.column("text").to_pylist()
        order = np.array(sorted(range(len(doc)), key=lambda i: (doc[i], text[i] or "")), dtype=np.int64)
    t = t.take(pa.array(order))
    data, offsets = text_arrays(t.column("text"))
    return doc[order], data, offsets, t


def may_share(key: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray, length: int, piece: int) -> np.ndarray:
    """Of different stretches, in order of their piece: those that may share a string with another.

    A string over the piece has at least half of its other bytes on one side of it, so two stretches that share one agree
    on that many bytes left of the piece or right of it. Where a piece isn't found just once in each of its stretches,
    all of them are let through."""
    more = -(-(length - piece) // 2)
    keep = np.zeros(len(key), bool)
    sides, alone = [], np.ones(len(key), bool)
    bounds = np.append(0, np.cumsum(size))
    for i, j in slices(bounds, SLICE):
        n = size[i:j]
        ends = np.cumsum(n)
        part = data[np.repeat(start[i:j] - (ends - n), n) + np.arange(ends[-1])]
        at = ends - n
        h = byte_gram_hash(part, piece)
        h = np.append(h, np.full(len(part) - len(h), ~U(0)))
        inner = np.ones(len(part), bool)  # no piece across stretches
        for k in range(1, piece):
            inner[ends - k] = False
        h[~inner] = ~U(0)
        owner = np.repeat(np.arange(j - i), n)
        # the piece is the least one of the last string and of the first, so in what they have in common
        first, last = n - length, np.minimum(length - piece, n - piece)
        common = (np.arange(len(part)) - at[owner] >= first[owner]) & (np.arange(len(part)) - at[owner] <= last[owner])
        least = np.minimum.reduceat(np.where(common, h, ~U(0)), at)
        found = np.flatnonzero(h == least[owner])
        once = np.bincount(owner[found], minlength=j - i) == 1
        place = np.zeros(j - i, np.int64)
        place[owner[found]] = found
        alone[i:j] = once & (n < 2 * length - piece + 1)
        left, right = once & (place - more >= at), once & (place + piece + more <= ends)
        for side, ok, lo, hi in ((0, left, place - more, place + piece), (1, right, place, place + piece + more)):
            who = np.flatnonzero(ok)
            sides.append((i + who, np.full(len(who), side), span_hash(part, lo[who], hi[who])))
    who, side, h = (np.concatenate([x[k] for x in sides]) for k in range(3))
    order = np.lexsort((h, side, key[who]))
    g = groups(key[who][order], side[order], h[order])
    keep[who[order][np.repeat(np.diff(g, append=len(order)) > 1, np.diff(g, append=len(order)))]] = True
    at = groups(key)
    return keep | np.repeat(~np.logical_and.reduceat(alone, at), np.diff(at, append=len(key)))


def taken(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of data one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def shared_runs(key: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of different stretches (their piece and document), the runs of strings whose hash occurs under the piece in two
    documents, as (stretch, first string, number of strings). No other string is repeated; whether these are is left to a merge."""
    bounds = np.append(0, np.cumsum(size))
    n = size - length + 1
    hashes = [np.zeros(0, U)]
    for i, j in slices(bounds, SLICE):
        part, o = taken(data, start[i:j], size[i:j]), bounds[i : j + 1] - bounds[i]
        hashes.append(byte_gram_hash(part, length)[inside(o, length, len(part))])
    owner = np.repeat(np.arange(len(key)), n)
    h = mix(np.concatenate(hashes) ^ mix(key[owner].astype(U)))
    order = np.argsort(h)
    at = groups(h[order])
    held = doc[owner[order]]
    two = np.minimum.reduceat(held, at) != np.maximum.reduceat(held, at)
    use = np.zeros(len(h), bool)
    use[order] = np.repeat(two, np.diff(at, append=len(h)))
    p = np.flatnonzero(use)
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1] + 1) | (owner[p[1:]] != owner[p[:-1]])
    f = np.flatnonzero(new)
    who = owner[p[f]]
    return who, p[f] - (np.cumsum(n) - n)[who], np.diff(f, append=len(p))


def lost_strings(key: np.ndarray, doc: np.ndarray, size: np.ndarray, data: np.ndarray, length: int, piece: int, shards: int = 2, merge_bytes: int = MERGE_BYTES, cut_down: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches (their piece, document, number of bytes; data holds them one after the other): runs of strings that are in
    a smaller document too, as (stretch, first string, number of strings).

    Stretches that are equal as a whole are settled first. Of the others only the runs of strings that may be shared are left,
    and these in the same way (now they are cut_down): many are equal, though their stretches aren't. What differs then is merged."""
    none = np.zeros(0, np.int64)
    if not len(key):
        return none, none, none
    start = np.cumsum(size) - size
    bounds = np.append(start, start[-1] + size[-1])
    same = np.concatenate([span_hash(data[bounds[i] : bounds[j]], start[i:j] - bounds[i], bounds[i + 1 : j + 1] - bounds[i]) for i, j in slices(bounds, SLICE)])
    order = np.lexsort((doc, size, same, key))
    first = groups(key[order], same[order], size[order])
    group = np.empty(len(key), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
    head = order[first]  # of each different stretch, one of the least document
    least = doc[head]
    later = doc > least[group]
    # pieces with more than one different stretch
    g_key = key[head]
    at = groups(g_key)
    many = np.diff(at, append=len(g_key))
    busy = np.flatnonzero(np.repeat(many > 1, many))
    if len(busy) and not cut_down:
        busy = busy[may_share(g_key[busy], start[head[busy]], size[head[busy]], data, length, piece)]
    out = [(np.flatnonzero(later), np.zeros(int(later.sum()), np.int64), size[later] - length + 1)]
    found = []
    if len(busy) and not cut_down:
        h = head[busy]
        who, run_at, run_n = shared_runs(g_key[busy], least[busy], start[h], size[h], data, length)
        who, run_size = busy[who], run_n + length - 1
        part, at, n = lost_strings(g_key[who], least[who], run_size, taken(data, start[head[who]] + run_at, run_size), length, piece, shards, merge_bytes, True)
        found.append((who[part], run_at[part] + at, n))
    elif len(busy):
        bytes_to = np.cumsum(size[head[busy]])
        edge = groups(g_key[busy])  # a piece's stretches stay together
        cut, base = [0], 0
        for e in [*edge[1:].tolist(), len(busy)]:
            if bytes_to[e - 1] - base >= merge_bytes:
                cut.append(e)
                base = bytes_to[e - 1]
        if cut[-1] != len(busy):
            cut.append(len(busy))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            g = busy[lo:hi]
            n = size[head[g]]
            ends = np.cumsum(n)
            text, places, block, _ = merge_shards(taken(data, start[head[g]], n), ends, length, shards)
            # of each place of the text with ends: its stretch, and whether a whole string starts there
            owner = np.repeat(np.arange(len(g)), n + 1)
            offset = np.arange(len(text)) - np.repeat(ends - n + np.arange(len(g)), n + 1)
            whole = offset <= (n - length)[owner]
            owned = np.where(whole, least[g][owner], np.iinfo(np.int64).max)[places]
            smallest = np.minimum.reduceat(owned, groups(block))[block]
            lost = np.zeros(len(text) + 1, bool)
            lost[places] = smallest < owned
            lost[:-1] &= whole
            lost = lost[:-1]
            p = np.flatnonzero(lost)
            if not len(p):
                continue
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1] + 1) | (owner[p[1:]] != owner[p[:-1]])
            f = np.flatnonzero(new)
            found.append((g[owner[p[f]]], offset[p[f]], np.diff(f, append=len(p))))
    # least-document members of each different stretch, to which its result applies
    member = np.flatnonzero(~later)
    member = member[np.argsort(group[member], kind="stable")]
    for run_g, run_at, run_n in found:
        a, z = np.searchsorted(group[member], run_g), np.searchsorted(group[member], run_g, "right")
        times = z - a
        who = member[np.repeat(a - np.cumsum(times) + times, times) + np.arange(times.sum())]
        out.append((who, np.repeat(run_at, times), np.repeat(run_n, times)))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def chunk_size(total: int) -> int:
    return min(MAX_CHUNK_BYTES, max(CHUNK_BYTES, -(-total // CHUNKS)))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, chunk_bytes: int | None = None, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes), kept_sha256 for every row of docs.

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller doc_id. Strings are judged
    on the input and never cross documents. Null texts are empty. A null doc_id counts as the largest. Rows of one doc_id
    aren't smaller than each other: both stay as to each other. Texts shorter than length stay whole."""
    d = columns(docs, doc_id="long", text="string")
    total = total_bytes(d, "text")
    n_chunks = n_buckets = max(1, -(-total // (chunk_bytes or chunk_size(total))))
    # by the text too, so that one doc_id of very many rows, or null, isn't one chunk
    texts = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_arrays(b.column("text"))
            chunk = b.column("chunk").to_numpy()
            found = []
            for i, j in slices(offsets, SLICE):
                o = offsets[i : j + 1] - offsets[i]
                key, at, _ = stretches(data[offsets[i] : offsets[j]], o, length, piece)
                found.append((name_of(key, n_buckets), chunk[i + np.searchsorted(o, at, "right") - 1]))
            if not found:
                continue
            name, chunk = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            order = np.lexsort((name, chunk))
            name, chunk = name[order], chunk[order]
            first = groups(chunk, name)
            n = np.minimum(np.diff(first, append=len(name)), 255).astype(np.uint8)
            name, chunk = name[first], chunk[first]
            at = np.append(groups(chunk, name >> U(32)), len(name))
            low = name.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array((name[at[:-1]] >> U(32)).astype(np.int64)), pa.array(chunk[at[:-1]], pa.int64())]
                + [pa.array([x[p:q].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in (low, n)],
                names=["bucket", "chunk", "keys", "n"],
            )

    def shared(t: pa.Table) -> pa.Table:
        """Pieces in two chunks, for each that has them; hot ones are marked."""
        blobs = [np.frombuffer(x, np.uint32) for x in t.column("keys").to_pylist()]
        key, n = np.concatenate(blobs), np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("n").to_pylist()])
        chunk = np.repeat(t.column("chunk").to_numpy(), [len(x) for x in blobs])
        order = np.lexsort((chunk, key))
        key, chunk, n = key[order], chunk[order], n[order]
        at = groups(key)
        size = np.diff(at, append=len(key))
        total = np.add.reduceat(n.astype(np.int64), at) if len(at) else size
        first = chunk[at] if len(at) else chunk
        last = chunk[at + size - 1] if len(at) else chunk
        use = np.repeat((first != last) | (total > hot), size)
        is_hot = np.repeat(total > hot, size)[use]
        key, chunk = key[use], chunk[use]
        pair = groups(*(x for x in (key, chunk))) if len(key) else np.zeros(0, np.int64)
        key, chunk, is_hot = key[pair], chunk[pair], is_hot[pair]
        order = np.argsort(chunk, kind="stable")
        key, chunk, is_hot = key[order], chunk[order], is_hot[order]
        at = np.append(groups(chunk), len(chunk))
        name = (U(t.column("bucket")[0].as_py()) << U(32)) | key.astype(U)
        rows = [(int(chunk[p]), name[p:q].tobytes(), name[p:q][is_hot[p:q]].tobytes()) for p, q in zip(at[:-1], at[1:], strict=True)]
        return pa.table([pa.array([r[k] for r in rows], pa.binary() if k else pa.int64()) for k in range(3)], names=["chunk", "keys", "hot"])

    def candidates(t: pa.Table, hit: pa.Table) -> pa.Table:
        doc, data, offsets, _ = _chunk_texts(t)
        known, hot_keys = _known(hit.column("keys")), _known(hit.column("hot"))
        found = []
        for i, j in slices(offsets, SLICE):
            lo, o = int(offsets[i]), offsets[i : j + 1] - offsets[i]
            part = data[lo : offsets[j]]
            key, at, n = stretches(part, o, length, piece)
            name = name_of(key, n_buckets)
            is_hot = _isin(name, hot_keys)
            if is_hot.any():
                # each string by itself, under its own hash
                times = n[is_hot]
                single = np.repeat(at[is_hot] - np.cumsum(times) + times, times) + np.arange(times.sum())
                own = name_of(byte_gram_hash(part, length)[single], n_buckets)
                name, at, n = np.concatenate([name[~is_hot], own]), np.concatenate([at[~is_hot], single]), np.concatenate([n[~is_hot], np.ones(len(single), np.int64)])
                must = np.concatenate([np.zeros(int((~is_hot).sum()), bool), np.ones(len(single), bool)])
            else:
                must = np.zeros(len(name), bool)
            found.append((name, lo + at, n, i + np.searchsorted(o, at, "right") - 1, span_hash(part, at, at + n + length - 1), must))
        name, at, n, ordinal, same, must = (np.concatenate([f[k] for f in found]) for k in range(6))
        own_doc = doc[ordinal]
        # pieces in other chunks, or in two documents of this one
        order = np.lexsort((own_doc, name))
        g = groups(name[order])
        size = np.diff(g, append=len(order))
        differ = own_doc[order][g] != own_doc[order][g + size - 1] if len(g) else np.zeros(0, bool)
        use = np.zeros(len(name), bool)
        use[order] = np.repeat(differ, size)
        use |= must | _isin(name, known)
        name, at, n, ordinal, same, own_doc = (x[use] for x in (name, at, n, ordinal, same, own_doc))
        # equal stretches of the chunk: later documents lose them here
        order = np.lexsort((own_doc, n, same, name))
        name, at, n, ordinal, same, own_doc = (x[order] for x in (name, at, n, ordinal, same, own_doc))
        g = groups(name, same, n)
        later = own_doc > np.repeat(own_doc[g], np.diff(g, append=len(name)))
        place = (at - offsets[ordinal]).astype(np.int32)
        lost = [x[later].astype(np.int32).tobytes() for x in (ordinal, place, n)]
        name, at, n, ordinal, own_doc, place = (x[~later] for x in (name, at, n, ordinal, own_doc, place))
        bucket, size = (name >> U(32)).astype(np.int64), n + length - 1
        cut = np.append(groups(bucket), len(bucket))
        chunk, rows = (t if t.num_rows else hit).column("chunk")[0].as_py(), []
        for p, q in zip(cut[:-1], cut[1:], strict=True):
            ends = np.cumsum(size[p:q])
            pick = np.repeat(at[p:q] - ends + size[p:q], size[p:q]) + np.arange(ends[-1])
            rows.append((int(bucket[p]), chunk, name[p:q].astype(np.uint32).tobytes(), own_doc[p:q].tobytes(), ordinal[p:q].astype(np.int32).tobytes(), place[p:q].tobytes(), size[p:q].astype(np.int32).tobytes(), packed(data[pick].tobytes()), b"", b"", b""))
        if len(lost[0]):
            rows.append((chunk % n_buckets, chunk, b"", b"", b"", b"", b"", b"", *lost))
        return pa.table([pa.array([r[k] for r in rows], pa.binary() if k > 1 else pa.int64()) for k in range(11)], names=["bucket", "chunk", "key", "doc", "ordinal", "place", "size", "data", "l_ordinal", "l_place", "l_n"])

    def losers(t: pa.Table) -> pa.Table:
        part = {k: [np.frombuffer(x, kind) for x in t.column(k).to_pylist()] for k, kind in (("key", np.uint32), ("doc", np.int64), ("ordinal", np.int32), ("place", np.int32), ("size", np.int32), ("l_ordinal", np.int32), ("l_place", np.int32), ("l_n", np.int32))}
        part["data"] = [unpacked(x.as_buffer(), int(n.sum())) for x, n in zip(t.column("data"), part["size"], strict=True)]
        key, doc, ordinal, place, size, data = (np.concatenate(part[k]) for k in ("key", "doc", "ordinal", "place", "size", "data"))
        chunk = np.repeat(t.column("chunk").to_numpy(), [len(x) for x in part["key"]])
        who, first, n = lost_strings(key, doc, size.astype(np.int64), data, length, piece)
        ordinal = np.concatenate([ordinal[who], *part["l_ordinal"]])
        place = np.concatenate([(place[who] + first).astype(np.int32), *part["l_place"]])
        n = np.concatenate([n.astype(np.int32), *part["l_n"]])
        chunk = np.concatenate([chunk[who], np.repeat(t.column("chunk").to_numpy(), [len(x) for x in part["l_n"]])])
        order = np.argsort(chunk, kind="stable")
        ordinal, place, n, chunk = ordinal[order], place[order], n[order], chunk[order]
        at = np.append(groups(chunk), len(chunk))
        return pa.table([pa.array(chunk[at[:-1]], pa.int64())] + [pa.array([x[p:q].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in (ordinal, place, n)], names=["chunk", "ordinal", "place", "n"])

    def remove(t: pa.Table, lost: pa.Table) -> pa.Table:
        _, data, offsets, t = _chunk_texts(t)
        ordinal, place, n = (np.concatenate([*(np.frombuffer(x, np.int32) for x in lost.column(k).to_pylist()), np.zeros(0, np.int32)]).astype(np.int64) for k in ("ordinal", "place", "n"))
        order = np.argsort(ordinal, kind="stable")
        ordinal, place, n = ordinal[order], place[order], n[order]
        removed, runs, kept = [], [], []
        for i, j in slices(offsets, CHUNK_BYTES):
            o, part = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
            p, q = np.searchsorted(ordinal, [i, j])
            start = o[ordinal[p:q] - i] + place[p:q]
            mark = np.bincount(start, minlength=len(part) + 1)[: len(part) + 1] - np.bincount(start + n[p:q] + length - 1, minlength=len(part) + 1)[: len(part) + 1]
            gone = np.cumsum(mark[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])[o]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = o[:-1][o[:-1] < len(part)]
            begins[inner] = gone[inner]
            body = part[~gone].tobytes()
            at = (o - total).tolist()
            kept += [body[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
            removed.append(np.diff(total))
            runs.append(np.diff(np.concatenate([[0], np.cumsum(begins)])[o]))
        none = np.zeros(0, np.int64)
        return pa.table(
            [t.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.concatenate([none, *removed]), pa.int64()), pa.array(np.concatenate([none, *runs]), pa.int64()), pa.array(kept if with_text else [None] * len(kept), pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
            schema=RESULT_ARROW,
        )

    hits = texts.select("text", "chunk").mapInArrow(pieces, "bucket long, chunk long, keys binary, n binary").groupBy("bucket").applyInArrow(shared, "chunk long, keys binary, hot binary")
    row = "bucket long, chunk long, key binary, doc binary, ordinal binary, place binary, size binary, data binary, l_ordinal binary, l_place binary, l_n binary"
    found = texts.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(candidates, row)
    lost = found.groupBy("bucket").applyInArrow(losers, "chunk long, ordinal binary, place binary, n binary")
    return texts.groupBy("chunk").cogroup(lost.groupBy("chunk")).applyInArrow(remove, RESULT)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(h) // 2 + 1)) AS pos, unnest(list_transform(range(0, len(h) // 2), lambda i: substr(h, 2 * i + 1, 100))) AS w FROM d),
f AS (SELECT doc_id, pos, substr(w, 1, 2) AS b, len(w) = 100 AND min(doc_id) OVER (PARTITION BY w) < doc_id AS again FROM s),
c AS (SELECT doc_id, pos, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM c)
SELECT d.doc_id, (any_value(len(d.h)) // 2)::BIGINT AS n_bytes, (count(*) FILTER (WHERE g.gone))::BIGINT AS n_removed, (count(*) FILTER (WHERE g.begins))::BIGINT AS n_spans,
       sha256(unhex(coalesce(string_agg(g.b, '' ORDER BY g.pos) FILTER (WHERE NOT g.gone), ''))) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id
"""
