"""Repeated word windows, by a log-structured fingerprint index.

A window of `window` words repeats only if the least hash of its shingles of `shingle` words does (winnowing), so the index
holds these fingerprints alone: one in about seven of the words. Documents lie in chunks of bounded text by a hash of
doc_id and text, fingerprints in buckets by their leading bits. Each batch adds one immutable run: per bucket a sorted array of
(fingerprint, chunk), one entry for each chunk however often the chunk holds it. While it is written it is merge-joined
with the runs of earlier batches; fingerprints in two chunks are hits. Only windows over hits are then compared across
chunks, by 96 bits of two hashes of all their words (the verification), and repeats inside a chunk are found there. Runs are
compacted level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, delete_dir, list_dirs, path_exists, table, total_bytes, work_path
from .npwords import U, covered, gram_hash, inside, mix, sliding_min, slices, span_hash, text_arrays, words

WINDOW, SHINGLE = 20, 8
CHUNK_BYTES = 8 << 20
#: The query puts its table in as so many batches.
BATCHES = 4
RUN = "kind string, bucket long, chunk long, keys binary, chunks binary"
RUN_ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("chunks", pa.binary())])
RESULT = "doc_id long, gen int, n_words long, n_removed long, kept binary, kept_sha256 string"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("gen", pa.int32()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def top(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n buckets a hash falls in, by its leading 32 bits."""
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows of sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Windows:
    """Hashes of all word windows of consecutive texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, shingle: int, full: bool = True):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.at = words(data, offsets)
        h = span_hash(data, self.starts, self.ends)
        n = len(h) - window + 1
        self.ok = inside(self.at, window, len(h))
        # a minimum of hashes is small; mixed again it spreads over all buckets
        self.key = mix(sliding_min(gram_hash(h, shingle), window - shingle + 1)) if n > 0 else np.zeros(0, U)
        if full:
            self.h = gram_hash(h, window)
            self.g = (gram_hash(h ^ U(0xA5A5A5A55A5A5A5A), window) >> U(32)).astype(np.uint32)

    def text_of_position(self, j: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, j, "right") - 1


class FingerprintIndex:
    """The index below path. n_chunks and n_buckets stay as they are for its life; for_docs() sets them by the first batch."""

    def __init__(self, spark: SparkSession, path: str, n_chunks: int, n_buckets: int, window: int = WINDOW, shingle: int = SHINGLE, fanout: int = 4):
        self.spark, self.path, self.n_chunks, self.n_buckets, self.window, self.shingle, self.fanout = spark, path.rstrip("/"), n_chunks, n_buckets, window, shingle, fanout

    @classmethod
    def for_docs(cls, docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, **more) -> FingerprintIndex:
        n = max(1, -(-total_bytes(docs, "text") // chunk_bytes))
        return cls(docs.sparkSession, path, n, n, **more)

    def chunked(self, docs: DataFrame, gen: int) -> DataFrame:
        d = columns(docs, doc_id="long", text="string")
        return d.select("doc_id", "text", F.lit(gen).alias("gen"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.n_chunks)).alias("chunk"))

    def runs(self) -> list[tuple[int, str]]:
        """(level, folder) of the live runs; L<level>-<first batch>-<last batch>."""
        found = []
        for name in list_dirs(self.spark, self.path):
            level, first, last = (int(x) for x in name[1:].split("-"))
            found.append((level, first, last, name))
        live = [r for r in found if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found)]
        return [(r[0], r[3]) for r in sorted(live, key=lambda r: r[1])]

    def read(self, names: list[str], kind: str) -> DataFrame:
        """Rows of a kind in some runs; a folder of a kind that has none isn't there."""
        found = [f"{self.path}/{n}/kind={kind}" for n in names]
        found = [p for p in found if path_exists(self.spark, p)]
        rows = "bucket long, chunk long, keys binary, chunks binary"
        if not found:
            return self.spark.createDataFrame([], rows)
        return reduce(DataFrame.unionAll, [self.spark.read.schema(rows).parquet(p) for p in found])

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/{name}")

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch as a run, then compacts full levels. Returns (chunk, keys): the fingerprints of it that are in two chunks
        of the index, for every chunk that holds them, also of earlier batches."""
        window, shingle, n_buckets = self.window, self.shingle, self.n_buckets

        def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = text_arrays(b.column("text"))
                chunk = b.column("chunk").to_numpy()
                keys, chunks = [], []
                for i, j in slices(offsets):
                    w = Windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, shingle, full=False)
                    # windows over one fingerprint are neighbours: one of each run of equal ones will do
                    at = np.flatnonzero(w.ok)
                    at = at[groups(w.key[at])]
                    keys.append(w.key[at])
                    chunks.append(chunk[i + w.text_of_position(at)])
                if keys:
                    yield from pack_keys(np.concatenate(keys), np.concatenate(chunks), n_buckets)

        def pack_keys(key: np.ndarray, chunk: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
            bucket = top(key, n)
            order = np.lexsort((key, chunk, bucket))
            key, chunk, bucket = key[order], chunk[order], bucket[order]
            first = groups(bucket, chunk, key)
            key, chunk, bucket = key[first], chunk[first], bucket[first]
            at = np.append(groups(bucket, chunk), len(key))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[at[:-1]]), pa.array(chunk[at[:-1]], pa.int64()), pa.array([key[p:q].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                names=["bucket", "chunk", "keys"],
            )

        def merge(own: pa.Table, past: pa.Table) -> pa.Table:
            bucket = (own if own.num_rows else past).column("bucket")[0].as_py()
            blobs = [np.frombuffer(x, U) for x in own.column("keys").to_pylist()]
            key = np.concatenate([*blobs, np.zeros(0, U)])
            chunk = np.repeat(own.column("chunk").to_numpy(), [len(x) for x in blobs])
            order = np.lexsort((chunk, key))
            key, chunk = key[order], chunk[order]
            first = groups(key, chunk)
            key, chunk = key[first], chunk[first]
            old_key = np.concatenate([*(np.frombuffer(x, U) for x in past.column("keys").to_pylist()), np.zeros(0, U)])
            old_chunk = np.concatenate([*(np.frombuffer(x, np.int64) for x in past.column("chunks").to_pylist()), np.zeros(0, np.int64)])
            if len(old_key):
                # only what this batch holds too can be a hit of it
                at = np.minimum(np.searchsorted(key, old_key), max(len(key) - 1, 0))
                both = key[at] == old_key if len(key) else np.zeros(len(old_key), bool)
                k, c = np.concatenate([key, old_key[both]]), np.concatenate([chunk, old_chunk[both]])
                order = np.lexsort((c, k))
                k, c = k[order], c[order]
                first = groups(k, c)
                k, c = k[first], c[first]
            else:
                k, c = key, chunk
            at = groups(k)
            n = np.diff(at, append=len(k))
            hit = np.repeat(n > 1, n)
            k, c = k[hit], c[hit]
            order = np.argsort(c, kind="stable")
            k, c = k[order], c[order]
            at = np.append(groups(c), len(c))
            rows = [("run", bucket, None, key.tobytes(), chunk.tobytes())] if len(key) else []
            rows += [("hit", bucket, int(c[p]), k[p:q].tobytes(), None) for p, q in zip(at[:-1], at[1:], strict=True)]
            return pa.table([pa.array([r[i] for r in rows], RUN_ARROW.field(i).type) for i in range(5)], schema=RUN_ARROW)

        live = [n for _, n in self.runs()]
        past = self.read(live, "run").select("bucket", "keys", "chunks")
        new = self.chunked(docs, 1).select("text", "chunk").mapInArrow(fingerprints, "bucket long, chunk long, keys binary")
        merged = new.groupBy("bucket").cogroup(past.groupBy("bucket")).applyInArrow(merge, RUN)
        batch = max([int(n.split("-")[2]) for n in live], default=-1) + 1
        name = f"L0-{batch}-{batch}"
        self._write(merged, name)
        hits = self.read([name], "hit").select("chunk", "keys")
        self.compact()
        return hits

    def compact(self) -> None:
        """Merges the runs of each level that holds `fanout` of them into one of the next. The hits that add() found with a run
        stay where they are."""

        def merge(t: pa.Table) -> pa.Table:
            key = np.concatenate([np.frombuffer(x, U) for x in t.column("keys").to_pylist()])
            chunk = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("chunks").to_pylist()])
            order = np.lexsort((chunk, key))
            key, chunk = key[order], chunk[order]
            first = groups(key, chunk)
            return pa.table([["run"], [t.column("bucket")[0].as_py()], [None], [key[first].tobytes()], [chunk[first].tobytes()]], schema=RUN_ARROW)

        level = 0
        while True:
            live = self.runs()
            same = [n for lv, n in live if lv == level]
            if len(same) >= self.fanout:
                merged = self.read(same, "run").groupBy("bucket").applyInArrow(merge, RUN)
                self._write(merged, f"L{level + 1}-{same[0].split('-')[1]}-{same[-1].split('-')[2]}")
                for n in same:
                    delete_dir(self.spark, f"{self.path}/{n}/kind=run")
            elif level >= max([lv for lv, _ in live], default=0):
                return
            level += 1


def _sorted_texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """Generation and doc_id (nulls last), bytes and offsets of a chunk in the order that decides which window is first;
    rows of one doc_id are ordered by text."""
    gen = t.column("gen").to_numpy()
    doc = t.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
    order = np.lexsort((doc, gen))
    if len(np.unique(doc)) < len(doc):
        text = t.column("text").to_pylist()
        order = np.array(sorted(range(len(doc)), key=lambda i: (gen[i], doc[i], text[i] or "")), dtype=np.int64)
    t = t.take(pa.array(order))
    data, offsets = text_arrays(t.column("text"))
    return gen[order], doc[order], data, offsets, t


def _known(blobs: pa.ChunkedArray) -> np.ndarray:
    return np.unique(np.concatenate([*(np.frombuffer(x, U) for x in blobs.to_pylist()), np.zeros(0, U)]))


def _isin(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def _later(h: np.ndarray, g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of windows at ascending places `at`, those whose words are at an earlier of these places too."""
    order = np.lexsort((at, g, h))
    first = np.zeros(len(at), bool)
    first[order[groups(h[order], g[order])]] = True
    return ~first


def dedup_windows(docs: DataFrame, index: FingerprintIndex, history: DataFrame | None = None, with_text: bool = True, batches: int = 1) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space), kept_sha256 for every row of docs, which
    becomes a batch of the index, or several by chunk, which are merge-joined with the runs one after the other.

    A word goes if a window of it has the words of a window that starts earlier: in history (the documents of the index's
    earlier batches), in a smaller doc_id, or before it in the same document. Windows are judged on the input. Null texts
    have no words. A null doc_id counts as the largest; rows of one doc_id are ordered by chunk, then by text, so that of equal
    rows the first stays whole, and one doc_id of very many rows isn't one chunk. Texts with fewer words than a window stay whole."""
    window, shingle, n_buckets = index.window, index.shingle, index.n_buckets
    texts = index.chunked(docs, 1)
    hits = reduce(DataFrame.unionAll, [index.add(texts.filter(F.col("chunk") % batches == i) if batches > 1 else docs) for i in range(batches)])
    if history is not None:
        texts = index.chunked(history, 0).unionAll(texts)

    def candidates(t: pa.Table, hit: pa.Table) -> pa.Table:
        gen, doc, data, offsets, _ = _sorted_texts(t)
        known, found = _known(hit.column("keys")), []
        for i, j in slices(offsets):
            w = Windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, shingle)
            at = np.flatnonzero(w.ok & _isin(w.key, known))
            found.append((w.h[at], w.g[at], i + w.text_of_position(at)))
        h, g, n = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, (U, np.uint32, np.int64)[k]) for k in range(3))
        # the chunk speaks once for equal windows, by the first document that has them
        own = ~_later(h, g, np.arange(len(h)))
        h, g, n = h[own], g[own], n[own]
        order = np.lexsort((n, top(h, n_buckets)))
        h, g, n = h[order], g[order], n[order]
        b = top(h, n_buckets)
        chunk, rows = (t if t.num_rows else hit).column("chunk")[0].as_py(), []
        at = np.append(groups(b), len(b))
        for p, q in zip(at[:-1], at[1:], strict=True):
            ids = groups(n[p:q])
            which = n[p:q][ids]
            rows.append((int(b[p]), chunk, h[p:q].tobytes(), g[p:q].tobytes(), gen[which].astype(np.int8).tobytes(), doc[which].tobytes(), np.diff(ids, append=q - p).astype(np.int32).tobytes()))
        return pa.table([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.binary()) for k in range(7)], names=["bucket", "chunk", "h", "g", "gen", "doc", "n"])

    def losers(t: pa.Table) -> pa.Table:
        parts = {k: [np.frombuffer(x, kind) for x in t.column(k).to_pylist()] for k, kind in (("h", U), ("g", np.uint32), ("gen", np.int8), ("doc", np.int64), ("n", np.int32))}
        h, g = np.concatenate(parts["h"]), np.concatenate(parts["g"])
        n = np.concatenate(parts["n"])
        gen, doc = np.repeat(np.concatenate(parts["gen"]), n), np.repeat(np.concatenate(parts["doc"]), n)
        chunk = np.repeat(t.column("chunk").to_numpy(), [len(x) for x in parts["h"]])
        order = np.lexsort((chunk, doc, gen, g, h))
        h, g, chunk = h[order], g[order], chunk[order]
        lost = np.ones(len(h), bool)
        lost[groups(h, g)] = False
        h, chunk = h[lost], chunk[lost]
        order = np.argsort(chunk, kind="stable")
        h, chunk = h[order], chunk[order]
        at = np.append(groups(chunk), len(chunk))
        return pa.table([pa.array(chunk[at[:-1]], pa.int64()), pa.array([h[p:q].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["chunk", "keys"])

    def remove(t: pa.Table, lost: pa.Table) -> pa.Table:
        gen, doc, data, offsets, t = _sorted_texts(t)
        known = _known(lost.column("keys"))
        parts = []
        for i, j in slices(offsets):
            w = Windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, shingle)
            at = np.flatnonzero(w.ok)
            parts.append((i, j, w, at, w.h[at], w.g[at]))
        later = _later(np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts]), np.arange(sum(len(p[3]) for p in parts))) if parts else np.zeros(0, bool)
        out, base = [], 0
        for i, j, w, at, h, _ in parts:
            gone = later[base : base + len(at)] | _isin(h, known)
            base += len(at)
            out.append(_rows(t.slice(i, j - i), w, covered(at[gone], window, len(w.starts)), with_text))
        return pa.concat_tables(out) if out else RESULT_ARROW.empty_table()

    found = texts.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(candidates, "bucket long, chunk long, h binary, g binary, gen binary, doc binary, n binary")
    lost = found.groupBy("bucket").applyInArrow(losers, "chunk long, keys binary")
    out = texts.groupBy("chunk").cogroup(lost.groupBy("chunk")).applyInArrow(remove, RESULT)
    return out.filter("gen = 1").drop("gen")


def _rows(t: pa.Table, w: Windows, gone: np.ndarray, with_text: bool) -> pa.Table:
    """Results of consecutive texts of whose words `gone` go."""
    import hashlib

    buffer = w.data.copy()
    starts, ends = w.starts[~gone], w.ends[~gone]
    mark = np.zeros(len(buffer) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    keep = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    # the blank byte after a kept word, unless its text ends there
    text_end = w.offsets[np.searchsorted(w.offsets, starts, "right")] if len(starts) else ends
    blank = ends[ends < text_end]
    buffer[blank] = 0x20
    keep[blank] = True
    size = np.concatenate([[0], np.cumsum(keep)])
    at = size[w.offsets]
    body = buffer[keep].tobytes()
    kept = [body[p:q] for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    kept = [k[:-1] if k.endswith(b" ") else k for k in kept]
    n_gone = np.concatenate([[0], np.cumsum(gone)])[w.at]
    return pa.table(
        [t.column("doc_id"), t.column("gen"), pa.array(np.diff(w.at)), pa.array(np.diff(n_gone)), pa.array(kept if with_text else [None] * len(kept), pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
        schema=RESULT_ARROW,
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = FingerprintIndex.for_docs(docs, work_path(spark, "fingerprints"))
    return dedup_windows(docs, index, with_text=False, batches=BATCHES).drop("kept")


OP9_SQL = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM a),
s AS (SELECT *, string_agg(word, ' ') OVER w AS win, count(*) OVER w AS n FROM l
      WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM s WHERE n = 20),
c AS (SELECT l.*, coalesce(bool_or(f.again) OVER (PARTITION BY l.doc_id ORDER BY l.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
      FROM l LEFT JOIN f ON l.doc_id = f.doc_id AND l.pos = f.pos)
SELECT a.doc_id, count(c.word)::BIGINT AS n_words, (count(*) FILTER (WHERE c.gone))::BIGINT AS n_removed,
       sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.pos) FILTER (WHERE NOT c.gone), '')) AS kept_sha256
FROM a LEFT JOIN c ON a.doc_id = c.doc_id GROUP BY a.doc_id
"""
