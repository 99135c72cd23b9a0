"""Approximate nearest neighbours by multiprobe p-stable hashing.

The largest inner product is the least Euclidean distance once every vector is scaled by the largest norm and given one more
coordinate that fills it up to norm 1 (Bachrach et al. 2014). Each table hashes with a few p-stable functions
floor((a.x + b) / w) (Datar et al. 2004), whose directions are orthogonal to each other over the tables, so that no table
repeats what another one sees. A query visits its bucket and perturbed ones in the order of their estimated success for the
rows they hold (after Lv et al. 2007): what a true neighbour's slot in each function is like, given the query's projection,
against what any row's is like. Both are measured on a bounded sample, and so is how far down this order to go. All rows in
visited buckets are scored exactly; a query that finds fewer than k is searched against all rows, in blocks.

Rows lie in parts by table and by the slots of the table's first functions; a part with too many rows is split by bucket,
and a bucket with too many by row. A query is sent to the parts of its own buckets only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored
from .npwords import U, mix
from .substring_dedup import groups, top

MULTIPLY = U(0xD1342543DE82EF95)


@dataclass(frozen=True)
class Settings:
    """sample_rows bounds the sample that the index is fitted on; it is chosen by a hash of vec_id. All rows are hashed, however
    few. A bucket of over bucket_rows rows is split, and its queries visit all parts of it."""

    tables: int = 6
    width: float = 2.0
    recall: float = 0.93
    sample_rows: int = 20_000
    sample_queries: int = 192
    max_probes: int = 8_192
    bucket_rows: int = 8_192
    part_rows: int = 16_384
    exact_block: int = 2_048
    tail: float = 0.05


@dataclass(frozen=True)
class Model:
    """What the sample says: the number of functions; of those whose slots part rows, `prefix`; for each function the slots
    from `low` to `high` that are told apart, the outermost taking all beyond. A neighbour's projection is about `slope` times
    the query's, with deviation `spread`; log_rows has the logarithm of the share of rows in each slot of each function, and
    buckets from `least` on in the sum of log ratios are visited."""

    functions: int
    prefix: int
    low: np.ndarray
    high: np.ndarray
    slope: float
    spread: float
    log_rows: np.ndarray
    least: float

    def clip(self, slot: np.ndarray) -> np.ndarray:
        return np.clip(slot, self.low, self.high)


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function (Abramowitz and Stegun 7.1.26, 1.5e-7)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x) / 2
    return np.where(z > 0, 1 - tail, tail)


class Hashes:
    """The functions of all tables for vectors of `dim` coordinates."""

    def __init__(self, dim: int, functions: int, s: Settings):
        rng = np.random.Generator(np.random.PCG64(11))
        self.functions, self.s, n = functions, s, s.tables * functions
        blocks = [np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0] * np.sqrt(dim + 1) for _ in range(-(-n // (dim + 1)))]
        self.a = np.concatenate(blocks, 1)[:, :n]
        self.b = rng.uniform(0, s.width, n)

    def project(self, x: np.ndarray) -> np.ndarray:
        """(n, tables * functions)."""
        return x @ self.a

    def slots(self, p: np.ndarray) -> np.ndarray:
        return np.floor((p + self.b) / self.s.width).astype(np.int64)

    def cells(self, slot: np.ndarray, functions: int | None = None) -> np.ndarray:
        """64-bit names (n, tables) of buckets, by the first `functions` slots in each table."""
        slot = slot.reshape(len(slot), self.s.tables, self.functions)
        h = np.broadcast_to(mix(np.arange(1, self.s.tables + 1, dtype=U)), slot.shape[:2]).copy()
        for f in range(self.functions if functions is None else functions):
            h = mix(h * MULTIPLY + (slot[:, :, f] + (1 << 40)).astype(U))
        return h

    def ratios(self, p: np.ndarray, m: Model) -> np.ndarray:
        """(queries, tables * functions, slots): log of how much likelier a neighbour is in a slot than any row."""
        n_slots = m.log_rows.shape[1]
        at = m.low[:, None] + np.arange(n_slots + 1)
        edges = at * self.s.width - self.b[:, None]
        edges[:, 0], edges[at > m.high[:, None]] = -np.inf, np.inf
        z = (edges[None] - m.slope * p[:, :, None]) / m.spread
        out = np.log(np.maximum(np.diff(_normal(z), axis=2), 1e-6)) - m.log_rows[None]
        out[:, at[:, :-1] > m.high[:, None]] = -np.inf
        return out

    def probes(self, ratio: np.ndarray, own: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """(cells, prefixes) that one query visits, its own bucket first in each table, then the others from the likeliest on.
        ratio has the query's log ratios, own its slots."""
        cells, prefixes = [], []
        for t in range(self.s.tables):
            r = ratio[t * self.functions : (t + 1) * self.functions]
            rest = np.append(np.cumsum(r.max(1)[::-1])[::-1][1:], 0)
            total, h, head = np.zeros(1), mix(np.array([t + 1], U)), mix(np.array([t + 1], U))
            for f in range(self.functions):
                # what can't reach the least sum any more goes at once
                score = total[:, None] + r[f][None, :]
                i, j = np.nonzero(score + rest[f] >= m.least)
                total, h = score[i, j], mix(h[i] * MULTIPLY + (m.low[t * self.functions + f] + j + (1 << 40)).astype(U))
                head = head[i] if f >= m.prefix else h
                if len(total) > 4 * self.s.max_probes:
                    best = np.argpartition(-total, 4 * self.s.max_probes)[: 4 * self.s.max_probes]
                    total, h, head = total[best], h[best], head[best]
            order = np.argsort(-total, kind="stable")[: self.s.max_probes]
            cells.append(h[order])
            prefixes.append(head[order])
        mine = m.clip(own[None, :])
        cells.append(self.cells(mine)[0])
        prefixes.append(self.cells(mine, m.prefix)[0])
        cell, prefix = np.concatenate(cells), np.concatenate(prefixes)
        _, first = np.unique(cell, return_index=True)
        first.sort()
        return cell[first], prefix[first]


def augment(x: np.ndarray, largest: float) -> np.ndarray:
    x = x / largest
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])


def augment_query(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x / np.sqrt((x * x).sum(1))[:, None], np.zeros(len(x))])


def _top(score: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(-score, 1, kind="stable")[:, :k]


def tune(x: np.ndarray, largest: float, n_rows: int, k: int, s: Settings) -> Model:
    """The model with which a sample finds the wanted share of its neighbours and visits the fewest rows for them. Neighbours in
    a sample are further away than in all rows, so this is on the safe side."""
    every = max(1, len(x) // s.sample_queries)
    q = np.arange(0, len(x), every)[: s.sample_queries]
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -np.inf
    true = _top(score, min(k, max(len(x) - 1, 1)))
    finest = int(min(20, max(2, round(math.log(max(n_rows, 16) / 4) / math.log(2.6)))))
    prefix = max(0, math.ceil(math.log(max(1.0, n_rows / s.part_rows)) / math.log(2)))
    best: tuple[float, Model] | None = None
    for functions in range(finest, max(1, finest - 5), -2):
        h = Hashes(x.shape[1], functions, s)
        p, pq = h.project(augment(x, largest)), h.project(augment_query(x[q]))
        slot = h.slots(p)
        # tails are slots with their neighbour: buckets of tails in several functions would be many, and empty
        low, high = (np.quantile(slot, t, 0, method="nearest").astype(np.int64) for t in (s.tail, 1 - s.tail))
        slot, n_slots = np.clip(slot, low, high), int((high - low).max()) + 1
        near = p[true]
        slope = float((near * pq[:, None, :]).sum() / max((pq * pq).sum() * true.shape[1], 1e-12))
        spread = float(max(np.sqrt(np.mean((near - slope * pq[:, None, :]) ** 2)), 0.05))
        rows = np.stack([np.bincount(slot[:, f] - low[f], minlength=n_slots) for f in range(slot.shape[1])])
        m = Model(functions, min(prefix, functions), low, high, slope, spread, np.log((rows + 0.5) / (len(x) + 0.5 * n_slots)), 0.0)
        ratios, most = h.ratios(pq, m), np.full(score.shape, -np.inf)
        for t in range(s.tables):
            total = np.zeros(score.shape)
            for f in range(t * functions, (t + 1) * functions):
                total += ratios[:, f][:, slot[:, f] - low[f]]
            np.maximum(most, total, out=most)
        found = np.take_along_axis(most, true, 1).ravel()
        least = float(np.sort(found)[int((1 - s.recall) * len(found))])
        share = float((most >= least).mean())
        if best is None or share < best[0]:
            best = share, replace(m, least=least - 1e-9)
    return best[1]


MODEL = "functions int, prefix int, low binary, high binary, slope double, spread double, log_rows binary, least double"
MODEL_ARROW = pa.schema([("functions", pa.int32()), ("prefix", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("slope", pa.float64()), ("spread", pa.float64()), ("log_rows", pa.binary()), ("least", pa.float64())])
FOUND = "query_id long, vec_id long, score double"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(col: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), dim) if len(col) else np.zeros((0, dim), kind)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, settings: Settings = Settings(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors with the largest inner product (in double precision) found for each
    row of queries, nearest first, ties to the smaller vec_id; all candidates if there are fewer than k.

    A query's own vec_id is never an answer. Vectors that are null, zero, of other than the most frequent length, or that
    hold null or non-finite components take no part, on either side; nor do null ids. Of rows that repeat a vec_id the best
    is returned once. An empty table gives no rows."""
    s, spark = settings, vectors.sparkSession

    def clean(df: DataFrame) -> tuple[DataFrame, str]:
        names = df.columns
        element = df.schema.fields[names.index(vector_column)].dataType.elementType.typeName()
        kind = "float" if element == "float" else "double"
        safe = df.toDF(*[f"c{i}" for i in range(len(names))])
        d = safe.select(F.col(f"c{names.index(id_column)}").cast("long").alias("id"), F.col(f"c{names.index(vector_column)}").cast(f"array<{kind}>").alias("v"))
        whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return d.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & whole & F.exists("v", lambda x: x != 0)), kind

    rows, kind = clean(vectors)
    asked, _ = clean(queries)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm"))
    first = dims.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not first:
        return empty
    dim, n_rows, largest = first[0].dim, first[0].n, float(np.sqrt(first[0].norm)) * (1 + 1e-9)
    rows, asked = rows.filter(F.size("v") == dim), asked.filter(F.size("v") == dim).select("id", F.col("v").cast(f"array<{kind}>").alias("v"))
    code = "<f4" if kind == "float" else "<f8"

    def matrix_of(b: pa.RecordBatch | pa.Table) -> np.ndarray:
        v = b.column("v")
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        return v.flatten().to_numpy(zero_copy_only=False).astype(code).reshape(len(b), dim)

    # a bounded sample, by hash of the id
    share = min(1.0, s.sample_rows / max(n_rows, 1))
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)) if share < 1 else rows

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        m = tune(matrix_of(t).astype(float), largest, n_rows, k, s)
        return pa.table([[m.functions], [m.prefix], [m.low.tobytes()], [m.high.tobytes()], [m.slope], [m.spread], [m.log_rows.astype(np.float64).tobytes()], [m.least]], schema=MODEL_ARROW)

    found = sample.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(fit, MODEL).collect()
    if not found:  # so few rows that none was sampled
        found = rows.withColumn("task", F.lit(0)).limit(s.sample_rows).groupBy("task").applyInArrow(fit, MODEL).collect()
    r = found[0]
    m = Model(r.functions, r.prefix, np.frombuffer(r.low, np.int64), np.frombuffer(r.high, np.int64), r.slope, r.spread, np.frombuffer(r.log_rows).reshape(s.tables * r.functions, -1), r.least)
    cap = s.bucket_rows

    def hashed(h: Hashes, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, prefixes) of rows."""
        slot = m.clip(h.slots(h.project(augment(x, largest))))
        return h.cells(slot), h.cells(slot, m.prefix)

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hashes(dim, m.functions, s)
        for b in batches:
            c, p = hashed(h, matrix_of(b).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(v.ravel().astype(np.int64)) for v in (p, c)], names=["prefix", "cell"])

    counted = stored(rows.mapInArrow(cells_of, "prefix long, cell long").groupBy("prefix", "cell").agg(F.count("*").alias("n")), "buckets")
    # at most tables * n_rows / cap buckets, and tables * n_rows / part_rows prefixes, are that large
    hot = {x.cell: -(-x.n // cap) for x in counted.filter(F.col("n") > cap).collect()}
    wide = {x.prefix: -(-x.n // s.part_rows) for x in counted.groupBy("prefix").agg(F.sum("n").alias("n")).filter(F.col("n") > s.part_rows).collect()}
    parts = max(1, -(-n_rows * s.tables // s.part_rows)) * 2
    sent = spark.sparkContext.broadcast([(np.array(sorted(v), np.int64), np.array([v[c] for c in sorted(v)], np.int64)) for v in (hot, wide)])

    def splits(which: int, key: np.ndarray) -> np.ndarray:
        keys, n = sent.value[which]
        if not len(keys):
            return np.ones(len(key), np.int64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, n[at], 1)

    def place(cell: np.ndarray, prefix: np.ndarray, times: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The parts of buckets: by prefix, those of a wide prefix by bucket, and hot ones by salt."""
        by = np.where(times > 1, cell.astype(U) + salt.astype(U) * U(0x9E3779B97F4A7C15), prefix.astype(U) + (mix(cell.astype(U)) % splits(1, prefix).astype(U)) * U(0xC2B2AE3D27D4EB4F))
        return top(mix(by), parts)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hashes(dim, m.functions, s)
        for b in batches:
            for lo in range(0, b.num_rows, 2_000):
                part = b.slice(lo, 2_000)
                x, ids = matrix_of(part), part.column("id").to_numpy()
                cell, prefix = (v.astype(np.int64) for v in hashed(h, x.astype(float)))
                who = np.repeat(np.arange(len(x)), cell.shape[1])
                cell, prefix = cell.ravel(), prefix.ravel()
                times = splits(0, cell)
                p = place(cell, prefix, times, (mix(ids[who].astype(U)) % times.astype(U)).astype(np.int64))
                blobs = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(cell), pa.array(ids[who]), pa.array([blobs[i] for i in who.tolist()], pa.binary())], names=["part", "cell", "id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hashes(dim, m.functions, s)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                piece = b.slice(lo, 256)
                x, ids = matrix_of(piece), piece.column("id").to_numpy()
                projected = h.project(augment_query(x.astype(float)))
                ratio, own, out = h.ratios(projected, m), h.slots(projected), []
                for i in range(len(x)):
                    cell, prefix = (v.astype(np.int64) for v in h.probes(ratio[i], own[i], m))
                    times = splits(0, cell)
                    salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    cell, prefix, times = (np.repeat(v, times) for v in (cell, prefix, times))
                    p = place(cell, prefix, times, salt)
                    order = np.lexsort((cell, p))
                    p, cell = p[order], cell[order]
                    at = np.append(groups(p), len(p))
                    out += [(int(p[a]), int(ids[i]), x[i].tobytes(), np.unique(cell[a:z]).tobytes()) for a, z in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64() if c < 2 else pa.binary()) for c in range(4)], names=["part", "query_id", "v", "cells"])

    def best_of(q: np.ndarray, q_id: int, x: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores, which don't depend on a row's place, of the k best of the rows at `at`."""
        at = at[ids[at] != q_id]
        near = x[at] @ q
        if len(at) > k:
            bar = np.partition(near, len(near) - k)[len(near) - k]
            at = at[near >= bar - 1e-9 * max(1, abs(bar))]
        exact = np.einsum("nd,d->n", x[at], q)
        order = np.lexsort((ids[at], -exact))
        at, exact = at[order], exact[order]
        dup = np.zeros(len(at), bool)  # an id counts once
        dup[1:] = (ids[at][1:] == ids[at][:-1]) & (exact[1:] == exact[:-1])
        return ids[at][~dup][:k], exact[~dup][:k]

    def score(have: pa.Table, want: pa.Table) -> pa.Table:
        if not have.num_rows or not want.num_rows:
            return FOUND_ARROW.empty_table()
        cell, ids = have.column("cell").to_numpy(), have.column("id").to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, ids = cell[order], ids[order]
        x = _matrix(have.column("v"), dim, code)[order].astype(float)
        at = groups(cell)
        end, names = np.append(at[1:], len(cell)), cell[at]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q_id, v, asked_cells in zip(want.column("query_id").to_pylist(), want.column("v").to_pylist(), want.column("cells").to_pylist(), strict=True):
            c = np.frombuffer(asked_cells, np.int64)
            which = np.minimum(np.searchsorted(names, c), len(names) - 1)
            which = which[names[which] == c]
            n = end[which] - at[which]
            if not len(n):
                continue
            rows_at = np.repeat(at[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found, exact = best_of(np.frombuffer(v, code).astype(float), q_id, x, ids, rows_at)
            out.append((np.full(len(found), q_id), found, exact))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=FOUND_ARROW) if out else FOUND_ARROW.empty_table()

    held = rows.mapInArrow(index, "part long, cell long, id long, v binary")
    wanted = asked.mapInArrow(ask, "part long, query_id long, v binary, cells binary")
    best = held.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(score, FOUND)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(df: DataFrame) -> DataFrame:
        once = df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    best = stored(ranked(best), "neighbours")
    full = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = stored(asked.join(full, "id", "left_anti").select("id", "v"), "short")
    n_short = short.count()
    if not n_short:
        return best
    # those with fewer than k, exactly: blocks of queries against all rows
    blocks = -(-n_short // s.exact_block)
    pieces = [best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")]
    for i in range(blocks):
        block = short.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow()
        if not block.num_rows:
            continue
        q, q_ids = matrix_of(block).astype(float), block.column("id").to_numpy()

        def scan(batches: Iterator[pa.RecordBatch], q: np.ndarray = q, q_ids: np.ndarray = q_ids) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, ids = matrix_of(b).astype(float), b.column("id").to_numpy()
                found = [(q_ids[i], *best_of(q[i], q_ids[i], x, ids, np.arange(len(ids)))) for i in range(len(q))]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, [len(f[1]) for f in found])), *(pa.array(np.concatenate([f[c] for f in found])) for c in (1, 2))], schema=FOUND_ARROW)

        pieces.append(ranked(rows.mapInArrow(scan, FOUND)))
    return reduce(DataFrame.unionAll, pieces)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
