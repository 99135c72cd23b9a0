"""Co-trained quality classifier.

Two views of a document, its text (hashed words and shares of kinds of characters) and its page metadata (source, language,
length), are fitted as logistic regressions on a bounded sample of labelled rows. Both then score all unlabelled documents,
and over rounds each view labels those that it is surest of, for the other view to learn from. Both are calibrated on held-out
labels, combined there, and then score every document. A good document has quality 1 and toxic 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, stored, table
from .npwords import LETTER, LOWER, U, slices, span_hash, text_arrays, trim, words

BITS = 16
SHAPES = 9
N_TEXT = (1 << BITS) + SHAPES
META_BITS = 10
N_META = 1 << META_BITS
#: (column, value) pairs that are worked on at a time.
PAIRS = 1 << 18
_KINDS = [np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(48, 58), b"*#$%&", b"!", b"|/\\<>{}[]=_~^", b" \t\n\r", b".,;:")]


@dataclass(frozen=True)
class Settings:
    """max_labelled bounds the sample of labelled rows that is fitted. In each round a view labels at most per_round documents of
    each class, the surest of all. A document is rejected when its probability of being good is under the threshold."""

    max_labelled: int = 12_000
    rounds: int = 3
    confident: float = 0.95
    per_round: int = 500
    held_out: float = 0.25
    steps: int = 80
    threshold: float = 0.5


@dataclass
class Sparse:
    """Rows of (column, value) pairs."""

    at: np.ndarray
    col: np.ndarray
    val: np.ndarray

    def pieces(self) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Rows, their pairs and how many each has, some PAIRS pairs at a time: what is computed of pairs takes several times
        the memory that they take."""
        for i, j in slices(self.at, PAIRS):
            yield slice(i, j), slice(self.at[i], self.at[j]), np.diff(self.at[i : j + 1])

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.at) - 1)
        for rows, own, n in self.pieces():
            out[rows] = np.bincount(np.repeat(np.arange(len(n)), n), self.val[own] * w[self.col[own]], len(n))
        return out

    def sums(self, g: np.ndarray, n_columns: int) -> np.ndarray:
        """For each column its values, each times its row's g, added up."""
        out = np.zeros(n_columns)
        for rows, own, n in self.pieces():
            out += np.bincount(self.col[own], self.val[own] * np.repeat(g[rows], n), n_columns)
        return out

    def take(self, which: np.ndarray) -> Sparse:
        at = np.concatenate([[0], np.cumsum(np.diff(self.at)[which])])
        out = Sparse(at, np.empty(at[-1], self.col.dtype), np.empty(at[-1], self.val.dtype))
        for rows, own, n in out.pieces():
            pick = np.repeat(self.at[which[rows]] - at[rows], n) + np.arange(own.start, own.stop)
            out.col[own], out.val[own] = self.col[pick], self.val[pick]
        return out

    def scaled(self, ratio: np.ndarray) -> Sparse:
        return Sparse(self.at, self.col, self.val * ratio.astype(np.float32)[self.col])


def join_rows(parts: list[Sparse]) -> Sparse:
    base = np.cumsum([0, *(len(p.col) for p in parts)])
    at = np.concatenate([[0], *(p.at[1:] + b for p, b in zip(parts, base, strict=False))])
    return Sparse(at, np.concatenate([p.col for p in parts]), np.concatenate([p.val for p in parts]))


def text_view(data: np.ndarray, offsets: np.ndarray) -> Sparse:
    """Features of consecutive whole texts."""
    n, size = len(offsets) - 1, np.diff(offsets)
    shapes = np.zeros((n, SHAPES))
    n_words = np.zeros(n)
    for j, k in enumerate(_KINDS):
        c = np.concatenate([[0], np.cumsum(k[data], dtype=np.int64)])
        shapes[:, j] = (c[offsets[1:]] - c[offsets[:-1]]) / np.maximum(size, 1)
    if len(data):
        starts, ends, _ = words(data, offsets, LETTER)
        doc = np.searchsorted(offsets, starts, "right") - 1
        key = (doc.astype(np.int64) << BITS) | (span_hash(LOWER[data], starts, ends) >> U(64 - BITS)).astype(np.int64)
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(first, append=len(key))
        key = key[first]
        row, col, val = key >> BITS, key & ((1 << BITS) - 1), np.log1p(count)
        n_words = np.bincount(doc, minlength=n)
        distinct = np.bincount(row, minlength=n)
        val /= np.sqrt(np.bincount(row, val * val, n))[row]
    else:
        row, col, val, distinct = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(n)
    shapes[:, 7] = distinct / np.maximum(n_words, 1)
    shapes[:, 8] = np.log1p(n_words) / 10
    at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n) + SHAPES)])
    cols, vals = np.empty(at[-1], np.int32), np.empty(at[-1], np.float32)
    own = np.arange(len(row)) + row * SHAPES
    cols[own], vals[own] = col, val
    tail = (at[1:, None] - SHAPES + np.arange(SHAPES)).ravel()
    cols[tail], vals[tail] = np.tile((1 << BITS) + np.arange(SHAPES), n), shapes.ravel()
    return Sparse(at, cols, vals)


def meta_view(source: list, lang: list, n_chars: np.ndarray) -> Sparse:
    """Features of page metadata: hashed source, language, their pair, and length on a logarithmic scale."""
    import zlib

    n = len(source)
    cells = np.empty((n, 5), np.int32)
    bucket = np.minimum(np.log2(np.maximum(n_chars, 0) + 1) * 2, 60).astype(int)
    for i, (s, g, b) in enumerate(zip(source, lang, bucket, strict=True)):
        for j, x in enumerate((f"s{s}", f"l{g}", f"p{s}/{g}", f"n{b}", f"m{g}/{b // 2}")):
            cells[i, j] = zlib.crc32(x.encode("utf-8", "replace")) % N_META
    return Sparse(np.arange(n + 1) * 5, cells.ravel(), np.ones(5 * n, np.float32))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: Sparse, y: np.ndarray, n: int, steps: int, start: np.ndarray | None = None, l2: float = 2e-5, rate: float = 0.5) -> np.ndarray:
    """Weights and, last, the intercept, by Adam over all rows; classes weigh alike."""
    w = np.zeros(n + 1) if start is None else start.copy()
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    share = np.clip(np.array([np.mean(y == 0), np.mean(y == 1)]), 0.02, 1)
    weight = (0.5 / share)[y.astype(int)] / max(len(y), 1)
    for t in range(1, steps + 1):
        g_row = weight * (logistic(x.dot(w) + w[-1]) - y)
        g = np.append(x.sums(g_row, n), g_row.sum()) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return w


def platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and intercept of y on the columns of z, by Newton steps with a weak pull to zero."""
    x = np.column_stack([z, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = logistic(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w


def log_ratios(x: Sparse, y: np.ndarray, n: int, free: int, sure: float = 2.0) -> np.ndarray:
    """For each column how much commoner it is in rows of class 1, as a logarithm; 0 if that isn't `sure` standard errors
    from chance. The last `free` columns, which all rows have, keep 1. A regression on columns so scaled hears the few words
    that tell, and not the many that are rare (Wang and Manning 2012)."""
    a, b = np.ones(n), np.ones(n)
    for rows, own, k in x.pieces():
        good = np.repeat(y[rows] == 1, k)
        a += np.bincount(x.col[own][good], minlength=n)
        b += np.bincount(x.col[own][~good], minlength=n)
    r = np.log(a / (np.sum(y == 1) + 2)) - np.log(b / (np.sum(y == 0) + 2))
    r[np.abs(r) < sure * np.sqrt(1 / a + 1 / b)] = 0
    r[n - free :] = 1
    return r


def co_train(text: Sparse, meta: Sparse, y: np.ndarray, pool_text: Sparse, pool_meta: Sparse, s: Settings, good_share: float | None = None) -> dict[str, np.ndarray]:
    """The model. y is 0 or 1; which rows are held out for calibration follows from their order only. good_share is that of
    class 1 where the model is to be used, if the rows here were chosen by class."""
    held = (np.arange(len(y)) * 0.6180339887 % 1) < s.held_out
    if held.all() or not held.any():
        held = np.zeros(len(y), bool)
    learn, calibrate = np.flatnonzero(~held), np.flatnonzero(held if held.any() else ~held)
    ratio = log_ratios(text.take(learn), y[learn], N_TEXT, SHAPES)
    text, pool_text = text.scaled(ratio), pool_text.scaled(ratio)
    views = {"text": (text, pool_text, N_TEXT), "meta": (meta, pool_meta, N_META)}
    extra = {k: (np.zeros(0, int), np.zeros(0)) for k in views}
    weights: dict[str, np.ndarray | None] = dict.fromkeys(views)
    free = {k: np.ones(len(pool_text.at) - 1, bool) for k in views}
    for r in range(s.rounds + 1):
        for k, (x, pool, n) in views.items():
            at, label = extra[k]
            weights[k] = fit(join_rows([x.take(learn), pool.take(at)]), np.concatenate([y[learn], label]), n, s.steps if r == 0 else s.steps // 4, weights[k])
        if r == s.rounds:
            break
        for k, other in (("text", "meta"), ("meta", "text")):
            x, pool, _ = views[k]
            # sure means: as right on held-out labels, where it says so
            w = platt((x.take(calibrate).dot(weights[k][:-1]) + weights[k][-1])[:, None], y[calibrate])
            p = logistic((pool.dot(weights[k][:-1]) + weights[k][-1]) * w[0] + w[1])
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                pick = np.flatnonzero((sure >= s.confident) & free[other])
                pick = pick[np.argsort(-sure[pick], kind="stable")][: s.per_round]
                free[other][pick] = False
                extra[other] = (np.concatenate([extra[other][0], pick]), np.concatenate([extra[other][1], np.full(len(pick), label)]))
    model = {}
    logits = []
    for k, (x, _, _) in views.items():
        z = x.take(calibrate).dot(weights[k][:-1]) + weights[k][-1]
        a, b = platt(z[:, None], y[calibrate])
        model[k], model[f"{k}_scale"] = weights[k], np.array([a, b])
        logits.append(a * z + b)
    model["both"] = platt(np.column_stack(logits), y[calibrate])
    here = np.clip(np.mean(y[calibrate]), 1e-3, 1 - 1e-3)
    there = here if good_share is None else np.clip(good_share, 1e-3, 1 - 1e-3)
    model["shift"] = np.array([np.log(there / (1 - there)) - np.log(here / (1 - here))])
    model["text"][:-1] *= ratio  # so that scoring needs no scaling
    return model


def score(model: dict[str, np.ndarray], text: Sparse, meta: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probabilities of a good document by the text, the metadata, and both."""
    z = [(x.dot(model[k][:-1]) + model[k][-1]) * model[f"{k}_scale"][0] + model[f"{k}_scale"][1] for k, x in (("text", text), ("meta", meta))]
    both = np.column_stack(z) @ model["both"][:-1] + model["both"][-1]
    return tuple(logistic(x + model["shift"][0]) for x in (z[0], z[1], both))


def _views(text: pa.Array, source: pa.Array, lang: pa.Array) -> Iterator[tuple[int, int, Sparse, Sparse]]:
    """Both views of rows i to j of a batch, a bounded slice of text at a time."""
    data, offsets = text_arrays(text)
    n_chars = pc.utf8_length(text).fill_null(0).to_numpy(zero_copy_only=False)
    source, lang = source.to_pylist(), lang.to_pylist()
    for i, j in slices(offsets, 1 << 20):
        yield i, j, text_view(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), meta_view(source[i:j], lang[i:j], n_chars[i:j])
        trim()


def _dump(model: dict[str, np.ndarray]) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **{k: v.astype(np.float32) for k, v in model.items()})
    return out.getvalue()


def _load(blob: bytes) -> dict[str, np.ndarray]:
    import io

    return {k: v.astype(np.float64) for k, v in np.load(io.BytesIO(blob)).items()}


def _with_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, text and the metadata; a metadata column that is missing is null throughout."""
    have = {"source": "string", "lang": "string"}
    d = columns(docs, doc_id="long", text="string", **{k: v for k, v in have.items() if k in docs.columns})
    for k, v in have.items():
        if k not in docs.columns:
            d = d.withColumn(k, F.lit(None).cast(v))
    return d


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> bytes | None:
    """Fits on at most max_labelled labelled documents (an equal share of each combination of labels, chosen by a hash of
    doc_id), in one task; scores every unlabelled document by either view; and co-trains with those of all of them that a view
    is surest of, as many as the rounds can label. None if no document is labelled. Labels with a null are left out; of several
    labels of a document the worst counts."""
    d = _with_metadata(docs)
    known = columns(labels, doc_id="long", quality="int", toxic="int").dropna()
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    n_good, n_known = known.agg(F.count_if(good), F.count("*")).first()
    share, picked = settings.max_labelled // 4, None
    for quality in (0, 1):
        for toxic in (0, 1):
            # ids only, and no more than share of them
            some = known.filter((F.col("quality") == quality) & (F.col("toxic") == toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(share)
            picked = some if picked is None else picked.unionAll(some)
    picked = picked.select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.0).alias("y"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, y = b.column("doc_id").to_pylist(), b.column("y").to_pylist()
            for i, j, text, meta in _views(b.column("text"), b.column("source"), b.column("lang")):
                rows = [(text.col[p:q].tobytes(), text.val[p:q].tobytes()) for p, q in zip(text.at[:-1], text.at[1:], strict=True)]
                m = meta.col.reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j], pa.int64()), pa.array(y[i:j], pa.float64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())],
                    names=["doc_id", "y", "col", "val", "meta"],
                )

    def learn(t: pa.Table, s: Settings) -> pa.Table:
        t = t.sort_by("doc_id")
        y = t.column("y").to_numpy()
        (cols, at), (vals, _), (meta, _) = (text_arrays(t.column(c)) for c in ("col", "val", "meta"))
        text, meta = Sparse(at // 4, cols.view(np.int32), vals.view(np.float32)), meta.view(np.int32)
        meta = Sparse(np.arange(len(y) + 1) * 5, meta, np.ones(len(meta), np.float32))
        del cols, vals, t
        known, pool = np.flatnonzero(~np.isnan(y)), np.flatnonzero(np.isnan(y))
        if not len(known):
            return pa.table([pa.array([], pa.binary())], names=["model"])
        parts = [x.take(rows) for rows in (known, pool) for x in (text, meta)]
        del text, meta
        trim()
        model = co_train(parts[0], parts[1], y[known], parts[2], parts[3], s, n_good / n_known)
        del parts
        trim()
        return pa.table([pa.array([_dump(model)], pa.binary())], names=["model"])

    def features(ids: DataFrame) -> DataFrame:
        # at most max_labelled, or what the rounds can label, pairs of 16 bytes
        sample = d.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
        return sample.mapInArrow(featurize, "doc_id long, y double, col binary, val binary, meta binary")

    def fitted(rows: DataFrame, s: Settings) -> bytes | None:
        found = rows.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(lambda t: learn(t, s), "model binary").collect()
        return bytes(found[0][0]) if found else None

    labelled = stored(features(picked), "labelled")
    first = fitted(labelled, replace(settings, rounds=0))
    if first is None or not settings.rounds or not settings.per_round:
        return first
    scores = classify(d.filter(F.col("doc_id").isNotNull()), first, settings).select("doc_id", "p_text", "p_meta")
    others = stored(scores.join(known.select("doc_id"), "doc_id", "left_anti"), "scores")
    surest = [others.orderBy(F.col(p) if bad else F.desc(p), F.xxhash64("doc_id"), "doc_id").limit(settings.rounds * settings.per_round).select("doc_id") for p in ("p_text", "p_meta") for bad in (False, True)]
    pool = reduce(DataFrame.unionAll, surest).distinct().select("doc_id", F.lit(None).cast("double").alias("y"))
    return fitted(labelled.unionAll(features(pool)), settings)


def classify(docs: DataFrame, model: bytes | None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, p_text, p_meta, score, keep for every row of docs, from the whole text.

    keep is score >= threshold. Null and empty texts have no words and are judged by what is left; without a model every
    score is null and every row kept. Rows that repeat get one row each."""
    d = _with_metadata(docs)
    if model is None:
        none = F.lit(None).cast("double")
        return d.select("doc_id", none.alias("p_text"), none.alias("p_meta"), none.alias("score"), F.lit(True).alias("keep"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _load(sent.value)
        for b in batches:
            for i, j, text, meta in _views(b.column("text"), b.column("source"), b.column("lang")):
                p, q, both = score(own, text, meta)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(p), pa.array(q), pa.array(both), pa.array(both >= settings.threshold)], names=["doc_id", "p_text", "p_meta", "score", "keep"])

    return d.mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, keep boolean")


def reject(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs, with all columns, without the rows that the classifier rejects, in one pass over them; nothing is shuffled."""
    model = train(docs, labels, settings)
    if model is None:
        return docs
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = [names.index(k) if k in names else None for k in ("text", "source", "lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _load(sent.value)
        for b in batches:
            cols = [pa.nulls(len(b), pa.string()) if i is None else b.column(i).cast(pa.string()) for i in at]
            keep = np.concatenate([score(own, text, meta)[2] >= settings.threshold for _, _, text, meta in _views(*cols)] or [np.zeros(0, bool)])
            yield b.filter(pa.array(keep))

    return safe.mapInArrow(run, safe.schema).toDF(*names)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = classify(docs, train(docs, labels))
    return out.select("doc_id", F.round("score", 6).alias("score"), F.round("p_text", 6).alias("p_text"), F.round("p_meta", 6).alias("p_meta"), "keep")
