"""Vectors: distances, exact nearest neighbours, score fusion, clustering and leader grouping."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.accumulators import Order
from .stages import Frame

METRICS = ("cosine", "euclidean", "dot")
LARGE_K = 100_000


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def score(a: Column, b: Column, metric: str) -> Column:
    """The larger the nearer: cosine similarity, 1 / (1 + Euclidean distance), or inner product. Null for other lengths."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; there are {METRICS}")
    found = {"cosine": lambda: cosine(a, b), "euclidean": lambda: 1 / (1 + euclidean(a, b)), "dot": lambda: dot(a, b)}[metric]()
    return F.when(F.size(a) == F.size(b), found)


def literal_vector(v: list[float]) -> Column:
    if not len(v):
        raise ValueError("a query vector can't be empty")
    return F.array(*[F.lit(float(x)) for x in v])


def check_dimensions(query: list[float], dimensions: int | None) -> None:
    if dimensions is not None and len(query) != dimensions:
        raise ValueError(f"the query has {len(query)} dimensions, the field {dimensions}")


def knn(df: DataFrame, vector: str, query: list[float], k: int = 10, metric: str = "cosine", condition: Column | None = None, min_score: float | None = None, key: str = "_id", dimensions: int | None = None, include_vector: bool = True, as_name: str = "score") -> DataFrame:
    """Exact k nearest rows, nearest first, ties by key. The condition comes before the top k, min_score after it. Each task
    keeps k rows only (TakeOrderedAndProject)."""
    check_dimensions(query, dimensions)
    if condition is not None:
        df = df.filter(condition)
    scored = df.withColumn(as_name, score(F.col(vector), literal_vector(query), metric)).filter(F.col(as_name).isNotNull())
    top = scored.orderBy(F.desc(as_name), F.asc(key))
    if k <= LARGE_K:
        top = top.limit(k)
    elif df.count() > k:
        # a heap of k rows would be set aside by each task at once; behind a filter that isn't known the rows are sorted instead
        top = top.filter(F.rand() >= 0).limit(k)
    if min_score is not None:
        top = top.filter(F.col(as_name) >= min_score)
    return top if include_vector else top.drop(vector)


def vector_stats(df: DataFrame, vector: str) -> DataFrame:
    """One row: rows, vectors among them, least and most dimensions, mean and largest norm."""
    v = F.col(vector)
    there = v.isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(there).alias("n_vectors"), F.min(F.when(there, F.size(v))).cast("long").alias("least_dimensions"), F.max(F.when(there, F.size(v))).cast("long").alias("most_dimensions"), F.avg(norm(v)).alias("mean_norm"), F.max(norm(v)).alias("largest_norm"))


def vector_match_stage(f: Frame, spec: dict) -> Frame:
    """The topK (10) rows nearest to a vector, with vectorScore."""
    top = knn(f.df, spec["field"], spec["vector"], int(spec.get("topK") or 10), spec.get("metric", "cosine"), min_score=spec.get("minScore"), key=f.context.key, as_name="vectorScore")
    return replace(f, df=top, order=Order((("vectorScore", False), (f.context.key, True))))


def fuse(parts: dict[str, DataFrame], method: str = "sum", weights: dict[str, float] | None = None, key: str = "_id") -> DataFrame:
    """(key, score) of the union of candidate sets (key, score). sum adds what there is; weighted adds weight times score of
    the sets with a weight; rrf adds 1 / (60 + 1 / (score + 0.01)); rrf_rank adds 1 / (60 + rank). The sets are tagged and
    aggregated once, which needs no full outer join."""
    tagged = None
    for name, df in parts.items():
        s = F.col("score").cast("double")
        if method == "weighted":
            s = s * F.lit(float((weights or {}).get(name, 0.0)))
        elif method == "rrf":
            s = 1 / (60 + 1 / (s + 0.01))
        elif method == "rrf_rank":
            s = 1 / (60 + F.row_number().over(Window.orderBy(F.desc("score"), key)))
        elif method != "sum":
            raise ValueError(f"unknown fusion {method}")
        one = df.select(F.col(key), s.alias("score"))
        tagged = one if tagged is None else tagged.unionAll(one)
    return tagged.groupBy(key).agg(F.sum("score").alias("score"))


def hybrid_search_stage(f: Frame, spec: dict) -> Frame:
    """Rows by vector and by text, fused into hybridScore, best first. Weights that are missing or 0 are 0.5."""
    from .search import bm25_unified

    key, parts = f.context.key, {}
    if "vector" in spec:
        v = spec["vector"]
        parts["vector"] = knn(f.df, v["field"], v.get("vector", v.get("query")), int(v.get("topK") or 100), v.get("metric", "cosine"), min_score=v.get("minScore"), key=key).select(key, "score")
    if "text" in spec:
        t = spec["text"]
        parts["text"] = bm25_unified(f.df, t["field"], t.get("query", ""), key=key, limit=int(t.get("limit") or 100)).select(key, "score")
    scoring = spec.get("scoring", {})
    weights = scoring.get("weights", scoring)
    chosen = {"vector": weights.get("vector", weights.get("vectorWeight")) or 0.5, "text": weights.get("text", weights.get("textWeight")) or 0.5}
    fused = fuse(parts, scoring.get("method", "weighted"), chosen, key).withColumnRenamed("score", "hybridScore")
    out = f.df.join(fused, key).orderBy(F.desc("hybridScore"), F.asc(key))
    return replace(f, df=out, order=Order((("hybridScore", False), (key, True))))


def unified_query(df: DataFrame, filter: dict | None = None, vector: dict | None = None, text: dict | None = None, fusion: str = "sum", weights: dict | None = None, limit: int = 10, offset: int = 0, filter_mode: str = "union", key: str = "_id") -> DataFrame:
    """Filter (score 1), vector and text candidates, fused, best first, then a page of the rows. filter_mode "restrict" makes
    the filter a condition of the others too."""
    from ..functions.paths import Resolver
    from ..functions.predicates import find_filter
    from .search import bm25_unified

    parts, rows = {}, df
    if filter:
        matching = df.filter(find_filter(Resolver(df.schema), filter))
        parts["filter"] = matching.select(key, F.lit(1.0).alias("score"))
        rows = matching if filter_mode == "restrict" else df
    if vector:
        parts["vector"] = knn(rows, vector["field"], vector.get("vector", vector.get("query")), int(vector.get("topK") or 10), vector.get("metric", "cosine"), min_score=vector.get("minScore"), key=key).select(key, "score")
    if text:
        parts["text"] = bm25_unified(rows, text["field"], text["query"], key=key, limit=int(text.get("limit") or 10)).select(key, "score")
    fused = fuse(parts, fusion, weights, key).orderBy(F.desc("score"), F.asc(key)).offset(offset).limit(limit)
    return df.join(fused, key).orderBy(F.desc("score"), F.asc(key))


def centroids(df: DataFrame, key: str, vector: Column) -> DataFrame:
    """(key, centroid): element-wise means, per position, so that no vector of a group is collected."""
    each = df.select(F.col(key), F.posexplode(vector).alias("pos", "x"))
    means = each.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda z: z["m"]).alias("centroid"))


def top_n(df: DataFrame, key: str, by: str, n: int, order_key: str) -> DataFrame:
    """(key, items): the n rows of each group with the largest value, as an array of rows."""
    columns = [c for c in df.columns if c != key]
    w = Window.partitionBy(key).orderBy(F.desc(by), F.asc(order_key)) if order_key in columns else Window.partitionBy(key).orderBy(F.desc(by))
    best = df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n)
    rows = F.array_sort(F.collect_list(F.struct(F.col("__rank").alias("rank"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))))
    return best.groupBy(key).agg(F.transform(rows, lambda z: z["row"]).alias("items"))


def kmeans(df: DataFrame, vector: str, k: int = 3, max_iterations: int = 100, key: str = "_id") -> tuple[DataFrame, list[list[float]]]:
    """Lloyd's algorithm from the first k rows by key, until no assignment changes. (rows with clusterId, centroids.)

    Each round is one job: tasks assign their rows and add them up per cluster, and k sums come back; rows never move."""
    start = [r[0] for r in df.filter(F.col(vector).isNotNull()).orderBy(key).limit(k).select(vector).collect()]
    if not start:
        return df.withColumn("clusterId", F.lit(None).cast("int")), []
    centres = np.array([start[i % len(start)] for i in range(k)], float)
    vectors = df.filter(F.col(vector).isNotNull() & (F.size(vector) == centres.shape[1])).select(F.col(vector).cast("array<double>").alias("v"))
    dim = centres.shape[1]

    def step(c: np.ndarray, last: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count, changed = np.zeros((k, dim)), np.zeros(k, np.int64), 0
            for b in batches:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                near = _nearest(x, c)
                changed += len(x) if last is None else int((near != _nearest(x, last)).sum())
                np.add.at(total, near, x)
                count += np.bincount(near, minlength=k)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(list(total), pa.list_(pa.float64())), pa.array(count), pa.array(np.where(np.arange(k) == 0, changed, 0))], names=["c", "s", "n", "changed"])

        return run

    last = None
    for _ in range(max_iterations):
        parts = vectors.mapInArrow(step(centres, last), "c long, s array<double>, n long, changed long").toArrow()
        c, n = parts.column("c").to_numpy(), parts.column("n").to_numpy()
        sums = np.zeros((k, dim))
        np.add.at(sums, c, np.array(parts.column("s").to_pylist()).reshape(-1, dim))
        counts = np.bincount(c, n, k)
        if last is not None and parts.column("changed").to_numpy().sum() == 0:
            break
        last, centres = centres, np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    final = [[float(x) for x in row] for row in centres]
    return df.filter(F.col(vector).isNotNull()).withColumn("clusterId", nearest_column(F.col(vector), final)), final


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of c for each of x, by |c|^2 - 2 x.c; those that rounding can't tell apart are compared exactly."""
    out = np.empty(len(x), np.int64)
    square = (c * c).sum(1)
    for lo in range(0, len(x), 4096):
        part = x[lo : lo + 4096]
        d = square - 2 * (part @ c.T)
        near = d.argmin(1)
        least = d[np.arange(len(part)), near]
        unsure = np.flatnonzero((d <= (least + 1e-9 * (1 + square.max() + (part * part).sum(1)))[:, None]).sum(1) > 1)
        for i in unsure.tolist():
            near[i] = ((part[i] - c) ** 2).sum(1).argmin()
        out[lo : lo + 4096] = near
    return out


def nearest_column(v: Column, centres: list[list[float]]) -> Column:
    """The number of the nearest centre, ties to the smaller, without Python."""
    d = F.array(*[F.struct(euclidean(v, literal_vector(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return F.array_min(d)["i"]


def vector_cluster_stage(f: Frame, spec: dict) -> Frame:
    """One row per cluster that isn't empty: clusterId, centroid, documentCount, documents."""
    vector = spec.get("field", spec.get("vectorField"))
    rows, centres = kmeans(f.df, vector, int(spec.get("k", spec.get("numClusters", 3)) or 3), int(spec.get("maxIterations") or 100), f.context.key)
    columns = [F.col(f"`{c}`") for c in f.df.columns]
    grouped = rows.groupBy("clusterId").agg(F.count(F.lit(1)).alias("documentCount"), F.array_sort(F.collect_list(F.struct(*columns))).alias("documents"))
    table = F.array(*[literal_vector(c) for c in centres]) if centres else F.array().cast("array<array<double>>")
    out = grouped.select("clusterId", F.get(table, F.col("clusterId")).alias("centroid"), "documentCount", "documents").orderBy("clusterId")
    return replace(f, df=out, order=Order((("clusterId", True),)), context=replace(f.context, key="clusterId"))


def semantic_groups(df: DataFrame, vector: str, threshold: float, key: str = "_id") -> DataFrame:
    """Rows with semanticGroup: in key order a row that no leader has taken leads a group, and takes later free rows with
    cosine >= threshold to it.

    The choice of leaders is sequential by definition, so it's made in one task, on vectors and keys only and against the
    leaders so far; all other columns stay where they are and are joined by key."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("__key", kind), T.StructField("semanticGroup", T.IntegerType())])

    def lead(t: pa.Table) -> pa.Table:
        t = t.sort_by("__key")
        x = np.array(t.column("v").to_pylist(), float)
        length = np.sqrt((x * x).sum(1))
        unit = x / np.where(length > 0, length, 1)[:, None]
        group = np.full(len(x), -1, np.int32)
        n = 0
        for i in range(len(x)):
            if group[i] >= 0:
                continue
            free = np.flatnonzero(group[i:] < 0) + i
            near = free[unit[free] @ unit[i] >= threshold]
            group[near], group[i] = n, n
            n += 1
        return pa.table([t.column("__key"), pa.array(group)], names=["__key", "semanticGroup"])

    narrow = df.filter(F.col(vector).isNotNull()).select(F.lit(0).alias("__task"), F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("v"))
    found = narrow.groupBy("__task").applyInArrow(lead, schema)
    return df.join(found, F.col(key) == F.col("__key")).drop("__key")


def semantic_group_stage(f: Frame, spec: dict) -> Frame:
    """One row per leader group: semanticGroup, documentCount, documents."""
    vector = spec.get("vectorField", spec.get("field"))
    rows = semantic_groups(f.df, vector, float(spec.get("similarityThreshold", 0.8)), f.context.key)
    columns = [F.col(f"`{c}`") for c in f.df.columns]
    out = rows.groupBy("semanticGroup").agg(F.count(F.lit(1)).alias("documentCount"), F.array_sort(F.collect_list(F.struct(*columns))).alias("documents"))
    return replace(f, df=out.orderBy("semanticGroup"), order=Order((("semanticGroup", True),)), context=replace(f.context, key="semanticGroup"))
