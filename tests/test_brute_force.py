"""The packaged queries that SQL doesn't express, against plain Python over the whole small tables."""

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from quarryframe.functions.analyzer import STOPWORDS
from quarryframe.functions.stem import stem
from quarryframe.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def vectors():
    t = pq.read_table(f"{DATA}/embeddings.parquet").sort_by("vec_id")
    return np.array(t.column("embedding").to_pylist(), float)


def test_kmeans(spark, vectors):
    c, last = vectors[:4].copy(), None
    for _ in range(20):
        near = np.array([min(range(4), key=lambda k: ((x - c[k]) ** 2).sum()) for x in vectors])
        if last is not None and (near == last).all():
            break
        last, c = near, np.stack([vectors[near == k].mean(0) if (near == k).any() else c[k] for k in range(4)])
    near = np.array([min(range(4), key=lambda k: ((x - c[k]) ** 2).sum()) for x in vectors])
    got = {r["clusterId"]: r["documentCount"] for r in QUERIES["kmeans_clusters"](spark, DATA).collect()}
    assert got == dict(Counter(near.tolist()))


def test_leader_groups(spark, vectors):
    unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    free, sizes = list(range(len(unit))), []
    while free:
        taken = {i for i in free if i == free[0] or unit[i] @ unit[free[0]] >= 0.3}
        sizes.append(len(taken))
        free = [i for i in free if i not in taken]
    got = {r["semanticGroup"]: r["documentCount"] for r in QUERIES["semantic_groups"](spark, DATA).collect()}
    assert got == dict(enumerate(sizes))


def test_stemmed_search(spark):
    t = pq.read_table(f"{DATA}/documents.parquet")
    docs = {}
    for i, text in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True):
        words = [w.lower() for w in re.findall(r"[^\W_]+", text or "")]
        docs[i] = [stem(w) for w in words if w not in STOPWORDS and len(w.encode()) >= 2]
    docs = {i: ws for i, ws in docs.items() if ws}
    mean = sum(map(len, docs.values())) / len(docs)
    terms = [stem("tion"), stem("heating")]
    df = {q: sum(q in ws for ws in docs.values()) for q in terms}
    want = {}
    for i, ws in docs.items():
        tf = Counter(ws)
        parts = [math.log((len(docs) - df[q] + 0.5) / (df[q] + 0.5) + 1) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for q in terms if tf[q]]
        if parts:
            want[i] = sum(parts)
    got = {r["doc_id"]: r["score"] for r in QUERIES["search_stemmed"](spark, DATA).collect()}
    best = sorted(want, key=lambda i: (-round(want[i], 9), i))[:50]
    assert set(got) == set(best) and all(got[i] == pytest.approx(want[i]) for i in got)
