"""Text and vector search on small rows."""

import math

import pytest
from pyspark.sql import functions as F

from quarryframe.functions.analyzer import Analyzer, ascii_folded, query_terms, tokens
from quarryframe.functions.stem import stem
from quarryframe.operators.search import SearchRequest, bm25_unified, build_index, fuzzy_candidates, idf_v1, phrase_candidates, regex_candidates, scored, search
from quarryframe.operators.vector import fuse, kmeans, knn, semantic_groups, unified_query
from quarryframe.plans.pipeline import aggregate

TEXT = [
    ("1", "Introduction to Databases", "This document explains relational databases and SQL queries."),
    ("2", "Full-Text Search Guide", "Learn how to implement full-text search in your applications."),
    ("3", "Weather Report", "Today is sunny with clear skies."),
]


@pytest.fixture(scope="module")
def text(spark):
    return spark.createDataFrame(TEXT, "_id string, title string, content string")


@pytest.fixture(scope="module")
def index(text):
    return build_index(text, ["title", "content"]).persist()


def docs(df):
    return sorted(r["doc"] for r in df.collect())


@pytest.mark.parametrize(("word", "expected"), [("running", "run"), ("databases", "databas"), ("relational", "relat"), ("consistency", "consist"), ("generously", "generous"), ("dying", "die"), ("news", "news"), ("hopping", "hop"), ("hoping", "hope"), ("knightly", "knight"), ("skies", "sky"), ("happily", "happili"), ("national", "nation"), ("controll", "control"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("kiwis", "kiwi"), ("luxuriated", "luxuri"), ("by", "by"), ("say", "say")])
def test_stems(word, expected):
    assert stem(word) == expected


def test_analyzers(spark):
    df = spark.createDataFrame([("The quick brown foxes, price $99.99 é1",)], "t string")
    assert df.select(tokens(F.col("t"))).first()[0] == ["quick", "brown", "foxes", "price", "99", "99", "é1"]
    assert df.select(tokens(F.col("t"), Analyzer("simple"))).first()[0][:2] == ["the", "quick"]
    assert df.select(tokens(F.col("t"), Analyzer("whitespace"))).first()[0][0] == "The"
    assert df.select(tokens(F.col("t"), normalise=True)).first()[0][-1] == "é1"
    assert df.select(ascii_folded(F.lit("éàß"))).first()[0] == "eas"
    assert query_terms("The quick brown foxes are running fast!") == ["quick", "brown", "fox", "run", "fast"]


def test_modes(index):
    assert docs(search(index, SearchRequest("DATABASES"))) == ["1"]
    assert docs(search(index, SearchRequest("full-text"))) == ["2"]
    assert docs(search(index, SearchRequest("relational databases", phrase=True))) == ["1"]
    fuzzy = search(index, SearchRequest("databse", fuzzy=2)).collect()
    assert [(r["doc"], r["score"]) for r in fuzzy] == [("1", 0.0)]
    assert [(r["doc"], r["score"]) for r in search(index, SearchRequest(regex="datab.*")).collect()] == [("1", 2.0)]
    assert docs(search(index, SearchRequest("search", limit=2, offset=2))) == []
    assert docs(regex_candidates(index, "(")) == []


def test_fields(text, index):
    assert search(index, SearchRequest("database", fields=("title",)), text).count() == 1
    assert search(index, SearchRequest("relational", fields=("title",)), text).count() == 0


def test_bm25_value(spark):
    df = spark.createDataFrame([("1", "the quick brown fox"), ("2", "the quick blue fox"), ("3", "slow turtle")], "_id string, t string")
    i = build_index(df, ["t"])
    out = {r["doc"]: r["score"] for r in scored(i.postings, i.stats, ["quick"], idf_v1).collect()}
    assert set(out) == {"1", "2"} and out["1"] == pytest.approx(0.444974, abs=1e-6)


def test_phrase_needs_adjacency(spark):
    df = spark.createDataFrame([("1", "hello world test"), ("2", "hello test world"), ("3", "helo wrld")], "_id string, t string")
    i = build_index(df, ["t"])
    assert docs(phrase_candidates(i, ["hello", "world", "test"])) == ["1"]
    assert docs(fuzzy_candidates(i, ["hello"], 2)) == ["1", "2", "3"]


def test_request_forms():
    assert SearchRequest.parse({"q": "a"}) == SearchRequest("a")
    r = SearchRequest.parse({"query": {"$text": "a", "$phrase": True, "$fuzzy": True, "$regex": {"title": "^a"}}, "limit": 5})
    assert (r.phrase, r.fuzzy, r.regex, r.limit) == (True, 2, "^a", 5)


@pytest.fixture(scope="module")
def axis(spark):
    return spark.createDataFrame([("doc1", [1.0, 0.0, 0.0, 0.0], "axis"), ("doc2", [0.0, 1.0, 0.0, 0.0], "axis"), ("doc3", [0.0, 0.0, 1.0, 0.0], "axis"), ("doc4", [1.0, 1.0, 0.0, 0.0], "diagonal")], "_id string, v array<float>, category string")


def test_knn(axis):
    out = knn(axis, "v", [1, 0, 0, 0], 3).collect()
    assert [(r["_id"], round(r["score"], 6)) for r in out] == [("doc1", 1.0), ("doc4", 0.707107), ("doc2", 0.0)]
    assert [r["_id"] for r in knn(axis, "v", [1, 0, 0, 0], 10, condition=F.col("category") == "diagonal").collect()] == ["doc4"]
    with pytest.raises(ValueError):
        knn(axis, "v", [1, 0], dimensions=4)
    with pytest.raises(ValueError):
        knn(axis, "v", [], 3)
    with pytest.raises(ValueError):
        knn(axis, "v", [1, 0, 0, 0], metric="invalid_metric")


def test_metrics(spark):
    euc = spark.createDataFrame([("a", [0.0] * 3), ("b", [1.0] * 3), ("c", [2.0] * 3)], "_id string, v array<double>")
    assert [round(r["score"], 6) for r in knn(euc, "v", [0, 0, 0], 3, "euclidean").collect()] == [1.0, 0.366025, 0.224009]
    dot = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [1.0, 1.0, 0.0]), ("c", [1.0, 1.0, 1.0])], "_id string, v array<double>")
    assert [(r["_id"], r["score"]) for r in knn(dot, "v", [1, 1, 1], 3, "dot").collect()] == [("c", 3.0), ("b", 2.0), ("a", 1.0)]


UNIFIED = [
    ("Laptop A", 1299.99, "electronics", "BrandA", [0.1, 0.2, 0.3, 0.4], "High performance laptop for gaming"), ("Phone A", 899.99, "electronics", "BrandA", [0.15, 0.25, 0.35, 0.45], "Smartphone with excellent camera"),
    ("Laptop B", 1099.99, "electronics", "BrandB", [0.2, 0.3, 0.4, 0.5], "Business laptop with long battery"), ("Phone B", 499.99, "electronics", "BrandB", [0.25, 0.35, 0.45, 0.55], "Budget smartphone"),
    ("T-Shirt", 29.99, "clothing", "BrandC", [0.5, 0.6, 0.7, 0.8], "Cotton t-shirt comfortable fit"), ("Jeans", 79.99, "clothing", "BrandC", [0.55, 0.65, 0.75, 0.85], "Denim jeans classic style"),
]
Q = [0.1, 0.2, 0.3, 0.4]


@pytest.fixture(scope="module")
def unified(spark):
    return spark.createDataFrame(UNIFIED, "_id string, price double, category string, brand string, embedding array<double>, description string").persist()


def test_unified_text(unified):
    out = bm25_unified(unified, "description", "laptop").collect()
    assert [(r["_id"], round(r["score"], 6)) for r in out] == [("Laptop A", 1.055435), ("Laptop B", 1.055435)]


def test_vector_match_group(unified):
    out = aggregate(unified, [{"$vectorMatch": {"field": "embedding", "vector": Q, "topK": 10, "minScore": 0.5}}, {"$group": {"_id": "$category", "avgPrice": {"$avg": "$price"}, "n": {"$count": {}}, "s": {"$avgVectorScore": {}}}}])
    got = {r["_id"]: (round(r.avgPrice, 2), r.n, round(r.s, 6)) for r in out.collect()}
    assert got == {"electronics": (949.99, 4, 0.995211), "clothing": (54.99, 2, 0.967349)}


def test_hybrid_weights(unified):
    out = aggregate(unified, [{"$hybridSearch": {"vector": {"field": "embedding", "vector": Q}, "text": {"field": "description", "query": "laptop"}, "scoring": {"method": "weighted", "weights": {"vector": 0.6, "text": 0.4}}}}])
    got = [(r["_id"], round(r["hybridScore"], 6)) for r in out.collect()]
    assert got == [("Laptop A", 1.022174), ("Laptop B", 1.018459), ("Phone A", 0.598779), ("Phone B", 0.593442), ("T-Shirt", 0.581318), ("Jeans", 0.579501)]


def test_centroid_topn_beside_group(unified):
    out = aggregate(unified, [{"$vectorMatch": {"field": "embedding", "vector": Q, "topK": 10}}, {"$group": {"_id": "$category"}, "$centroid": "$embedding", "$topN": {"by": "vectorScore", "n": 1}}])
    got = {r["_id"]: ([round(x, 6) for x in r.centroid], [t["_id"] for t in r.topN]) for r in out.collect()}
    assert got["electronics"] == ([0.175, 0.275, 0.375, 0.475], ["Laptop A"]) and got["clothing"][1] == ["T-Shirt"]


def test_unified_query_unites(spark):
    df = spark.createDataFrame([("A", "electronics", Q), ("B", "electronics", [0.15, 0.25, 0.35, 0.45]), ("C", "sports", [0.5, 0.6, 0.7, 0.8])], "_id string, category string, embedding array<double>")
    got = [(r["_id"], round(r["score"], 6)) for r in unified_query(df, {"category": "electronics"}, {"field": "embedding", "vector": Q, "topK": 5}).collect()]
    assert got == [("A", 2.0), ("B", 1.997965), ("C", 0.968864)]
    restricted = unified_query(df, {"category": "electronics"}, {"field": "embedding", "vector": Q, "topK": 5}, filter_mode="restrict")
    assert [r["_id"] for r in restricted.collect()] == ["A", "B"]


def test_rank_fusion(spark):
    a = spark.createDataFrame([("x", 0.9), ("y", 0.1)], "_id string, score double")
    b = spark.createDataFrame([("y", 5.0)], "_id string, score double")
    got = {r["_id"]: r["score"] for r in fuse({"a": a, "b": b}, "rrf_rank").collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61})
    with pytest.raises(ValueError):
        fuse({"a": a}, "nope")


def test_kmeans(spark):
    pts = [("a", [0.0, 0.0]), ("b", [10.0, 10.0]), ("c", [0.5, 0.0]), ("d", [10.0, 11.0]), ("e", [0.0, 0.7])]
    rows, centres = kmeans(spark.createDataFrame(pts, "_id string, v array<double>"), "v", 2)
    assert {r["_id"]: r["clusterId"] for r in rows.collect()} == {"a": 0, "c": 0, "e": 0, "b": 1, "d": 1}
    assert centres[1] == [10.0, 10.5] and centres[0] == pytest.approx([1 / 6, 0.7 / 3])
    out = aggregate(spark.createDataFrame(pts, "_id string, v array<double>"), [{"$vectorCluster": {"field": "v", "k": 2}}]).collect()
    assert [(r.clusterId, r.documentCount) for r in out] == [(0, 3), (1, 2)]


def test_leaders(spark):
    angle = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    df = spark.createDataFrame([("a", angle(0)), ("b", angle(20)), ("c", angle(40)), ("d", angle(50)), ("e", None)], "_id string, v array<double>")
    got = {r["_id"]: r["semanticGroup"] for r in semantic_groups(df, "v", math.cos(math.radians(25))).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1}
