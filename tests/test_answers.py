"""Answers that were wrong once, and requests around them."""

import pytest
from pyspark.sql import functions as F

from quarryframe.catalog import CollectionCatalog
from quarryframe.functions.analyzer import Analyzer, query_terms
from quarryframe.operators import advisor, vector, writes
from quarryframe.operators.search import SearchRequest, TextIndex, build_index, idf_v1, phrase_candidates, regex_candidates, score_terms, scored, search
from quarryframe.plans.pipeline import aggregate


def ids(df, key="_id"):
    return sorted(r[key] for r in df.collect())


def test_ne_of_another_kind(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", None, None), ("c", 0, "")], "_id string, n int, s string")
    for spec in ({"n": {"$ne": True}}, {"s": {"$ne": False}}, {"n": {"$nin": [True, False]}}, {"$nor": [{"n": True}]}):
        assert ids(aggregate(df, [{"$match": spec}])) == ["a", "b", "c"]
    times = df.withColumn("t", F.to_timestamp(F.lit("2020-01-01")))
    assert ids(aggregate(times, [{"$match": {"t": {"$ne": "no time"}}}])) == ["a", "b", "c"]
    assert ids(aggregate(times.withColumn("l", F.array(F.lit(None).cast("int"))), [{"$match": {"l": {"$ne": [1]}}}])) == ["a", "b", "c"]


@pytest.mark.parametrize("kind", ["string", "int", "boolean", "date", "timestamp"])
def test_push_in_mixed_order(spark, kind):
    text = {"string": ("a", "ab", "b"), "int": ("-5", "0", "7"), "boolean": ("false", "false", "true"), "date": ("1960-01-01", "2000-01-01", "2020-01-01"), "timestamp": ("1960-01-01", "2000-01-01", "2020-01-01")}[kind]
    rows = [("1", text[2], 9), ("2", text[0], 5), ("3", text[1], 1), ("4", None, 3), ("5", text[2], 1)]
    df = spark.createDataFrame(rows, "_id string, s string, v int").withColumn("s", F.col("s").cast(kind))
    want = [r["v"] for r in df.orderBy(F.col("s").desc_nulls_last(), F.col("v").asc_nulls_first(), "_id").collect()]
    out = aggregate(df, [{"$sort": {"s": -1, "v": 1}}, {"$group": {"_id": None, "all": {"$push": "$v"}, "first": {"$first": "$v"}, "last": {"$last": "$v"}}}]).first()
    assert (out["all"], out["first"], out["last"]) == (want, want[0], want[-1])


def test_repeated_keys_in_a_batch(spark):
    base = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "_id string, n int, at int")
    twice = spark.createDataFrame([("a", 10, 1), ("a", 11, 2)], "_id string, n int, at int")
    for f in (writes.upsert, writes.patch):
        with pytest.raises(writes.DuplicateKey):
            f(base, twice)
        assert sorted((r["_id"], r["n"]) for r in f(base, twice, order="at").collect()) == [("a", 11), ("b", 2)]


def test_advice_needs_confidence(spark):
    log = spark.createDataFrame([("c", "f", "query", i % 100 < share, 1.0) for share in (55,) for i in range(400)], "collection string, field string, kind string, full_scan boolean, ms double")
    assert advisor.advise(log).count() == 0 and advisor.advise(log, min_confidence=0.5).count() == 1
    assert advisor.advise(log, min_confidence=0.5, indexed=("f",)).count() == 0


def test_compatibility_forms_are_found(spark):
    df = spark.createDataFrame([("1", "\ufb01nancial news"), ("2", "financial news"), ("3", "x\u00b2 news")], "_id string, t string")
    for index in (build_index(df, ["t"]), build_index(df, ["t"], Analyzer("english", stemming=False))):
        for q in ("financial", "\ufb01nancial"):
            assert ids(search(index, SearchRequest(q)), "doc") == ["1", "2"]
        assert ids(search(index, SearchRequest("x\u00b2 news")), "doc") == ["1", "2", "3"]


def test_token_arrays_and_postings_agree(spark, tmp_path):
    plain = Analyzer("english", stemming=False)
    df = spark.createDataFrame([("1", "red green red blue"), ("2", "green red green blue red green"), ("3", ""), ("4", None), ("5", "blue sky")], "_id string, t string")
    lazy = build_index(df, ["t"], plain)
    lazy.save(str(tmp_path / "i"))
    kept = TextIndex.load(spark, str(tmp_path / "i"), plain)
    assert lazy.tokens is not None and kept.tokens is None
    for terms in (["red"], ["red", "green", "red"], ["nothing"], []):
        want = sorted((r["doc"], round(r["score"], 9)) for r in scored(kept.postings, kept.stats, terms, idf_v1).collect())
        for index in (lazy, kept):
            assert sorted((r["doc"], round(r["score"], 9)) for r in score_terms(index, terms, idf_v1).collect()) == want
    for phrase, found in ((["green", "red"], ["2"]), (["red", "green", "red"], ["1"]), (["red", "green", "blue"], []), (["green", "blue"], ["2"])):
        assert ids(phrase_candidates(lazy, phrase), "doc") == ids(phrase_candidates(kept, phrase), "doc")
    for pattern in ("^r", "e.$", "zz", "("):
        assert sorted(map(tuple, regex_candidates(lazy, pattern).collect())) == sorted(map(tuple, regex_candidates(kept, pattern).collect()))


def test_stems_are_not_shuffled(spark, tmp_path):
    df = spark.createDataFrame([("1", "heating heated tion"), ("2", "Skies and heats, heats"), ("3", ""), ("4", None), ("5", "sky dying"), ("6", "the"), ("7", "\u0130stanbul")], "_id string, t string")
    lazy = build_index(df, ["t"])
    plan = search(lazy, SearchRequest("tion heating"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "Join Inner" not in plan and "Join LeftOuter" not in plan
    assert [(r["doc"], r["toks"]) for r in lazy.tokens.orderBy("doc").collect()] == [("1", ["heat", "heat", "tion"]), ("2", ["sky", "heat", "heat"]), ("3", []), ("4", None), ("5", ["sky", "die"]), ("6", []), ("7", query_terms("\u0130stanbul"))]
    lazy.save(str(tmp_path / "i"))
    kept = TextIndex.load(spark, str(tmp_path / "i"))
    for text in ("tion heating", "sky", "nothing", ""):
        for more in ({}, {"regex": "^h"}, {"fuzzy": 1}, {"phrase": True}):
            a, b = ([(r["doc"], round(r["score"], 9)) for r in search(i, SearchRequest(text, **more)).collect()] for i in (lazy, kept))
            assert a == b
    assert sorted(ids(search(lazy, SearchRequest("heat")), "doc")) == ["1", "2"]


def test_large_k_leaves_the_session_alone(spark, monkeypatch):
    df = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(20)], "_id string, v array<double>")
    before = spark.conf.get("spark.sql.execution.topKSortFallbackThreshold")
    monkeypatch.setattr(vector, "LARGE_K", 5)
    for k in (4, 7, 50):
        found = [r["_id"] for r in vector.knn(df, "v", [1.0, 0.0], k, "dot").collect()]
        assert found == [str(i) for i in range(19, -1, -1)][:k]
    assert spark.conf.get("spark.sql.execution.topKSortFallbackThreshold") == before


def test_catalog_is_kept(spark, tmp_path):
    c = CollectionCatalog(spark)
    items = c.create("items", spark.createDataFrame([("1", "ab", [1.0, 2.0]), ("2", "b", [3.0, 4.0])], "_id string, s string, v array<float>"), {"fields": {"s": {"type": "string", "enum": ["ab", "b"]}, "v": {"type": "vector", "dimensions": 2}}})
    items.create_index("s", "hash")
    c.save(str(tmp_path / "c"))
    again = CollectionCatalog.open(spark, str(tmp_path / "c")).get("items")
    assert again.schema == items.schema and again.indexes == {"s": "hash"} and ids(again.df) == ["1", "2"]
    assert ids(again.find_prefix("s", "a")) == ["1"] and again.stats()["vectors"]["v"]["n_vectors"] == 2
    with pytest.raises(ValueError):
        c.import_rows("items", items.df)
    assert c.import_rows("items", items.df.limit(1), overwrite=True).count() == 1


def test_unified_paths(spark):
    df = spark.sql("SELECT '1' AS _id, named_struct('price', named_struct('scalar', 5), 'v', named_struct('vector', array(1.0))) AS fields UNION ALL SELECT '2', named_struct('price', named_struct('scalar', 9), 'v', named_struct('vector', array(2.0)))")
    assert ids(aggregate(df, [{"$match": {"price": {"$gt": 6}}}])) == ["2"]
    assert [r["n"] for r in aggregate(df, [{"$project": {"n": {"$size": "$v"}}}]).collect()] == [1, 1]


def test_lookup_and_unwind_as_a_join(spark):
    left = spark.createDataFrame([("1", 5, 2), ("2", None, 1), ("3", 7, 3), ("4", 5, 4)], "_id string, k int, n int")
    right = spark.createDataFrame([("a", 5, "x"), ("b", 5, "y"), ("c", None, "z")], "_id string, f int, s string")
    lookup = {"$lookup": {"from": "r", "localField": "k", "foreignField": "f", "as": "got"}}
    for keep in (False, True):
        unwind = {"path": "$got", "preserveNullAndEmptyArrays": keep}
        end = [{"$project": {"_id": 1, "s": "$got.s"}}]
        joined = aggregate(left, [lookup, {"$unwind": unwind}, *end], {"r": right})
        apart = aggregate(left, [lookup, {"$match": {}}, {"$unwind": unwind}, *end], {"r": right})
        assert sorted(map(str, joined.collect())) == sorted(map(str, apart.collect()))
        assert "collect_list" not in joined._jdf.queryExecution().optimizedPlan().toString()
    first = aggregate(left, [{"$sort": {"n": -1}}, lookup, {"$limit": 2}], {"r": right})
    assert sorted(r["_id"] for r in first.collect()) == ["3", "4"]
    first = aggregate(left, [{"$sort": {"n": 1}}, lookup, {"$unwind": {"path": "$got", "preserveNullAndEmptyArrays": True}}, {"$limit": 1}], {"r": right})
    assert [r["_id"] for r in first.collect()] == ["2"]
