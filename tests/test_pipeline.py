"""Stages, predicates, expressions and accumulators on small rows with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quarryframe.catalog import CollectionCatalog, CollectionExists
from quarryframe.plans.pipeline import aggregate, explain, parse


@pytest.fixture(scope="module")
def products(spark):
    kinds = ["electronics", "electronics", "clothing", "clothing", "books"]
    return spark.createDataFrame([(f"p{i}", f"Product {i}", 100.0 * i, kinds[i - 1], i) for i in range(1, 6)], "_id string, name string, price double, category string, quantity long")


@pytest.fixture(scope="module")
def edge(spark):
    docs = [{"a": 1, "s": "x"}, {"a": None}, {}, {"a": "1"}, {"a": 2.5, "arr": [10, 20]}, {"arr": []}, {"arr": None}, {"o": {"k": 1}}]
    return spark.createDataFrame([(f"e{i + 1}", json.dumps(d)) for i, d in enumerate(docs)], "_id string, j string").select("_id", F.parse_json("j").alias("data"))


def ids(df):
    return sorted(r[0] for r in df.select("_id").collect())


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_match_and_group(products):
    assert ids(aggregate(products, [{"$match": {"category": "electronics"}}])) == ["p1", "p2"]
    out = aggregate(products, [{"$group": {"_id": "$category", "total": {"$sum": "$price"}, "n": {"$sum": 1}, "avg": {"$avg": "$price"}}}, {"$sort": {"_id": 1}}])
    assert rows(out) == [("books", 500.0, 1.0, 500.0), ("clothing", 700.0, 2.0, 350.0), ("electronics", 300.0, 2.0, 150.0)]


def test_sort_skip_limit(products):
    assert [r[0] for r in aggregate(products, [{"$sort": {"price": -1}}, {"$limit": 2}]).select("_id").collect()] == ["p5", "p4"]
    assert [r[0] for r in aggregate(products, [{"$sort": {"price": 1}}, {"$skip": 2}, {"$limit": 2}]).select("_id").collect()] == ["p3", "p4"]


def test_count_is_one_row_even_of_nothing(products):
    assert rows(aggregate(products, [{"$match": {"category": "electronics"}}, {"$count": "total"}])) == [(2,)]
    assert rows(aggregate(products, [{"$match": {"category": "none"}}, {"$count": "total"}])) == [(0,)]


def test_group_of_nothing_is_nothing(products):
    assert rows(aggregate(products, [{"$match": {"category": "none"}}, {"$group": {"_id": None, "n": {"$count": {}}}}])) == []


def test_bucket_keeps_empty_ones(products):
    out = aggregate(products, [{"$bucket": {"groupBy": "$price", "boundaries": [0, 200, 400, 1000]}}])
    assert [(r["_id"], r["count"]) for r in out.collect()] == [(0, 1), (200, 2), (400, 2)]
    out = aggregate(products, [{"$bucket": {"groupBy": "$price", "boundaries": [0, 50, 200], "default": "other"}}])
    assert [(r["_id"], r["count"]) for r in out.collect()] == [("0", 0), ("50", 1), ("other", 4)]


def test_sort_by_count_breaks_ties_by_key(products):
    assert rows(aggregate(products, [{"$sortByCount": "$category"}])) == [("clothing", 2), ("electronics", 2), ("books", 1)]


def test_first_last_push_by_order(products):
    spec = {"_id": "$category", "f": {"$first": "$name"}, "l": {"$last": "$name"}, "all": {"$push": "$quantity"}}
    up = {r["_id"]: (r.f, r.l, r["all"]) for r in aggregate(products, [{"$group": spec}]).collect()}
    assert up["clothing"] == ("Product 3", "Product 4", [3, 4])
    down = {r["_id"]: (r.f, r.l, r["all"]) for r in aggregate(products, [{"$sort": {"price": -1}}, {"$group": spec}]).collect()}
    assert down["clothing"] == ("Product 4", "Product 3", [4, 3])


def test_push_and_set_keep_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", 2), ("c", 2)], "_id string, x int")
    r = aggregate(df, [{"$group": {"_id": None, "p": {"$push": "$x"}, "s": {"$addToSet": "$x"}}}]).first()
    assert (r.p, r.s) == ([None, 2, 2], [None, 2])


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        ({"data.a": None}, ["e2", "e3", "e6", "e7", "e8"]),
        ({"data.a": {"$ne": 1}}, ["e2", "e3", "e4", "e5", "e6", "e7", "e8"]),
        ({"data.a": {"$gt": 0}}, ["e1", "e5"]),
        ({"data.a": {"$exists": True}}, ["e1", "e2", "e4", "e5"]),
        ({"data.a": {"$nin": [1]}}, ["e2", "e3", "e4", "e5", "e6", "e7", "e8"]),
        ({"data.a": {"$in": [None, "1"]}}, ["e2", "e3", "e4", "e6", "e7", "e8"]),
        ({"data.o.k": 1}, ["e8"]),
        ({"$gt": {"data.a": 2}}, ["e5"]),
        ({"$nor": [{"data.a": 1}, {"data.a": "1"}]}, ["e2", "e3", "e5", "e6", "e7", "e8"]),
        ({"data.a": {"$type": "string"}}, ["e4"]),
    ],
)
def test_variant_predicates(edge, spec, expected):
    assert ids(aggregate(edge, [{"$match": spec}])) == expected


def test_unwind(spark):
    df = spark.createDataFrame([("a", [10, 20]), ("b", []), ("c", None)], "_id string, arr array<int>")
    assert rows(aggregate(df, [{"$unwind": {"path": "$arr", "includeArrayIndex": "i"}}, {"$sort": {"i": 1}}])) == [("a", 10, 0), ("a", 20, 1)]
    kept = rows(aggregate(df, [{"$unwind": {"path": "$arr", "preserveNullAndEmptyArrays": True}}]))
    assert sorted(r[0] for r in kept) == ["a", "a", "b", "c"]


def test_lookup_matches_nulls(spark):
    a = spark.createDataFrame([("1", 1), ("2", None), ("3", 9)], "_id string, k int")
    b = spark.createDataFrame([("x", 1), ("y", 1), ("z", None)], "_id string, fk int")
    out = aggregate(a, [{"$lookup": {"from": "b", "localField": "k", "foreignField": "fk", "as": "m"}}], {"b": b})
    assert {r["_id"]: [m["_id"] for m in r.m] for r in out.collect()} == {"1": ["x", "y"], "2": ["z"], "3": []}
    none = aggregate(a, [{"$lookup": {"from": "nowhere", "localField": "k", "foreignField": "fk", "as": "m"}}], {})
    assert all(r.m == [] for r in none.collect())


def test_project_and_expressions(products):
    out = aggregate(products, [{"$match": {"_id": "p2"}}, {"$project": {
        "d": {"$divide": ["$price", 0]}, "m": {"$mod": [-7, 3]}, "c": {"$concat": ["a", "$missing", "$category"]}, "s": {"$substr": ["$name", 2, 100]}, "neg": {"$substr": ["$name", -1, 2]},
        "t": {"$type": "$price"}, "i": {"$toInt": 2.9}, "b": {"$toBool": "$quantity"}, "lit": "plain", "n": {"$ifNull": ["$nothing", "$name"]}, "add": {"$add": ["$price", "$name"]}}}]).first()
    assert (out.d, out.m, out.c, out.s, out.neg) == (None, -1.0, "aelectronics", "oduct 2", None)
    assert (out.t, out.i, out.b, out.lit, out.n, out["add"]) == ("number", 2, True, "plain", "Product 2", None)


def test_substr_counts_bytes(spark):
    df = spark.createDataFrame([("a", "éa")], "_id string, s string")
    assert rows(aggregate(df, [{"$project": {"x": {"$substr": ["$s", 2, 1]}}}])) == [("a",)]


def test_facet_takes_upstream_rows(products):
    r = aggregate(products, [{"$match": {"price": {"$gt": 200}}}, {"$facet": {"n": [{"$count": "n"}], "by": [{"$sortByCount": "$category"}]}}]).first()
    assert [x.n for x in r.n] == [3] and [x["_id"] for x in r.by] == ["clothing", "books"]


def test_replace_root_and_elem_match(spark):
    df = spark.createDataFrame([("a", {"k": 1}, [1, 5]), ("b", None, [2])], "_id string, o struct<k:int>, xs array<int>")
    assert rows(aggregate(df, [{"$replaceRoot": "$o"}])) == [(1,)]
    assert ids(aggregate(df, [{"$match": {"xs": {"$elemMatch": {"$gt": 3}}}}])) == ["a"]
    assert ids(aggregate(df, [{"$match": {"xs": {"$all": [1, 5], "$size": 2}}}])) == ["a"]


def test_bad_pipelines_are_refused(products):
    for bad in ([{"$nope": 1}], [{"$match": {}, "$sort": {}}], ["x"], [{"$match": {"a": {"$bogus": 1}}}]):
        with pytest.raises(ValueError):
            aggregate(products, bad)
    assert parse('[{"$limit": 3}]') == [("$limit", 3)]


def test_filters_reach_the_scan(spark, products, tmp_path):
    products.write.parquet(str(tmp_path / "p"))
    plan = explain(spark.read.parquet(str(tmp_path / "p")), [{"$match": {"price": {"$gt": 150}, "category": {"$ne": "books"}}}, {"$project": {"name": 1}}])
    assert "GreaterThan(price,150" in plan and "ReadSchema: struct<name:string,price:double,category:string>" in plan


def test_catalog(spark, products):
    c = CollectionCatalog(spark)
    p = c.create("products", products)
    with pytest.raises(CollectionExists):
        c.create("products", products)
    assert c.list() == ["products"] and p.count() == 5
    assert ids(p.find({"category": "books"})) == ["p5"] and p.find({"nothing": None}).count() == 0
    assert sorted(r[0] for r in p.distinct("category").collect()) == ["books", "clothing", "electronics"]
    p.create_index("category")
    assert p.explain({"category": "books"})["path"] == "index_scan" and p.explain({"price": 1.0})["path"] == "full_scan"
    out = c.batch([{"collection": "products", "method": "count"}, {"collection": "none", "method": "count"}, {"collection": "products", "method": "count"}])
    assert [o["ok"] for o in out] == [True, False]
