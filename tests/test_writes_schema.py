"""Validation, writes, recovery, policy, advice, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quarryframe.catalog import CollectionCatalog
from quarryframe.operators import changelog, writes
from quarryframe.operators.advisor import advise, query_stats
from quarryframe.operators.policy import Rule, allowed, matches, visible
from quarryframe.schema import Schema, validate, with_defaults, with_errors
from quarryframe.sources.collections import export_collection, import_collection, pack_vectors, pages, parse_find, read_json, read_vectors
from quarryframe.streaming.ingest import latest, sessions, stream_pipeline, upsert_stream, windowed_counts

STRICT = {"strict": True, "fields": {"name": {"type": "string", "required": True}, "email": {"type": "string", "required": True}, "age": {"type": "integer", "required": True}}}


def test_validation(spark):
    df = spark.createDataFrame([("1", "A", "a@x", 3.0), ("2", "Invalid", None, None), ("3", "B", "b@x", 2.5)], "_id string, name string, email string, age double")
    ok, bad = validate(df, Schema.parse(STRICT))
    assert [r["_id"] for r in ok.collect()] == ["1"]
    errors = {r["_id"]: [e.message for e in r.errors] for r in bad.collect()}
    assert "age is required" in errors["2"] and errors["3"] == ["age must be of type integer"]
    extra = df.withColumn("more", F.lit(1))
    assert validate(extra, Schema.parse(STRICT))[0].count() == 0


def test_declared_rules_are_optional(spark):
    schema = Schema.parse({"fields": {"n": {"type": "number", "minimum": 2, "maximum": 3}, "s": {"type": "string", "minLength": 2, "maxLength": 3, "default": "xx"}, "v": {"type": "vector", "dimensions": 2}}})
    df = spark.createDataFrame([(1.0, "a", [1.0, 2.0]), (2.5, "abcd", [1.0])], "n double, s string, v array<double>")
    assert [len(r.errors) for r in with_errors(df, schema).collect()] == [0, 1]
    assert [len(r.errors) for r in with_errors(df, schema, enforce_declared=True).collect()] == [2, 2]
    assert with_defaults(spark.createDataFrame([(None,)], "s string"), schema).first()[0] == "xx"
    for bad in ({"type": "nope"}, {"type": "vector", "dimensions": 0}, {"type": "vector", "distanceMetric": "invalid_metric"}):
        with pytest.raises(ValueError):
            Schema.parse({"fields": {"x": bad}})


@pytest.fixture()
def base(spark):
    return spark.createDataFrame([("1", "a", 1), ("2", "b", None)], "_id string, s string, n int")


def state(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_writes(spark, base):
    new = spark.createDataFrame([("3", "c", 3)], base.schema)
    assert len(state(writes.insert(base, new))) == 3
    with pytest.raises(writes.DuplicateKey):
        writes.insert(base, base)
    with pytest.raises(writes.DuplicateKey):
        writes.insert(base, new.union(new))
    with pytest.raises(writes.MissingKey):
        writes.update(base, new)
    assert state(writes.upsert(base, spark.createDataFrame([("2", "z", 9)], base.schema))) == [("1", "a", 1), ("2", "z", 9)]
    assert state(writes.patch(base, spark.createDataFrame([("2", 7)], "_id string, n int"))) == [("1", "a", 1), ("2", "b", 7)]
    cleared = spark.createDataFrame([("1", None, True)], "_id string, n int, present__n boolean")
    assert state(writes.patch(base, cleared)) == [("1", "a", None), ("2", "b", None)]
    assert state(writes.delete(base, spark.createDataFrame([("1",)], "_id string"))) == [("2", "b", None)]
    with pytest.raises(writes.Invalid):
        writes.insert(base, new, Schema.parse({"fields": {"n": {"type": "string"}}}))


def test_update_keeps_creation(spark):
    cur = spark.createDataFrame([("1", "a", "then")], "_id string, s string, _createdAt string")
    new = spark.createDataFrame([("1", "b", "now")], "_id string, s string, _createdAt string")
    assert [(r.s, r["_createdAt"]) for r in writes.update(cur, new).collect()] == [("b", "then")]


def test_recovery(spark):
    log = spark.createDataFrame(
        [(1, "t1", "INSERT", 10, "c", "a", None, "1"), (2, "t1", "COMMIT", 11, "c", None, None, None), (3, "t2", "UPDATE", 12, "c", "a", "1", "2"), (4, "t3", "DELETE", 13, "c", "a", "1", None), (5, "t3", "COMMIT", 14, "c", None, None, None), (6, "t4", "INSERT", 15, "c", "b", None, "x"), (7, "t4", "ABORT", 16, "c", None, None, None)],
        changelog.COLUMNS,
    )
    assert changelog.recover(log).collect() == []
    assert [(r.key, r.value) for r in changelog.recover(log, until_lsn=3).collect()] == [("a", "1")]
    assert [(r.key, r.value) for r in changelog.recover(log, until_ns=13).collect()] == [("a", "1")]
    assert [r[0] for r in changelog.in_flight(log).collect()] == ["t2"]


def test_overlay(spark, base):
    tx = changelog.Overlay(base)
    tx.insert(spark.createDataFrame([("3", "c", 3)], base.schema))
    tx.delete(spark.createDataFrame([("1",)], "_id string"))
    assert base.count() == 2 and sorted(r[0] for r in tx.commit().collect()) == ["2", "3"]
    tx.delete(spark.createDataFrame([("2",)], "_id string"))
    assert tx.rollback().count() == 2


def test_policy(spark):
    assert matches("a/*/c", "a/b/c") and not matches("a/*/c", "a/b/d") and matches("a/*", "a/b/c")
    rules = [Rule("products", ("read",), fields=("name",)), Rule("secret", effect="deny")]
    df = spark.createDataFrame([("1", "n", 2.0)], "_id string, name string, price double")
    assert visible(df, rules, "products").columns == ["_id", "name"]
    assert not allowed([Rule("*"), *rules], "secret", "read")
    with pytest.raises(PermissionError):
        visible(df, rules, "products", "write")


def test_advice(spark):
    log = spark.createDataFrame([("c", "hot", "query", True, 5.0)] * 120 + [("c", "cold", "query", True, 5.0)] * 10 + [("c", "busy", "query", True, 1.0)] * 100 + [("c", "busy", "write", False, 1.0)] * 2000, "collection string, field string, kind string, full_scan boolean, ms double")
    out = advise(log).collect()
    assert [(r.field, r.benefit_ms) for r in out] == [("hot", 600.0)]
    assert {r.field: r.queries for r in query_stats(log).collect()} == {"hot": 120, "cold": 10, "busy": 100}


def test_sources(spark, tmp_path):
    assert parse_find("a=1&_x=2&filter=%7B%22b%22%3A2%7D&a=3") == {"a": "3", "b": 2}
    p = tmp_path / "docs.json"
    p.write_text("\n".join([json.dumps({"_id": "1", "a": {"b": 2}}), "broken", json.dumps({"_id": "2"})]))
    df = read_json(spark, str(p))
    assert sorted(r[0] for r in df.select("_id").collect()) == ["1", "2"]
    assert CollectionCatalog(spark).create("x", df).aggregate([{"$match": {"data.a.b": 2}}]).count() == 1
    base = spark.createDataFrame([("1", 2.5), ("2", None)], "_id string, n double")
    export_collection(base, str(tmp_path / "out"), "things")
    name, back = import_collection(spark, str(tmp_path / "out"))
    assert name == "things" and state(back.select("_id", "n")) == state(base)
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.bin").write_bytes(pack_vectors([("é", [1.0, 2.5]), ("b", [])]))
    assert {r["_id"]: r["vector"] for r in read_vectors(spark, str(tmp_path / "v")).collect()} == {"é": [1.0, 2.5], "b": []}
    assert [len(p) for p in pages(spark.range(5).coalesce(1), 2)] == [2, 2, 1]


def test_clustered_layout(spark, tmp_path):
    c = CollectionCatalog(spark).create("n", spark.range(100).withColumnRenamed("id", "_id"))
    c.write_clustered(str(tmp_path / "n"), "_id")
    assert spark.read.parquet(str(tmp_path / "n")).count() == 100


def test_stream_upserts(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    schema = "_id string, n int"
    spark.createDataFrame([("a", 1), ("b", 1)], schema).coalesce(1).write.parquet(str(src / "one"))
    kind = spark.createDataFrame([], schema).schema
    stream = spark.readStream.schema(kind).parquet(str(src / "*"))
    upsert_stream(stream_pipeline(stream, [{"$match": {"n": {"$gt": 0}}}]), str(out), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("a", 5), ("c", 0)], schema).coalesce(1).write.parquet(str(src / "two"))
    upsert_stream(stream_pipeline(stream, [{"$match": {"n": {"$gt": 0}}}]), str(out), str(tmp_path / "cp")).awaitTermination()
    assert state(latest(spark, str(out), kind)) == [("a", 5), ("b", 1)]
    with pytest.raises(ValueError):
        stream_pipeline(stream, [{"$sort": {"n": 1}}])


def test_windows(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "x"), ("2024-01-01 00:02:00", "x"), ("2024-01-01 00:07:00", "x"), ("2024-01-01 03:00:00", "y")]
    spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("t"), "k").coalesce(1).write.parquet(str(tmp_path / "e"))
    batch = spark.read.parquet(str(tmp_path / "e"))
    assert sorted(r.n for r in windowed_counts(batch, "t", "k").collect()) == [1, 1, 2]
    assert sorted(r.n for r in sessions(batch, "t", "k").collect()) == [1, 3]
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e"))
    q = windowed_counts(stream, "t", "k").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]
