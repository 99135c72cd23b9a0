"""Queries over the driver's tables and their DuckDB counterparts.

Output columns are flat; doubles are rounded to 4 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Collection
from ..functions.analyzer import Analyzer, tokens
from ..functions.paths import Resolver
from ..functions.predicates import find_filter
from ..operators import advisor, changelog, policy, vector, writes
from ..operators.search import SearchRequest, build_index, fuzzy_terms, idf_unified, idf_v1, phrase_candidates, regex_candidates, score_terms, search, term_candidates
from ..operators.stages import Context, Frame, distinct_count, distinct_values, facet_frames
from ..schema import Schema, with_errors
from .pipeline import aggregate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey", "part": "p_partkey", "events": "event_id", "embeddings": "vec_id", "documents": "doc_id", "supplier": "s_suppkey"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 4) for n in names})


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def pipeline(name: str, table: str, stages: list, sql: str, *doubles: str, select: list[str] | None = None, with_tables: tuple[str, ...] = ()) -> None:
    """Registers a pipeline over a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        others = {t: load(spark, sf_dir, t) for t in with_tables}
        out = aggregate(load(spark, sf_dir, table), stages, others, KEYS[table])
        return rounded(out.selectExpr(*select) if select else out, *doubles)

    QUERIES[name], ORACLE[name] = run, sql


# predicates
pipeline("match_cmp", "orders", [{"$match": {"o_totalprice": {"$gte": 1000.0, "$lt": 150000}, "$gt": {"o_custkey": 100}, "o_orderstatus": "O"}}, {"$project": {"o_orderkey": True, "o_custkey": 1}}],
         "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 150000 AND o_custkey > 100 AND o_orderstatus = 'O'")
pipeline("match_or_nor", "customer", [{"$match": {"$or": [{"c_mktsegment": "BUILDING"}, {"c_acctbal": {"$lt": 0}}], "$nor": [{"c_nationkey": 3}, {"c_nationkey": {"$gt": 20}}]}}, {"$project": {"c_custkey": True}}],
         "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT coalesce(c_nationkey = 3 OR c_nationkey > 20, false)")
pipeline("match_and", "customer", [{"$match": {"$and": [{"c_nationkey": {"$gte": 5}}, {"c_nationkey": {"$lte": 9}}, {"c_acctbal": {"$gt": 100}}]}}, {"$project": {"c_custkey": 1}}],
         "SELECT c_custkey FROM customer WHERE c_nationkey BETWEEN 5 AND 9 AND c_acctbal > 100")
pipeline("match_in_nin", "orders", [{"$match": {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH", None]}, "o_orderstatus": {"$nin": ["F"]}}}, {"$project": {"o_orderkey": 1}}],
         "SELECT o_orderkey FROM orders WHERE (o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL) AND (o_orderstatus NOT IN ('F') OR o_orderstatus IS NULL)")
pipeline("match_null_ne", "orders", [{"$match": {"o_orderstatus": {"$ne": "O"}, "o_nothing": None}}, {"$project": {"o_orderkey": 1, "o_orderstatus": 1}}],
         "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O'")
pipeline("match_contains", "part", [{"$match": {"p_name": {"$regex": "a"}, "p_brand": {"$regex": "#1"}}}, {"$project": {"p_partkey": 1}}],
         "SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND contains(p_brand, '#1')")
pipeline("match_not_mod_type", "part", [{"$match": {"p_size": {"$not": {"$lt": 10}, "$mod": [3, 1], "$type": "number"}}}, {"$project": {"p_partkey": 1}}],
         "SELECT p_partkey FROM part WHERE NOT coalesce(p_size < 10, false) AND p_size % 3 = 1")
pipeline("match_expr", "orders", [{"$match": {"$expr": {"$and": [{"$gt": ["$o_totalprice", 1000]}, {"$ne": ["$o_orderkey", "$o_custkey"]}]}}}, {"$count": "n"}],
         "SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderkey IS DISTINCT FROM o_custkey")
pipeline("find_range_prefix", "part", [{"$match": {"p_partkey": {"$gte": 100, "$lte": 199}}}, {"$project": {"p_partkey": 1, "p_brand": 1}}],
         "SELECT p_partkey, p_brand FROM part WHERE p_partkey BETWEEN 100 AND 199")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_exists(props, '$.k') AND json_extract(props, '$.k')::DOUBLE >= 50")
def match_exists_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("props"))
    return aggregate(events, [{"$match": {"props.k": {"$exists": True, "$gte": 50}}}, {"$project": {"event_id": 1, "k": {"$toInt": "$props.k"}}}], key="event_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'")
def find_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return orders.filter(find_filter(Resolver(orders.schema), {"o_custkey": 7, "o_orderstatus": "O"})).select("o_orderkey")


# groups and accumulators
pipeline("group_multi", "lineitem", [
    {"$match": {"l_quantity": {"$lt": 45}, "l_discount": {"$gte": 0.05}}},
    {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "avg_price": {"$avg": "$l_extendedprice"}, "n": {"$sum": 1}}},
    {"$sort": {"_id": 1}}],
    "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*)::BIGINT AS n FROM lineitem WHERE l_quantity < 45 AND l_discount >= 0.05 GROUP BY ALL",
    "sum_qty", "avg_price", select=["_id.flag AS flag", "_id.status AS status", "sum_qty", "avg_price", "CAST(n AS BIGINT) AS n"])
pipeline("group_global", "orders", [{"$group": {"_id": None, "total": {"$sum": "$o_totalprice"}, "mean": {"$avg": "$o_totalprice"}, "n": {"$count": {}}}}],
         "SELECT round(sum(o_totalprice), 4) AS total, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders", "total", "mean", select=["total", "mean", "n"])
pipeline("group_minmax", "lineitem", [{"$group": {"_id": "$l_suppkey", "least": {"$min": "$l_extendedprice"}, "most": {"$max": "$l_extendedprice"}}}],
         'SELECT l_suppkey AS _id, round(min(l_extendedprice), 4) AS least, round(max(l_extendedprice), 4) AS "most" FROM lineitem GROUP BY 1', "least", "most")
pipeline("group_first_last", "orders", [{"$group": {"_id": "$o_custkey", "first_status": {"$first": "$o_orderstatus"}, "last_price": {"$last": "$o_totalprice"}}}],
         "SELECT o_custkey AS _id, arg_min(o_orderstatus, o_orderkey) AS first_status, round(arg_max(o_totalprice, o_orderkey), 4) AS last_price FROM orders GROUP BY 1", "last_price")
pipeline("group_push", "orders", [{"$match": {"o_custkey": {"$lt": 500}}}, {"$group": {"_id": "$o_custkey", "statuses": {"$push": "$o_orderstatus"}}}],
         "SELECT o_custkey AS _id, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS statuses FROM orders WHERE o_custkey < 500 GROUP BY 1", select=["_id", "array_join(statuses, ',') AS statuses"])
pipeline("group_push_all", "orders", [{"$group": {"_id": "$o_custkey", "statuses": {"$push": "$o_orderstatus"}}}],
         "SELECT o_custkey AS _id, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS statuses FROM orders GROUP BY 1", select=["_id", "array_join(statuses, ',') AS statuses"])
pipeline("group_addtoset", "orders", [{"$group": {"_id": "$o_custkey", "priorities": {"$addToSet": "$o_orderpriority"}}}],
         "SELECT o_custkey AS _id, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY 1", select=["_id", "array_join(priorities, ',') AS priorities"])
pipeline("group_stddev", "lineitem", [{"$group": {"_id": "$l_returnflag", "pop": {"$stdDevPop": "$l_quantity"}, "samp": {"$stdDevSamp": "$l_quantity"}}}],
         "SELECT l_returnflag AS _id, round(stddev_pop(l_quantity), 4) AS pop, round(stddev_samp(l_quantity), 4) AS samp FROM lineitem GROUP BY 1", "pop", "samp")
pipeline("group_operator_first", "orders", [{"$group": {"_id": "$o_orderstatus", "$sum": {"total": "$o_totalprice"}, "$avg": {"mean": "$o_totalprice"}}}],
         "SELECT o_orderstatus AS _id, round(sum(o_totalprice), 4) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1", "total", "mean")

# sorts, projections and expressions
pipeline("sort_skip_limit", "orders", [{"$sort": {"o_orderstatus": 1, "o_totalprice": -1}}, {"$skip": 20}, {"$limit": 50}, {"$project": {"o_orderkey": 1, "o_orderstatus": 1, "o_totalprice": 1}}],
         "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY orders.o_orderstatus ASC NULLS FIRST, orders.o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 20", "o_totalprice")
pipeline("top_k", "lineitem", [{"$sort": {"l_extendedprice": -1, "l_linenumber": 1}}, {"$limit": 25}, {"$project": {"l_orderkey": 1, "l_linenumber": 1}}],
         "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber NULLS FIRST, l_orderkey LIMIT 25")
pipeline("project_exprs", "lineitem", [{"$project": {"l_orderkey": 1, "l_linenumber": 1, "net": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}, "unit": {"$divide": ["$l_extendedprice", 7]}, "odd": {"$mod": ["$l_orderkey", 7]}, "sum": {"$add": ["$l_tax", "$l_discount"]}}}],
         'SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_extendedprice / 7, 4) AS unit, (l_orderkey % 7)::DOUBLE AS odd, round(l_tax + l_discount, 4) AS "sum" FROM lineitem', "net", "unit", "sum")
pipeline("string_exprs", "part", [{"$project": {"p_partkey": 1, "label": {"$concat": ["$p_brand", "/", {"$toLower": "$p_type"}]}, "up": {"$toUpper": "$p_name"}, "head": {"$substr": ["$p_name", 1, 4]}, "text": {"$toString": "$p_partkey"}}}],
         "SELECT p_partkey, p_brand || '/' || lower(p_type) AS label, upper(p_name) AS up, substr(p_name, 2, 4) AS head, p_partkey::VARCHAR AS text FROM part")
pipeline("cond_ifnull", "customer", [{"$project": {"c_custkey": 1, "class": {"$cond": {"cond": {"$gte": ["$c_acctbal", 5000]}, "then": "gold", "else": {"$cond": {"cond": {"$lt": ["$c_acctbal", 0]}, "then": "red", "else": "plain"}}}}, "segment": {"$ifNull": ["$c_mktsegment", "none"]}, "ghost": {"$ifNull": ["$c_nothing", 7]}}}],
         "SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'gold' WHEN c_acctbal < 0 THEN 'red' ELSE 'plain' END AS class, coalesce(c_mktsegment, 'none') AS segment, 7::BIGINT AS ghost FROM customer")
pipeline("array_exprs", "embeddings", [{"$project": {"vec_id": 1, "n": {"$size": "$embedding"}, "first": {"$toDouble": {"$arrayElemAt": ["$embedding", 0]}}, "last": {"$toDouble": {"$arrayElemAt": ["$embedding", -1]}}, "none": {"$toDouble": {"$arrayElemAt": ["$embedding", 999]}}}}],
         'SELECT vec_id, len(embedding)::BIGINT AS n, round(embedding[1]::DOUBLE, 4) AS "first", round(embedding[len(embedding)]::DOUBLE, 4) AS "last", NULL::DOUBLE AS "none" FROM embeddings', "first", "last", "none")
pipeline("convert_exprs", "orders", [{"$project": {"o_orderkey": 1, "whole": {"$toInt": "$o_totalprice"}, "dbl": {"$toDouble": "$o_custkey"}, "some": {"$toBool": "$o_custkey"}, "kind": {"$type": "$o_orderstatus"}, "nan": {"$toInt": "$o_orderstatus"}}}],
         "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS whole, o_custkey::DOUBLE AS dbl, coalesce(o_custkey <> 0, false) AS some, CASE WHEN o_orderstatus IS NULL THEN 'null' ELSE 'string' END AS kind, NULL::BIGINT AS nan FROM orders")
pipeline("date_exprs", "orders", [{"$project": {"o_orderkey": 1, "y": {"$year": "$o_orderdate"}, "m": {"$month": "$o_orderdate"}, "d": {"$dayOfMonth": "$o_orderdate"}, "h": {"$hour": "$o_orderdate"}, "mi": {"$minute": "$o_orderdate"}, "s": {"$second": "$o_orderdate"}}}],
         "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s FROM orders")
pipeline("list_exprs", "lineitem", [{"$project": {"l_orderkey": 1, "l_linenumber": 1, "low": {"$min": ["$l_tax", "$l_discount"]}, "high": {"$max": ["$l_tax", "$l_discount"]}, "both": {"$sum": ["$l_tax", "$l_discount", "$l_comment"]}, "mean": {"$avg": ["$l_tax", "$l_discount"]}}}],
         "SELECT l_orderkey, l_linenumber, round(least(l_tax, l_discount), 4) AS low, round(greatest(l_tax, l_discount), 4) AS high, round(coalesce(l_tax, 0) + coalesce(l_discount, 0), 4) AS both, round((l_tax + l_discount) / 2, 4) AS mean FROM lineitem", "low", "high", "both", "mean")
pipeline("unset_set", "customer", [{"$set": {"double": {"$multiply": ["$c_acctbal", 2]}}}, {"$unset": ["c_name", "c_mktsegment"]}, {"$addFields": {"plus": {"$add": ["$double", 1]}}}, {"$project": {"c_name": 0, "c_acctbal": False}}],
         'SELECT c_custkey, c_nationkey, round(c_acctbal * 2, 4) AS "double", round(c_acctbal * 2 + 1, 4) AS plus FROM customer', "double", "plus")
pipeline("count_stage", "events", [{"$match": {"event_type": {"$ne": "view"}}}, {"$count": "total"}], "SELECT count(*) AS total FROM events WHERE event_type IS DISTINCT FROM 'view'")
pipeline("sort_by_count", "events", [{"$sortByCount": "$event_type"}], 'SELECT event_type AS _id, count(*) AS "count" FROM events GROUP BY 1')

# joins and arrays
pipeline("lookup_orders", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "found"}}, {"$project": {"c_custkey": 1, "n": {"$size": "$found"}}}],
         "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey IS NOT DISTINCT FROM o_custkey GROUP BY 1", with_tables=("orders",))
pipeline("lookup_unwind_sum", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "found"}}, {"$unwind": "$found"}, {"$group": {"_id": "$c_mktsegment", "total": {"$sum": "$found.o_totalprice"}, "n": {"$count": {}}}}],
         "SELECT c_mktsegment AS _id, round(sum(o_totalprice), 4) AS total, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1", "total", with_tables=("orders",))
pipeline("unwind_embedding", "embeddings", [{"$unwind": {"path": "$embedding", "includeArrayIndex": "at"}}, {"$project": {"vec_id": 1, "at": 1, "x": {"$toDouble": "$embedding"}}}],
         "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS at, round(unnest(embedding)::DOUBLE, 4) AS x FROM embeddings", "x")
pipeline("unwind_preserve", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "found"}}, {"$unwind": {"path": "$found", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "at"}}, {"$project": {"c_custkey": 1, "at": 1, "o_orderkey": "$found.o_orderkey"}}],
         "SELECT c_custkey, CASE WHEN o_orderkey IS NULL THEN NULL ELSE row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 END AS at, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", with_tables=("orders",))
pipeline("bucket_price", "orders", [{"$bucket": {"groupBy": "$o_totalprice", "boundaries": [0, 1, 50000, 150000, 300000], "default": "other", "output": {"total": {"$sum": "$o_totalprice"}}}}],
         """SELECT b._id, count(o_orderkey) AS "count", round(sum(o_totalprice), 4) AS total FROM (VALUES ('0', 0, 1), ('1', 1, 50000), ('50000', 50000, 150000), ('150000', 150000, 300000)) b(_id, lo, hi)
         LEFT JOIN orders ON o_totalprice >= lo AND o_totalprice < hi GROUP BY 1
         UNION ALL SELECT 'other', count(*), round(sum(o_totalprice), 4) FROM orders WHERE (o_totalprice < 0 OR o_totalprice >= 300000 OR o_totalprice IS NULL) HAVING count(*) > 0""", "total")  # fmt: skip


@query("SELECT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_totalprice > 200000")
def replace_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").withColumn("inner", F.when(F.col("o_totalprice") > 200000, F.struct(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))))
    return aggregate(orders, [{"$replaceRoot": {"newRoot": "$inner"}}], key="o_orderkey")


@query("SELECT 'status' AS facet, o_orderstatus AS _id, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders WHERE o_totalprice > 1000 GROUP BY 2")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrays of $facet taken apart again."""
    stages = [{"$match": {"o_totalprice": {"$gt": 1000}}}, {"$facet": {"status": [{"$sortByCount": "$o_orderstatus"}], "priority": [{"$sortByCount": "$o_orderpriority"}]}}]
    one = aggregate(load(spark, sf_dir, "orders"), stages, key="o_orderkey")
    parts = [one.select(F.lit(name).alias("facet"), F.explode(name).alias("r")).select("facet", "r._id", F.col("r.count").alias("n")) for name in ("status", "priority")]
    return parts[0].unionByName(parts[1])


@query("SELECT 'a' AS facet, count(*) AS n FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'b', count(DISTINCT l_suppkey) FROM lineitem")
def facet_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = facet_frames(Frame(load(spark, sf_dir, "lineitem"), Context(key="l_orderkey")), {"a": [{"$match": {"l_quantity": {"$gt": 40}}}, {"$count": "n"}], "b": [{"$group": {"_id": "$l_suppkey"}}, {"$count": "n"}]})
    return frames["a"].df.select(F.lit("a").alias("facet"), "n").unionByName(frames["b"].df.select(F.lit("b").alias("facet"), "n"))


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def distinct_values_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(Frame(load(spark, sf_dir, "customer"), Context(key="c_custkey")), "c_mktsegment")


# vectors
PROBE = [round(((i * 37) % 64 - 32) / 64, 4) for i in range(64)]
PROBE_SQL = "[" + ", ".join(map(str, PROBE)) + "]::DOUBLE[]"
SCORES = {"cosine": "list_cosine_similarity(embedding::DOUBLE[], {q})", "euclidean": "1 / (1 + list_distance(embedding::DOUBLE[], {q}))", "dot": "list_inner_product(embedding::DOUBLE[], {q})"}


def _knn(name: str, metric: str, where: str = "true", limit: int = 10, least: float | None = None, condition=None) -> None:
    s = SCORES[metric].format(q=PROBE_SQL)
    inner = f"SELECT vec_id, {s} AS score FROM embeddings WHERE {where} ORDER BY score DESC, vec_id LIMIT {limit}"
    ORACLE[name] = f"SELECT vec_id, round(score, 4) AS score FROM ({inner})" + (f" WHERE score >= {least}" if least is not None else "")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cond = condition() if condition else None
        return rounded(vector.knn(load(spark, sf_dir, "embeddings"), "embedding", PROBE, limit, metric, cond, least, key="vec_id").select("vec_id", "score"), "score")

    QUERIES[name] = run


_knn("knn_cosine", "cosine")
_knn("knn_euclid", "euclidean")
_knn("knn_dot", "dot")
_knn("knn_filtered", "cosine", "label = 3", condition=lambda: F.col("label") == 3)
_knn("knn_minscore", "cosine", limit=50, least=0.05)

COS = SCORES["cosine"].format(q=PROBE_SQL)
pipeline("vector_match_group", "embeddings", [{"$vectorMatch": {"field": "embedding", "vector": PROBE, "topK": 100}}, {"$group": {"_id": "$label", "n": {"$count": {}}, "avg_score": {"$avgVectorScore": {}}, "max_score": {"$maxVectorScore": {}}, "min_score": {"$minVectorScore": {}}}}],
         f"SELECT label AS _id, count(*) AS n, round(avg(s), 4) AS avg_score, round(greatest(max(s), 0), 4) AS max_score, round(min(s), 4) AS min_score FROM (SELECT label, {COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 100) GROUP BY 1", "avg_score", "max_score", "min_score")


@query("SELECT label, (pos - 1)::INTEGER AS pos, round(avg(x), 4) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate(load(spark, sf_dir, "embeddings"), [{"$group": {"_id": "$label", "c": {"$centroid": "$embedding"}}}], key="vec_id")
    return rounded(out.select(F.col("_id").alias("label"), F.posexplode("c").alias("pos", "x")), "x")


@query(f"SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {COS} DESC, vec_id) AS r FROM embeddings) WHERE r <= 3")
def topn_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [{"$vectorMatch": {"field": "embedding", "vector": PROBE, "topK": 1_000_000_000}}, {"$group": {"_id": "$label", "best": {"$topN": {"by": "vectorScore", "n": 3}}}}]
    out = aggregate(load(spark, sf_dir, "embeddings"), stages, key="vec_id")
    return out.select(F.col("_id").alias("label"), F.explode("best").alias("b")).select("label", "b.vec_id")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS n FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(load(spark, sf_dir, "embeddings").select("vec_id", vector.norm(F.col("embedding")).alias("n")), "n")


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate(load(spark, sf_dir, "embeddings"), [{"$vectorCluster": {"field": "embedding", "k": 4, "maxIterations": 20}}], key="vec_id")
    return out.select("clusterId", "documentCount")


@query()
def semantic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate(load(spark, sf_dir, "embeddings"), [{"$semanticGroup": {"vectorField": "embedding", "similarityThreshold": 0.3}}], key="vec_id")
    return out.select("semanticGroup", "documentCount")


# full text
PLAIN = Analyzer("english", stemming=False)


def _stop(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _tokens_sql(kind: str, table: str = "documents") -> str:
    from ..functions.analyzer import PLAIN_STOPWORDS, STOPWORDS

    if kind == "v1":
        return f"SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+'), lambda x: octet_length(encode(x)) >= 2 AND NOT list_contains({_stop(STOPWORDS)}, x)) AS t FROM {table}"
    return f"SELECT doc_id, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'), lambda x: NOT list_contains({_stop(PLAIN_STOPWORDS)}, x)) AS t FROM {table}"


def _bm25_sql(kind: str, terms: list[str], limit: int | None = 20) -> str:
    idf = "ln((n - df + 0.5) / (df + 0.5) + 1)" if kind == "v1" else "ln((n - df) / df + 1)"
    return f"""WITH d AS ({_tokens_sql(kind)}), l AS (SELECT doc_id, len(t)::DOUBLE AS dl FROM d WHERE len(t) > 0), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM l),
    x AS (SELECT doc_id, unnest(t) AS term FROM d), p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM x WHERE term IN ({", ".join("'" + t + "'" for t in terms)}) GROUP BY ALL), f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY 1),
    r AS (SELECT doc_id, sum({idf} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM p JOIN f USING (term) JOIN l USING (doc_id), s GROUP BY 1)
    SELECT doc_id, round(score, 4) AS score FROM r""" + (f" ORDER BY r.score DESC, doc_id LIMIT {limit}" if limit else "")


@query(f"SELECT doc_id, len(t)::BIGINT AS n FROM ({_tokens_sql('v1')})")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"), PLAIN)).cast("long").alias("n"))


@query(_bm25_sql("v1", ["tion", "erat", "heon"]))
def bm25_v1_nostem(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(load(spark, sf_dir, "documents"), ["text"], PLAIN, "doc_id")
    out = score_terms(index, ["tion", "erat", "heon"], idf_v1)
    return rounded(out.orderBy(F.desc("score"), "doc").limit(20).select(F.col("doc").alias("doc_id"), "score"), "score")


@query(_bm25_sql("v2", ["tion", "erat", "heon"], None))
def bm25_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(load(spark, sf_dir, "documents"), ["text"], Analyzer("standard"), "doc_id")
    return rounded(score_terms(index, ["tion", "erat", "heon"], idf_unified).select(F.col("doc").alias("doc_id"), "score"), "score")


@query()
def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(load(spark, sf_dir, "documents"), ["text"], Analyzer(), "doc_id")
    return search(index, SearchRequest("tion heating", limit=50)).select(F.col("doc").alias("doc_id"), "score")


@query(f"WITH x AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM ({_tokens_sql('v1')})) SELECT DISTINCT a.doc_id FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'orre' AND b.term = 'orre'")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(load(spark, sf_dir, "documents"), ["text"], PLAIN, "doc_id")
    return phrase_candidates(index, ["orre", "orre"]).select(F.col("doc").alias("doc_id"))


@query(f"SELECT DISTINCT term FROM (SELECT unnest(t) AS term FROM ({_tokens_sql('v2')})) WHERE levenshtein(term, 'heation') <= 1")
def fuzzy_terms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(load(spark, sf_dir, "documents"), ["text"], Analyzer("standard"), "doc_id")
    return fuzzy_terms(index, ["heation"], 1)


@query(f"SELECT doc_id, count(*)::DOUBLE AS score FROM (SELECT doc_id, unnest(t) AS term FROM ({_tokens_sql('v2')})) WHERE regexp_matches(term, '^thean.*n$') GROUP BY 1")
def regex_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(load(spark, sf_dir, "documents"), ["text"], Analyzer("standard"), "doc_id")
    return regex_candidates(index, "^thean.*n$").select(F.col("doc").alias("doc_id"), "score")


# fusion: documents and embeddings by id, text and vector candidates
def _hybrid(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    index = build_index(load(spark, sf_dir, "documents"), ["text"], Analyzer("standard"), "doc_id")
    text = score_terms(index, ["tion", "erat", "heon"], idf_unified).orderBy(F.desc("score"), "doc").limit(100)
    near = vector.knn(load(spark, sf_dir, "embeddings"), "embedding", PROBE, 100, key="vec_id")
    return {"text": text.select(F.col("doc").alias("_id"), "score"), "vector": near.select(F.col("vec_id").alias("_id"), "score")}


def _hybrid_sql(text: str, near: str) -> str:
    t = _bm25_sql("v2", ["tion", "erat", "heon"], 100).replace("round(score, 4)", "score")
    return f"SELECT _id, round(sum(s), 4) AS score FROM (SELECT doc_id AS _id, {text} AS s FROM ({t}) UNION ALL SELECT vec_id, {near} FROM (SELECT vec_id, {COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 100)) GROUP BY 1"


@query(_hybrid_sql("score", "score"))
def hybrid_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector.fuse(_hybrid(spark, sf_dir), "sum"), "score")


@query(_hybrid_sql("0.3 * score", "0.7 * score"))
def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector.fuse(_hybrid(spark, sf_dir), "weighted", {"text": 0.3, "vector": 0.7}), "score")


@query(_hybrid_sql("1 / (60 + 1 / (score + 0.01))", "1 / (60 + 1 / (score + 0.01))"))
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector.fuse(_hybrid(spark, sf_dir), "rrf"), "score")


# writes, recovery, validation, policy and advice
@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, 'NEW' FROM customer WHERE c_acctbal < 0")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = base.filter("c_acctbal < 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), "c_acctbal")
    more = new.withColumn("c_custkey", F.col("c_custkey") + 10000000)
    return writes.upsert(base, new.unionByName(more), "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer")
def patch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    changes = base.filter("c_nationkey = 5").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment"))
    return writes.patch(base, changes, "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'")
def delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return writes.delete(orders, orders.filter("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey").select("o_orderkey")


LOG_SQL = """log AS (
  SELECT 10 * o_orderkey AS lsn, 't' || o_orderkey AS tx, CASE WHEN o_orderkey % 3 = 0 THEN 'DELETE' WHEN o_orderkey % 3 = 1 THEN 'INSERT' ELSE 'UPDATE' END AS type, 'k' || o_custkey AS key, o_orderkey::VARCHAR AS v FROM orders
  UNION ALL SELECT 10 * o_orderkey + 1, 't' || o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'ABORT' ELSE 'COMMIT' END, NULL, NULL FROM orders WHERE o_orderkey % 11 <> 0)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    tx = F.concat(F.lit("t"), k.cast("string"))
    kind = F.when(k % 3 == 0, "DELETE").when(k % 3 == 1, "INSERT").otherwise("UPDATE")
    ops = o.select((k * 10).alias("lsn"), tx.alias("tx_id"), kind.alias("type"), k.alias("ts_ns"), F.lit("c").alias("collection"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("key"), F.lit(None).cast("string").alias("old"), k.cast("string").alias("new"))
    ends = o.filter(k % 11 != 0).select((k * 10 + 1).alias("lsn"), tx.alias("tx_id"), F.when(k % 7 == 0, "ABORT").otherwise("COMMIT").alias("type"), k.alias("ts_ns"), F.lit("c").alias("collection"), *[F.lit(None).cast("string").alias(c) for c in ("key", "old", "new")])
    return ops.unionByName(ends)


@query(f"WITH {LOG_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS r FROM log WHERE type IN ('INSERT', 'UPDATE', 'DELETE') AND tx IN (SELECT tx FROM log WHERE type = 'COMMIT')) SELECT key, v AS value FROM w WHERE r = 1 AND type <> 'DELETE'")
def recover_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.recover(_log(spark, sf_dir)).select("key", "value")


@query(f"WITH {LOG_SQL}, s AS (SELECT * FROM log WHERE lsn <= 50000), w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS r FROM s WHERE type IN ('INSERT', 'UPDATE', 'DELETE') AND tx IN (SELECT tx FROM s WHERE type = 'COMMIT')) SELECT key, v AS value FROM w WHERE r = 1 AND type <> 'DELETE'")
def recover_to_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.recover(_log(spark, sf_dir), until_lsn=50000).select("key", "value")


@query("SELECT event_id, ((event_type NOT IN ('click', 'view'))::INT + (value IS NULL)::INT + (user_id IS NULL)::INT)::BIGINT AS n FROM events")
def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Schema.parse({"fields": {"event_type": {"type": "string", "enum": ["click", "view"]}, "value": {"type": "number", "required": True}, "user_id": {"type": "integer", "required": True}}})
    return with_errors(load(spark, sf_dir, "events"), schema).select("event_id", F.size("errors").cast("long").alias("n"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def policy_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [policy.Rule("sales/*", ("read",), fields=("c_name",)), policy.Rule("sales/customer", ("*",), fields=("c_nationkey",))]
    return policy.visible(load(spark, sf_dir, "customer"), rules, "sales/customer", key="c_custkey")


@query("""WITH l AS (SELECT event_type AS field, user_id % 5 = 0 AS w, value AS ms, event_id % 4 <> 0 AS full_scan FROM events),
s AS (SELECT field, count(*) FILTER (WHERE NOT w)::DOUBLE AS q, count(*) FILTER (WHERE NOT w AND full_scan)::DOUBLE AS f, count(*) FILTER (WHERE w)::DOUBLE AS wr FROM l GROUP BY 1)
SELECT field, round(q * (f / q) * 0.1 * 50 - wr * 0.5, 4) AS benefit_ms FROM s WHERE q >= 100 AND f / q >= 0.5 AND q * (f / q) * 0.1 * 50 - wr * 0.5 > 0 ORDER BY 2 DESC, 1 LIMIT 5""")
def index_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").select(F.lit("c").alias("collection"), F.col("event_type").alias("field"), F.when(F.col("user_id") % 5 == 0, "write").otherwise("query").alias("kind"), (F.col("event_id") % 4 != 0).alias("full_scan"), F.col("value").alias("ms"))
    return rounded(advisor.advise(log).select("field", "benefit_ms"), "benefit_ms")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def top_lines_per_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top rows per group, the form that $topN lowers to."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return load(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


# requests of the collections' interfaces
@query("SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
def find_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collection("part", load(spark, sf_dir, "part"), key="p_partkey").find_prefix("p_brand", "Brand#1").select("p_partkey", "p_brand")


@query('SELECT count(DISTINCT c_mktsegment) AS "count" FROM customer')
def distinct_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_count(Frame(load(spark, sf_dir, "customer"), Context(key="c_custkey")), "c_mktsegment")


@query("SELECT c_custkey, c_nationkey FROM customer UNION ALL SELECT c_custkey + 10000000, c_nationkey FROM customer WHERE c_acctbal < 0")
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return writes.insert(base, base.filter("c_acctbal < 0").withColumn("c_custkey", F.col("c_custkey") + 10000000), key="c_custkey").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'MOVED' ELSE c_name END AS c_name FROM customer")
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return writes.update(base, base.filter("c_nationkey = 7").withColumn("c_name", F.lit("MOVED")), key="c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collection("customer", load(spark, sf_dir, "customer"), key="c_custkey").get(42).select("c_custkey", "c_name")


@query(f"WITH {LOG_SQL} SELECT tx AS tx_id FROM log GROUP BY 1 HAVING count(*) FILTER (WHERE type IN ('COMMIT', 'ABORT')) = 0")
def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.in_flight(_log(spark, sf_dir))


@query("""SELECT event_type AS field, count(*) FILTER (WHERE user_id % 5 <> 0) AS queries, count(*) FILTER (WHERE user_id % 5 <> 0 AND event_id % 4 <> 0) AS full_scans, count(*) FILTER (WHERE user_id % 5 = 0) AS writes,
round(avg(value) FILTER (WHERE user_id % 5 <> 0), 4) AS avg_ms FROM events GROUP BY 1""")
def query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").select(F.lit("c").alias("collection"), F.col("event_type").alias("field"), F.when(F.col("user_id") % 5 == 0, "write").otherwise("query").alias("kind"), (F.col("event_id") % 4 != 0).alias("full_scan"), F.col("value").alias("ms"))
    return rounded(advisor.query_stats(log).select("field", "queries", "full_scans", "writes", "avg_ms"), "avg_ms")


@query("SELECT count(*) AS n_rows, count(embedding) AS n_vectors, min(len(embedding)) AS least_dimensions, max(len(embedding)) AS most_dimensions, round(avg(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 4) AS mean_norm, round(max(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 4) AS largest_norm FROM embeddings")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector.vector_stats(load(spark, sf_dir, "embeddings"), "embedding"), "mean_norm", "largest_norm")


@query(f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(t) AS term FROM ({_tokens_sql('v1')})) WHERE term IN ('tion', 'heon')")
def search_any_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(load(spark, sf_dir, "documents"), ["text"], PLAIN, "doc_id")
    return term_candidates(index, ["tion", "heon"]).select(F.col("doc").alias("doc_id"))


@query(_bm25_sql("v1", ["tion", "erat", "heon"], None).replace("SELECT doc_id, round(score, 4) AS score FROM r", "SELECT doc_id, round(score, 4) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 15 OFFSET 10"))
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(load(spark, sf_dir, "documents"), ["text"], PLAIN, "doc_id")
    return rounded(search(index, SearchRequest("tion erat heon", limit=15, offset=10)).select(F.col("doc").alias("doc_id"), "score"), "score")


@query(f"SELECT doc_id, count(*)::DOUBLE AS score FROM (SELECT doc_id, unnest(t) AS term FROM ({_tokens_sql('v1')})) WHERE regexp_matches(term, '^thean.*n$') GROUP BY 1 ORDER BY count(*) DESC, doc_id LIMIT 20")
def search_regex_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(load(spark, sf_dir, "documents"), ["text"], PLAIN, "doc_id")
    return search(index, SearchRequest(regex="^thean.*n$")).select(F.col("doc").alias("doc_id"), "score")


def _fused_sql(method: str, where: str = "true") -> str:
    near = f"SELECT vec_id, {COS} AS s FROM embeddings WHERE {where} ORDER BY s DESC, vec_id LIMIT 50"
    far = f"SELECT vec_id, {SCORES['dot'].format(q=PROBE_SQL)} AS s FROM embeddings WHERE {where} ORDER BY s DESC, vec_id LIMIT 50"
    part = "s" if method == "sum" else "1 / (60 + row_number() OVER (ORDER BY s DESC, vec_id))"
    return f"SELECT _id, round(sum(x), 4) AS score FROM (SELECT vec_id AS _id, {part} AS x FROM ({near}) UNION ALL SELECT vec_id, {part} FROM ({far})) GROUP BY 1"


@query(_fused_sql("rank"))
def hybrid_rrf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    parts = {m: vector.knn(rows, "embedding", PROBE, 50, m, key="vec_id").select(F.col("vec_id").alias("_id"), "score") for m in ("cosine", "dot")}
    return rounded(vector.fuse(parts, "rrf_rank"), "score")


@query(f"""WITH f AS (SELECT vec_id, 1.0 AS s FROM embeddings WHERE label = 3), n AS (SELECT vec_id, {COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 30), u AS (SELECT vec_id, sum(s) AS score FROM (FROM f UNION ALL FROM n) GROUP BY 1)
SELECT vec_id, round(score, 4) AS score FROM u ORDER BY u.score DESC, vec_id LIMIT 25 OFFSET 5""")
def unified_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector.unified_query(load(spark, sf_dir, "embeddings"), {"label": 3}, {"field": "embedding", "vector": PROBE, "topK": 30}, limit=25, offset=5, key="vec_id")
    return rounded(out.select("vec_id", "score"), "score")


@query(f"""WITH t AS ({_bm25_sql("v2", ["tion", "heon"], 40).replace("round(score, 4)", "score")}) SELECT doc_id, round(0.5 * score, 4) AS "hybridScore" FROM t""")
def hybrid_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = aggregate(docs, [{"$hybridSearch": {"text": {"field": "text", "query": "tion heon", "limit": 40}}}], key="doc_id")
    return rounded(out.select("doc_id", "hybridScore"), "hybridScore")
