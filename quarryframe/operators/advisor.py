"""Query statistics and index advice over a table of query logs (collection, field, kind, full_scan, ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SELECTIVITY, SAVED_MS, WRITE_MS = 0.1, 50.0, 0.5


def query_stats(log: DataFrame) -> DataFrame:
    """Per collection and field: queries, full scans, hit rate and mean time; writes."""
    query = F.col("kind") == "query"
    return log.groupBy("collection", "field").agg(
        F.count_if(query).alias("queries"), F.count_if(query & F.col("full_scan")).alias("full_scans"),
        F.avg(F.when(query, F.col("ms"))).alias("avg_ms"), F.count_if(F.col("kind") == "write").alias("writes"),
    ).withColumn("hit_rate", F.when(F.col("queries") > 0, 1 - F.col("full_scans") / F.col("queries")).otherwise(F.lit(0.0)))


def advise(log: DataFrame, min_queries: int = 100, min_ratio: float = 0.5, top: int = 5, min_confidence: float = 0.6, indexed: tuple[str, ...] = ()) -> DataFrame:
    """The fields whose index would save most: queries * full-scan share * selectivity * 50 ms - writes * 0.5 ms. The share is
    also the confidence in the advice. Fields in indexed have an index."""
    s = query_stats(log).withColumn("ratio", F.when(F.col("queries") > 0, F.col("full_scans") / F.col("queries")).otherwise(F.lit(0.0)))
    s = s.withColumn("benefit_ms", F.col("queries") * F.col("ratio") * SELECTIVITY * SAVED_MS - F.col("writes") * WRITE_MS)
    good = s.filter((F.col("queries") >= min_queries) & (F.col("ratio") >= max(min_ratio, min_confidence)) & (F.col("benefit_ms") > 0) & ~F.col("field").isin(list(indexed)))
    return good.orderBy(F.desc("benefit_ms"), "collection", "field").limit(top)
