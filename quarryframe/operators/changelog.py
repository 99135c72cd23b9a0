"""A change log (lsn, tx_id, type, ts_ns, collection, key, old, new) and what can be rebuilt from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = "lsn long, tx_id string, type string, ts_ns long, collection string, key string, old string, new string"
WRITES = ("INSERT", "UPDATE", "DELETE")


def committed(log: DataFrame, until_lsn: int | None = None, until_ns: int | None = None) -> DataFrame:
    """The writes of transactions that committed, up to a number or time. Those that were in flight or aborted leave nothing."""
    seen = log
    if until_lsn is not None:
        seen = seen.filter(F.col("lsn") <= until_lsn)
    if until_ns is not None:
        seen = seen.filter(F.col("ts_ns") <= until_ns)
    done = seen.filter(F.col("type") == "COMMIT").select("tx_id").distinct()
    return seen.filter(F.col("type").isin(*WRITES)).join(done, "tx_id", "left_semi")


def recover(log: DataFrame, until_lsn: int | None = None, until_ns: int | None = None) -> DataFrame:
    """(collection, key, value): the state after the last committed write of each key; deleted keys are gone. One
    aggregation with partial results, not a sort of the log."""
    last = committed(log, until_lsn, until_ns).groupBy("collection", "key").agg(F.max_by(F.struct("type", "new"), "lsn").alias("last"))
    return last.filter(F.col("last.type") != "DELETE").select("collection", "key", F.col("last.new").alias("value"))


def in_flight(log: DataFrame) -> DataFrame:
    """Transactions that neither committed nor aborted: those that recovery aborts."""
    ends = log.groupBy("tx_id").agg(F.bool_or(F.col("type").isin("COMMIT", "ABORT")).alias("ended"))
    return ends.filter(~F.col("ended")).select("tx_id")


class Overlay:
    """A transaction's buffered writes over a collection; nothing shows outside until commit."""

    def __init__(self, current: DataFrame, key: str = "_id"):
        self.current, self.key, self.steps = current, key, []

    def insert(self, rows: DataFrame) -> None:
        self.steps.append(("insert", rows))

    def patch(self, rows: DataFrame) -> None:
        self.steps.append(("patch", rows))

    def delete(self, keys: DataFrame) -> None:
        self.steps.append(("delete", keys))

    def commit(self) -> DataFrame:
        from . import writes

        out = self.current
        for name, rows in self.steps:
            out = getattr(writes, name)(out, rows, key=self.key)
        self.steps = []
        return out

    def rollback(self) -> DataFrame:
        self.steps = []
        return self.current
