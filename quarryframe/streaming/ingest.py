"""Streams: documents upserted batch by batch, pipelines over streams, progress and cancelling."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.stages import Context, Frame
from ..plans.pipeline import apply, parse

STATELESS = {"$match", "$project", "$addFields", "$set", "$unset", "$unwind", "$replaceRoot"}


def stream_pipeline(stream: DataFrame, pipeline: list, key: str = "_id") -> DataFrame:
    """Stages that need no state, over a stream."""
    wrong = [name for name, _ in parse(pipeline) if name not in STATELESS]
    if wrong:
        raise ValueError(f"these stages need all rows: {wrong}")
    return apply(Frame(stream, Context(key=key)), pipeline).df


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; rows later than the watermark are left out, and its state is dropped with it."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "_id", order: str | None = None) -> StreamingQuery:
    """Writes each micro-batch as a version folder below path: the last row of each key of the batch. A batch that runs again
    replaces its folder, so each has its effect once; latest() reads the newest version of each key."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch
        if order is not None:
            columns = [c for c in batch.columns if c != key]
            last = batch.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("r")).select(key, "r.*")
        else:
            last = batch.dropDuplicates([key])
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, schema: T.StructType, key: str = "_id") -> DataFrame:
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", path).parquet(path)
    columns = [c for c in schema.names if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(key, "r.*").select(*schema.names)


@dataclass
class Progress(StreamingQueryListener):
    """Counts of rows and batches of the running streams, by run."""

    seen: dict[str, dict[str, Any]] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.seen[str(event.runId)] = {"state": "running", "batches": 0, "rows": 0}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = self.seen.setdefault(str(event.progress.runId), {"state": "running", "batches": 0, "rows": 0})
        p["batches"] += 1
        p["rows"] += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.seen.setdefault(str(event.runId), {"batches": 0, "rows": 0})["state"] = "failed" if event.exception else "done"


def cancel(spark: SparkSession, tag: str) -> None:
    """Stops the jobs that run under a tag (spark.addTag)."""
    spark.interruptTag(tag)
