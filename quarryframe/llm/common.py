"""Helpers that the corpus operators share: table access, the shared work folder and checks of input columns."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach. It is the cluster's spark.checkpoint.dir; where that is unset and Spark runs in
    one process, as in tests, a folder is made once and set."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not at:
        at = getattr(shared_dir, "own", None)
        if at is None:
            at = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def work_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here and a lost executor costs nothing
    that is already written."""
    path = work_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of plans that are done with. Spark deletes them when the driver's JVM collects these plans, which
    on a quiet driver may take as long as the job; so it is asked to, where much was shuffled."""
    gc.collect()
    spark._jvm.System.gc()


def local_path(uri: str) -> str:
    """file:// addresses as plain paths; others unchanged."""
    for prefix in ("file://", "file:"):
        if uri.startswith(prefix):
            return uri[len(prefix) :]
    return uri


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """The named columns only, cast. They are found by exact name and taken by position, so that further columns, also such
    as differ by letter case only or repeat a name, never reach the operator."""
    names = df.columns
    missing = [n for n in wanted if n not in names]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {names}")
    safe = df.toDF(*[f"c{i}" for i in range(len(names))])
    return safe.select(*[F.col(f"c{names.index(n)}").cast(kind).alias(n) for n, kind in wanted.items()])


#: Keys up to this count are broadcast (some 40 MB); more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def keep_rows(df: DataFrame, flags: DataFrame, key: str, how: str = "left_semi", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of df, with all its columns under their own names, whose key is (left_semi) or isn't (left_anti) among the
    distinct keys in flags."""
    names = df.columns
    at = f"c{names.index(key)}"
    safe = df.toDF(*[f"c{i}" for i in range(len(names))])
    flags = stored(flags.select(F.col(key).alias("_key")), "flags")
    if flags.limit(broadcast_keys + 1).count() <= broadcast_keys:
        flags = F.broadcast(flags)
    return safe.join(flags, F.col(at).eqNullSafe(F.col("_key")), how).toDF(*names)


def bytes_of(col: Column) -> Column:
    """UTF-8 bytes of a text, empty for null."""
    return F.encode(F.coalesce(col, F.lit("")), "UTF-8")


def total_bytes(df: DataFrame, name: str) -> int:
    return df.agg(F.sum(F.octet_length(name))).first()[0] or 0


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished Parquet folders below path (those with _SUCCESS), sorted."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def path_exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def delete_dir(spark: SparkSession, path: str) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
