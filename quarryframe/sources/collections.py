"""Reading and writing collections: JSON documents, exports with their manifest, Parquet, and binary vector files."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from urllib.parse import parse_qsl

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Schema


def read_json(spark: SparkSession, path: str, schema: T.StructType | Schema | None = None, multi_line: bool = False) -> DataFrame:
    """JSON documents; without a schema they come as one VARIANT column, data, beside _id, which no pass over the data is
    needed for."""
    if schema is None:
        raw = spark.read.text(path, wholetext=multi_line).filter(F.length(F.trim("value")) > 0)
        v = raw.select(F.try_parse_json("value").alias("data")).filter(F.col("data").isNotNull())
        if multi_line:
            v = v.select(F.explode(F.try_variant_get("data", "$", "array<variant>")).alias("data"))
        return v.select(F.try_variant_get("data", "$._id", "string").alias("_id"), "data")
    struct_type = schema.struct() if isinstance(schema, Schema) else schema
    return spark.read.schema(struct_type).option("multiLine", multi_line).json(path)


def export_collection(df: DataFrame, path: str, name: str, schema: Schema | None = None) -> None:
    """Documents as JSON lines in parallel, and a manifest beside them."""
    df.write.mode("overwrite").json(f"{path}/documents")
    manifest = {"name": name, "hasSchema": schema is not None, "schema": json.loads((schema.struct() if schema else df.schema).json())}
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def import_collection(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(name, documents) of an export; documents that don't parse are skipped."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    schema = T.StructType.fromJson(manifest["schema"])
    return manifest["name"], spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}/documents")


def parse_find(query: str) -> dict:
    """The find of a query string: name=value with text values, filter={json}; names that start with _ are left out and later
    entries win."""
    out: dict = {}
    for name, value in parse_qsl(query, keep_blank_values=True):
        if name == "filter":
            out |= json.loads(value)
        elif not name.startswith("_"):
            out[name] = value
    return out


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(_id, vector) of binary files of little-endian records: id length, id, dimensions, 32-bit floats."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("content"):
                data, at, ids, vectors = blob.as_py(), 0, [], []
                while at < len(data):
                    (n,) = struct.unpack_from("<I", data, at)
                    ids.append(data[at + 4 : at + 4 + n].decode())
                    at += 4 + n
                    (d,) = struct.unpack_from("<I", data, at)
                    vectors.append(list(struct.unpack_from(f"<{d}f", data, at + 4)))
                    at += 4 + 4 * d
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], names=["_id", "vector"])

    return files.mapInArrow(parse, "_id string, vector array<float>")


def pack_vectors(rows: list[tuple[str, list[float]]]) -> bytes:
    """The binary form of some vectors."""
    out = b""
    for name, v in rows:
        raw = name.encode()
        out += struct.pack("<I", len(raw)) + raw + struct.pack(f"<I{len(v)}f", len(v), *v)
    return out


def pages(df: DataFrame, size: int) -> Iterator[list]:
    """A cursor: rows in lists of `size`, one partition at a time in the client's memory."""
    batch: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch
