"""Named collections: their rows, schema, indexes and statistics."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import Resolver
from .functions.predicates import find_filter
from .operators import writes
from .operators.search import SearchRequest, TextIndex, build_index, search
from .operators.stages import Context, Frame, distinct_values
from .operators.vector import knn, unified_query, vector_stats
from .plans.pipeline import apply
from .schema import Schema


class CollectionExists(ValueError):
    pass


class NoCollection(KeyError):
    pass


@dataclass
class Collection:
    """A version of a collection's rows is a DataFrame; a write puts the next one in its place."""

    name: str
    df: DataFrame
    schema: Schema | None = None
    key: str = "_id"
    indexes: dict[str, str] = field(default_factory=dict)
    text_index: TextIndex | None = None
    catalog: CollectionCatalog | None = None

    def insert(self, rows: DataFrame) -> None:
        self._next(writes.insert(self.df, rows, self.schema, self.key))

    def update(self, rows: DataFrame) -> None:
        self._next(writes.update(self.df, rows, self.schema, self.key))

    def patch(self, rows: DataFrame) -> None:
        self._next(writes.patch(self.df, rows, self.key))

    def delete(self, keys: DataFrame) -> None:
        self._next(writes.delete(self.df, keys, self.key))

    def clear(self) -> None:
        self._next(self.df.filter(F.lit(False)))

    def _next(self, df: DataFrame) -> None:
        self.df = df
        if self.text_index is not None:
            self.create_text_index(self.text_fields, self.text_index.analyzer)

    def get(self, key: Any) -> DataFrame:
        return self.df.filter(F.col(self.key) == F.lit(key)).limit(1)

    def find(self, query: dict) -> DataFrame:
        """Rows whose top-level fields equal all entries."""
        return self.df.filter(find_filter(Resolver(self.df.schema), query))

    def find_prefix(self, name: str, prefix: str) -> DataFrame:
        """Rows whose text in a field starts with a prefix; a scan takes it as a filter."""
        return self.df.filter(F.col(name).startswith(prefix))

    def count(self) -> int:
        return self.df.count()

    def distinct(self, name: str) -> DataFrame:
        return distinct_values(Frame(self.df, Context(key=self.key)), name)

    def aggregate(self, pipeline: str | list) -> DataFrame:
        others = {n: c.df for n, c in self.catalog.collections.items()} if self.catalog else {}
        return apply(Frame(self.df, Context(others, self.key)), pipeline).df

    def create_index(self, name: str, kind: str = "btree") -> None:
        """Metadata: scans prune by statistics. index_layout() writes rows so that they can."""
        if kind not in ("btree", "hash"):
            raise ValueError(f"unknown index type {kind}")
        self.indexes[name] = kind

    def drop_index(self, name: str) -> None:
        self.indexes.pop(name, None)

    def write_clustered(self, path: str, name: str) -> None:
        """Rows as Parquet in the order of an indexed field, so that its predicates skip row groups."""
        self.df.repartitionByRange(name).sortWithinPartitions(name).write.mode("overwrite").parquet(path)

    def create_text_index(self, fields: list[str], analyzer=None) -> TextIndex:
        self.text_fields = fields
        self.text_index = build_index(self.df, fields, *([analyzer] if analyzer else []), key=self.key)
        return self.text_index

    def search(self, request: SearchRequest | dict) -> DataFrame:
        if self.text_index is None:
            raise ValueError("the collection has no text index")
        request = SearchRequest.parse(request) if isinstance(request, dict) else request
        return search(self.text_index, request, self.df, self.key)

    def nearest(self, vector: str, query: list[float], **more: Any) -> DataFrame:
        dims = self.schema.fields[vector].dimensions if self.schema and vector in self.schema.fields else None
        return knn(self.df, vector, query, key=self.key, dimensions=dims, **more)

    def query(self, **more: Any) -> DataFrame:
        return unified_query(self.df, key=self.key, **more)

    def stats(self) -> dict:
        vectors = [n for n, f in (self.schema.fields.items() if self.schema else ()) if f.dimensions]
        more = {n: vector_stats(self.df, n).first().asDict() for n in vectors if n in self.df.columns}
        return {"vectors": more, "name": self.name, "count": self.count(), "hasSchema": self.schema is not None, "indexes": dict(self.indexes), "hasTextIndex": self.text_index is not None}

    def explain(self, query: dict) -> dict:
        """Which access path a find would take, with the plan that Spark makes of it."""
        indexed = [k for k in query if k in self.indexes]
        df = self.find(query)
        plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return {"path": "index_scan" if indexed else "full_scan", "index": indexed[0] if indexed else None, "plan": plan}


@dataclass
class CollectionCatalog:
    spark: SparkSession
    collections: dict[str, Collection] = field(default_factory=dict)

    def create(self, name: str, df: DataFrame, schema: Schema | dict | None = None, key: str = "_id") -> Collection:
        if name in self.collections:
            raise CollectionExists(name)
        schema = Schema.parse(schema) if isinstance(schema, dict) else schema
        self.collections[name] = Collection(name, df, schema, key, catalog=self)
        return self.collections[name]

    def get(self, name: str) -> Collection:
        if name not in self.collections:
            raise NoCollection(name)
        return self.collections[name]

    def import_rows(self, name: str, df: DataFrame, schema: Schema | dict | None = None, key: str = "_id", overwrite: bool = False) -> Collection:
        """A collection from rows; one of that name is only replaced where told so."""
        if overwrite:
            self.collections.pop(name, None)
        return self.create(name, df, schema, key)

    def save(self, path: str) -> None:
        """All collections below path: rows as Parquet, and key, schema and indexes beside them."""
        for name, c in self.collections.items():
            c.df.write.mode("overwrite").parquet(f"{path}/{name}/rows")
            about = json.dumps({"key": c.key, "schema": asdict(c.schema) if c.schema else None, "indexes": c.indexes})
            self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}/about")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CollectionCatalog:
        """The collections that save() wrote below path."""
        out = cls(spark)
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root):
            at = s.getPath().toString()
            about = json.loads("".join(r[0] for r in spark.read.text(f"{at}/about").collect()))
            c = out.create(s.getPath().getName(), spark.read.parquet(f"{at}/rows"), Schema.restore(about["schema"]) if about["schema"] else None, about["key"])
            c.indexes = about["indexes"]
        return out

    def list(self) -> list[str]:
        return sorted(self.collections)

    def drop(self, name: str) -> None:
        self.get(name)
        del self.collections[name]

    def batch(self, requests: list[dict], continue_on_error: bool = False) -> list[dict]:
        """Requests {"collection", "method", "args"} one after the other; stops at the first failure unless told to go on."""
        out = []
        for r in requests:
            try:
                out.append({"ok": True, "result": getattr(self.get(r["collection"]), r["method"])(*r.get("args", []))})
            except Exception as e:  # the caller sees each failure
                out.append({"ok": False, "error": f"{type(e).__name__}: {e}"})
                if not continue_on_error:
                    break
        return out
