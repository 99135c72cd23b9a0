"""Declared schemas: a StructType with rules in its fields' metadata, and validation as one projection."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.paths import Resolver, Typed, as_number, quoted
from .functions.predicates import type_name

TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "fulltext": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.VariantType()),
    "object": T.VariantType(), "any": T.VariantType(), "vector": T.ArrayType(T.FloatType()), "embedding": T.ArrayType(T.FloatType()), "null": T.NullType(),
}


@dataclass(frozen=True)
class Field:
    type: str
    required: bool = False
    enum: tuple = ()
    dimensions: int | None = None
    analyzer: str | None = None
    index: bool = False
    index_type: str = "btree"
    metric: str = "cosine"
    default: Any = None
    min_length: int | None = None
    max_length: int | None = None
    minimum: float | None = None
    maximum: float | None = None

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"unknown field type: {self.type}")
        if self.type in ("vector", "embedding") and self.dimensions is not None and self.dimensions <= 0:
            raise ValueError("dimensions must be positive")
        if self.metric not in ("cosine", "euclidean", "dot"):
            raise ValueError(f"unknown metric {self.metric}")


@dataclass(frozen=True)
class Schema:
    fields: dict[str, Field] = field(default_factory=dict)
    strict: bool = False

    @classmethod
    def parse(cls, spec: dict) -> Schema:
        names = {"enum": "enum", "dimensions": "dimensions", "analyzer": "analyzer", "index": "index", "indexType": "index_type", "distanceMetric": "metric", "required": "required", "default": "default", "minLength": "min_length", "maxLength": "max_length", "minimum": "minimum", "maximum": "maximum"}
        fields = {}
        for name, f in spec.get("fields", {}).items():
            more = {names[k]: tuple(v) if k == "enum" else v for k, v in f.items() if k in names}
            fields[name] = Field(f.get("type", "any"), **more)
        return cls(fields, bool(spec.get("strict", False)))

    @classmethod
    def restore(cls, saved: dict) -> Schema:
        """From dataclasses.asdict, after a way through JSON."""
        return cls({n: Field(**{**f, "enum": tuple(f["enum"])}) for n, f in saved["fields"].items()}, saved["strict"])

    def struct(self) -> T.StructType:
        """As a Spark schema, the rules in the metadata."""
        out = []
        for name, f in self.fields.items():
            rules = {k: list(v) if isinstance(v, tuple) else v for k, v in vars(f).items() if v not in (None, False, ())}
            out.append(T.StructField(name, TYPES[f.type], not f.required, {"rules": rules}))
        return T.StructType(out)


def _fits(v: Typed, kind: str) -> Column:
    """Whether a value that is there has the declared type."""
    if kind == "any":
        return F.lit(True)
    if kind == "null":
        return F.lit(False)
    if kind in ("string", "fulltext"):
        return type_name(v) == "string"
    if kind == "number":
        return type_name(v) == "number"
    if kind == "integer":
        x = as_number(v)
        return F.coalesce(x == F.floor(x), F.lit(False))
    if kind == "boolean":
        return type_name(v) == "bool"
    if kind == "object":
        return type_name(v) == "object"
    return type_name(v) == "array"


def rules(schema: Schema, df: DataFrame, enforce_declared: bool = False) -> list[tuple[str, str, Column]]:
    """(field, message, broken) for each rule of a schema on a frame."""
    r, out = Resolver(df.schema), []
    for name, f in schema.fields.items():
        v = r.get(name)
        there = F.lit(False) if v.is_missing else v.col.isNotNull() & (~F.is_variant_null(v.col) if v.is_variant else F.lit(True))
        if f.required:
            out.append((name, f"{name} is required", ~there))
        if v.is_missing:
            continue
        out.append((name, f"{name} must be of type {f.type}", there & ~_fits(v, f.type)))
        if f.enum:
            from .functions.predicates import is_in

            out.append((name, f"{name} must be one of the allowed values", there & ~F.coalesce(is_in(v, list(f.enum)), F.lit(False))))
        if f.dimensions is not None and isinstance(v.type, T.ArrayType):
            out.append((name, f"{name} must have {f.dimensions} dimensions", there & (F.size(v.col) != f.dimensions)))
        if enforce_declared:
            n, size = as_number(v), F.char_length(v.col) if v.is_string else F.lit(None)
            for limit, broken, text in ((f.min_length, size < F.lit(f.min_length), "is too short"), (f.max_length, size > F.lit(f.max_length), "is too long"), (f.minimum, n < F.lit(f.minimum), "is too small"), (f.maximum, n > F.lit(f.maximum), "is too large")):
                if limit is not None:
                    out.append((name, f"{name} {text}", there & F.coalesce(broken, F.lit(False))))
    if schema.strict:
        for c in df.columns:
            if c not in schema.fields and not c.startswith("_"):
                out.append((c, f"{c} is not allowed in a strict schema", F.col(quoted(c)).isNotNull()))
    return out


def with_errors(df: DataFrame, schema: Schema, enforce_declared: bool = False) -> DataFrame:
    """df with errors: an array of (field, message), empty for valid rows."""
    found = [F.when(broken, F.struct(F.lit(name).alias("field"), F.lit(message).alias("message"))) for name, message, broken in rules(schema, df, enforce_declared)]
    kind = "array<struct<field:string,message:string>>"
    return df.withColumn("errors", F.filter(F.array(*found), lambda x: x.isNotNull()).cast(kind) if found else F.array().cast(kind))


def validate(df: DataFrame, schema: Schema | None, enforce_declared: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with errors)."""
    if schema is None:
        return df, df.filter(F.lit(False)).withColumn("errors", F.array().cast("array<struct<field:string,message:string>>"))
    checked = with_errors(df, schema, enforce_declared)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def with_defaults(df: DataFrame, schema: Schema) -> DataFrame:
    known = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({n: F.coalesce(F.col(quoted(n)), F.lit(f.default).cast(known[n])) for n, f in schema.fields.items() if f.default is not None and n in known})
