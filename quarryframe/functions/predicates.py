"""$match conditions as boolean Columns.

Both spellings are accepted: {"price": {"$gt": 10}} and {"$gt": {"price": 10}}. Missing and null are one; comparing values of
different kinds is false. A Column may be null where false is meant: filters treat both alike and can then push the bare
comparison into the scan; wherever a condition is negated, null is made false first.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import Resolver, Typed, as_boolean, as_number, as_string, is_nil, variant_type

COMPARE = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
FIELD_OPERATORS = {"$eq", "$ne", *COMPARE, "$in", "$nin", "$exists", "$regex", "$not", "$type", "$mod", "$all", "$elemMatch", "$size"}
TYPE_NAMES = {"string", "number", "bool", "array", "object", "null"}


def is_plain_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def equals(v: Typed, value: Any) -> Column:
    """v == value; never true across kinds, true for null and missing."""
    if value is None:
        return is_nil(v)
    if v.is_missing:
        return F.lit(False)
    if isinstance(value, bool):
        return as_boolean(v) == F.lit(value) if v.is_variant or isinstance(v.type, T.BooleanType) else F.lit(False)
    if is_plain_number(value):
        return v.col == F.lit(value) if v.is_number else as_number(v) == F.lit(float(value)) if v.is_variant else F.lit(False)
    if isinstance(value, str):
        if v.is_time:
            return v.col == F.try_to_timestamp(F.lit(value)).cast(v.type)
        return v.col == F.lit(value) if v.is_string else as_string(v) == F.lit(value) if v.is_variant else F.lit(False)
    if isinstance(value, (list, tuple)) and isinstance(v.type, T.ArrayType):
        return v.col == F.array(*[F.lit(x) for x in value]).cast(v.type)
    return F.lit(False)


def compares(v: Typed, op: str, value: Any) -> Column:
    """Numbers with numbers and strings with strings, bytewise; timestamps with their text."""
    method = COMPARE[op]
    if is_plain_number(value):
        return getattr(v.col, method)(F.lit(value)) if v.is_number else getattr(as_number(v), method)(F.lit(float(value)))
    if isinstance(value, str):
        if v.is_time:
            return getattr(v.col, method)(F.try_to_timestamp(F.lit(value)).cast(v.type))
        return getattr(v.col if v.is_string else as_string(v), method)(F.lit(value))
    return F.lit(False)


def is_in(v: Typed, values: list) -> Column:
    if v.is_missing:
        return F.lit(any(x is None for x in values))
    plain = [x for x in values if (is_plain_number(x) if v.is_number else isinstance(x, str) if v.is_string else False)]
    parts = [v.col.isin(plain)] if plain else []
    rest = [x for x in values if x is None or not (v.is_number or v.is_string)]
    parts += [equals(v, x) for x in rest]
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def certainly(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def negated(v: Typed, c: Column, nil_matches: bool) -> Column:
    """not c, also for missing values unless c names them; as an OR that a scan can take. Where c may be null though the value
    isn't (a text that is no time, elements that are null), null is made false first."""
    if v.is_missing or not (v.is_number or v.is_string or isinstance(v.type, T.BooleanType)):
        return ~certainly(c)
    return v.col.isNotNull() & ~c if nil_matches else v.col.isNull() | ~c


def type_name(v: Typed) -> Column:
    """string, number, bool, array, object or null."""
    if v.is_variant:
        t = variant_type(v)
        known = F.when(t == "STRING", "string").when(t == "BOOLEAN", "bool").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"), "number")
        return F.when(is_nil(v), "null").otherwise(F.coalesce(known, F.lit("unknown")))
    kinds = [(T.NumericType, "number"), (T.BooleanType, "bool"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object"), ((T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType), "string")]
    name = next((n for kind, n in kinds if isinstance(v.type, kind)), "unknown")
    return F.lit("null") if v.is_missing else F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(name))


def field_condition(r: Resolver, path: str, op: str, value: Any) -> Column:
    v = r.get(path)
    if op == "$eq":
        return equals(v, value)
    if op == "$ne":
        return negated(v, equals(v, value), value is None)
    if op in COMPARE:
        return compares(v, op, value)
    if op == "$in":
        return is_in(v, list(value))
    if op == "$nin":
        return negated(v, is_in(v, list(value)), any(x is None for x in value))
    if op == "$exists":
        return r.exists(path) if value else ~r.exists(path)
    if op == "$regex":  # containment, as evaluated
        return as_string(v).contains(F.lit(value))
    if op == "$not":
        return ~certainly(field(r, path, value))
    if op == "$type":
        return type_name(v) == F.lit(value)
    if op == "$mod":
        return as_number(v) % F.lit(float(value[0])) == F.lit(float(value[1]))
    if op == "$size":
        return F.size(v.col) == F.lit(int(value)) if isinstance(v.type, T.ArrayType) else F.lit(False)
    if op == "$all":
        if not isinstance(v.type, T.ArrayType):
            return F.lit(False)
        return reduce(lambda a, b: a & b, [_holds(v, w) for w in value], F.lit(True))
    if op == "$elemMatch":
        if not isinstance(v.type, T.ArrayType):
            return F.lit(False)
        return F.exists(v.col, lambda x: certainly(_element(x, v.type.elementType, value)))
    raise ValueError(f"unknown operator {op}")


def _holds(v: Typed, value: Any) -> Column:
    return F.exists(v.col, lambda x: certainly(equals(Typed(x, v.type.elementType), value)))


def _element(x: Column, kind: T.DataType, spec: dict) -> Column:
    if isinstance(kind, T.StructType) and not any(k in FIELD_OPERATORS for k in spec):
        inner = _Lambda(x, kind)
        return reduce(lambda a, b: a & b, [field(inner, k, w) for k, w in spec.items()], F.lit(True))
    inner = _Lambda(x, T.StructType([T.StructField("x", kind)]), whole=True)
    return field(inner, "x", spec)


class _Lambda(Resolver):
    """Paths below a lambda's variable."""

    def __init__(self, x: Column, schema: T.StructType, whole: bool = False):
        super().__init__(schema)
        self.x, self.whole = x, whole

    def get(self, path: str) -> Typed:
        if self.whole:
            return Typed(self.x, self.schema.fields[0].dataType)
        at = Typed(self.x, self.schema)
        for part in path.split("."):
            inner = {f.name: f for f in at.type.fields} if isinstance(at.type, T.StructType) else {}
            if part not in inner:
                return Typed(F.lit(None), T.NullType())
            at = Typed(at.col.getField(part), inner[part].dataType)
        return at


def field(r: Resolver, path: str, spec: Any) -> Column:
    """One field-first entry."""
    if isinstance(spec, dict):
        unknown = [k for k in spec if k not in FIELD_OPERATORS]
        if unknown:
            raise ValueError(f"unknown operators {unknown} for {path}")
        return reduce(lambda a, b: a & b, [field_condition(r, path, op, v) for op, v in spec.items()], F.lit(True))
    return equals(r.get(path), spec)


def match(r: Resolver, spec: dict) -> Column:
    """All entries of a condition together."""
    parts: list[Column] = []
    for key, value in spec.items():
        if key == "$and":
            parts += [match(r, s) for s in value]
        elif key == "$or":
            if value:
                parts.append(reduce(lambda a, b: a | b, [match(r, s) for s in value]))
        elif key == "$nor":
            parts += [~certainly(match(r, s)) for s in value]
        elif key == "$not":
            parts.append(~certainly(match(r, value)))
        elif key == "$expr":
            from .expressions import condition

            parts.append(condition(r, value))
        elif key in FIELD_OPERATORS:
            parts += [field_condition(r, path, key, operand) for path, operand in value.items()]
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            parts.append(field(r, key, value))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def find_filter(r: Resolver, query: dict) -> Column:
    """Equality of every entry, top-level names only; a name that isn't there matches nothing."""
    parts = []
    for name, value in query.items():
        known = {f.name: f for f in r.schema.fields}
        parts.append(equals(Typed(F.col(f"`{name}`"), known[name].dataType), value) if name in known else F.lit(False))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
