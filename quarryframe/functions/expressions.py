"""Scalar expressions of $project, $addFields and $cond as Columns; null wherever the operands have the wrong kind."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import Resolver, Typed, as_boolean, as_number, as_string, is_nil, missing
from .predicates import certainly, equals, is_plain_number, type_name

DOUBLE, STRING, LONG, BOOL = T.DoubleType(), T.StringType(), T.LongType(), T.BooleanType()


def literal(x: Any) -> Typed:
    if x is None:
        return missing()
    if isinstance(x, bool):
        return Typed(F.lit(x), BOOL)
    if isinstance(x, int):
        return Typed(F.lit(x).cast("long"), LONG)
    if isinstance(x, float):
        return Typed(F.lit(x), DOUBLE)
    if isinstance(x, str):
        return Typed(F.lit(x), STRING)
    if isinstance(x, (list, tuple)):
        items = [literal(i) for i in x]
        kind = items[0].type if items else STRING
        return Typed(F.array(*[i.col.cast(kind) for i in items]) if items else F.array().cast("array<string>"), T.ArrayType(kind))
    if isinstance(x, dict):
        items = {k: literal(v) for k, v in x.items()}
        return Typed(F.struct(*[v.col.alias(k) for k, v in items.items()]), T.StructType([T.StructField(k, v.type) for k, v in items.items()]))
    raise ValueError(f"not a literal: {x!r}")


def value(r: Resolver, spec: Any) -> Typed:
    """"$path" is a field, other strings are themselves, objects are expressions."""
    if isinstance(spec, str) and spec.startswith("$"):
        return r.get(spec.lstrip("$"))
    if isinstance(spec, dict):
        return expression(r, spec)
    return literal(spec)


def _numbers(r: Resolver, spec: Any) -> tuple[Column, Column]:
    a, b = (value(r, x) for x in list(spec)[:2])
    return as_number(a), as_number(b)


def _substr(r: Resolver, spec: list) -> Typed:
    """Byte offsets: null before the start and past the end, cut at the end."""
    s, start, size = as_string(value(r, spec[0])), as_number(value(r, spec[1])).cast("int"), as_number(value(r, spec[2])).cast("int")
    raw = F.encode(s, "UTF-8")
    ok = (start >= 0) & (start <= F.octet_length(s)) & (size >= 0)
    return Typed(F.when(ok, F.decode(F.substring(raw, start + 1, size), "UTF-8")), STRING)


def _array_elem(r: Resolver, spec: list) -> Typed:
    a, i = value(r, spec[0]), as_number(value(r, spec[1])).cast("int")
    if not isinstance(a.type, T.ArrayType):
        return missing()
    return Typed(F.try_element_at(a.col, F.when(i >= 0, i + 1).otherwise(i)), a.type.elementType)


def _cond(r: Resolver, spec: Any) -> Typed:
    if isinstance(spec, (list, tuple)):
        spec = dict(zip(("if", "then", "else"), spec, strict=False))
    test = condition(r, spec.get("cond", spec.get("if")))
    a, b = value(r, spec.get("then")), value(r, spec.get("else"))
    kind = _common(a, b)
    return Typed(F.when(test, a.col.cast(kind)).otherwise(b.col.cast(kind)), kind)


def _common(a: Typed, b: Typed) -> T.DataType:
    if a.is_missing or b.is_missing:
        return b.type if a.is_missing else a.type
    if a.is_number and b.is_number:
        return a.type if a.type == b.type else DOUBLE
    return a.type if a.type == b.type else STRING


def _if_null(r: Resolver, spec: list) -> Typed:
    a, b = value(r, spec[0]), value(r, spec[1])
    kind = _common(a, b)
    return Typed(F.when(~is_nil(a), a.col.cast(kind)).otherwise(b.col.cast(kind)), kind)


def _to_bool(v: Typed) -> Column:
    if v.is_number:
        return F.coalesce(v.col != 0, F.lit(False))
    if v.is_string:
        return F.coalesce(v.col != "", F.lit(False))
    if v.is_variant:
        return F.coalesce(as_boolean(v), as_number(v) != 0, as_string(v) != "", F.lit(False))
    return F.coalesce(as_boolean(v), F.lit(False))


def _to_string(v: Typed) -> Column:
    if v.is_missing:
        return F.lit(None).cast("string")
    if v.is_variant:
        return F.coalesce(as_string(v), F.to_json(v.col))
    return F.to_json(v.col) if isinstance(v.type, (T.StructType, T.MapType, T.ArrayType)) else v.col.cast("string")


def _when(v: Typed) -> Column:
    return v.col if v.is_time else F.try_to_timestamp(as_string(v))


def _of_list(r: Resolver, op: str, spec: Any) -> Typed:
    """$sum, $avg, $min and $max of one value, of a list of values, or of an array field."""
    if not isinstance(spec, (list, tuple)):
        v = value(r, spec)
        if isinstance(v.type, T.ArrayType):
            items = F.filter(F.transform(v.col, lambda x: as_number(Typed(x, v.type.elementType))), lambda x: x.isNotNull())
        else:
            items = F.filter(F.array(as_number(v)), lambda x: x.isNotNull())
    else:
        items = F.filter(F.array(*[as_number(value(r, s)) for s in spec]), lambda x: x.isNotNull())
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a + x)
    found = {"$sum": F.coalesce(total, F.lit(0.0)), "$avg": F.when(F.size(items) > 0, total / F.size(items)), "$min": F.array_min(items), "$max": F.array_max(items)}[op]
    return Typed(found, DOUBLE)


def expression(r: Resolver, spec: dict) -> Typed:
    """The first operator in an object; an object without one is a struct of its entries."""
    op = next((k for k in spec if k in OPERATORS), None)
    if op is None:
        if any(k.startswith("$") for k in spec):
            raise ValueError(f"unknown expression {list(spec)}")
        items = {k: value(r, v) for k, v in spec.items()}
        return Typed(F.struct(*[v.col.alias(k) for k, v in items.items()]), T.StructType([T.StructField(k, v.type) for k, v in items.items()]))
    return OPERATORS[op](r, spec[op])


def _arith(fn):
    def run(r: Resolver, spec: Any) -> Typed:
        return Typed(fn(*_numbers(r, spec)), DOUBLE)

    return run


def _single(fn, kind: T.DataType):
    """Of one value, which may stand in a list."""

    def run(r: Resolver, spec: Any) -> Typed:
        return Typed(fn(value(r, spec[0] if isinstance(spec, (list, tuple)) and len(spec) == 1 else spec)), kind)

    return run


OPERATORS = {
    "$add": _arith(lambda a, b: a + b),
    "$subtract": _arith(lambda a, b: a - b),
    "$multiply": _arith(lambda a, b: a * b),
    "$divide": _arith(F.try_divide),
    "$mod": _arith(F.try_mod),
    "$concat": lambda r, s: Typed(F.concat_ws("", *[as_string(value(r, x)) for x in s]), STRING),
    "$substr": _substr,
    "$toLower": _single(lambda v: F.lower(as_string(v)), STRING),
    "$toUpper": _single(lambda v: F.upper(as_string(v)), STRING),
    "$size": _single(lambda v: F.when(v.col.isNotNull(), F.size(v.col)).cast("long") if isinstance(v.type, T.ArrayType) else F.lit(None).cast("long"), LONG),
    "$arrayElemAt": _array_elem,
    "$cond": _cond,
    "$ifNull": _if_null,
    "$type": _single(type_name, STRING),
    "$toString": _single(_to_string, STRING),
    "$toInt": _single(lambda v: as_number(v).try_cast("long"), LONG),
    "$toDouble": _single(as_number, DOUBLE),
    "$toBool": _single(_to_bool, BOOL),
    "$year": _single(lambda v: F.year(_when(v)).cast("long"), LONG),
    "$month": _single(lambda v: F.month(_when(v)).cast("long"), LONG),
    "$dayOfMonth": _single(lambda v: F.dayofmonth(_when(v)).cast("long"), LONG),
    "$hour": _single(lambda v: F.hour(_when(v)).cast("long"), LONG),
    "$minute": _single(lambda v: F.minute(_when(v)).cast("long"), LONG),
    "$second": _single(lambda v: F.second(_when(v)).cast("long"), LONG),
    "$literal": lambda r, s: literal(s),
    **{op: (lambda r, s, op=op: _of_list(r, op, s)) for op in ("$sum", "$avg", "$min", "$max")},
}


def condition(r: Resolver, spec: Any) -> Column:
    """The test of $cond: a boolean, or comparisons of two values (orders of numbers only) under $and, $or and $not. Anything
    else is false."""
    if isinstance(spec, bool):
        return F.lit(spec)
    if not isinstance(spec, dict):
        return F.lit(False)
    for op, args in spec.items():
        if op == "$and":
            return certainly(_all([condition(r, a) for a in args]))
        if op == "$or":
            out = F.lit(False)
            for a in args:
                out = out | condition(r, a)
            return out
        if op == "$not":
            return ~condition(r, args[0] if isinstance(args, (list, tuple)) else args)
        if op in ("$eq", "$ne"):
            same = _same(value(r, args[0]), value(r, args[1]), args)
            return same if op == "$eq" else ~same
        if op in ("$gt", "$gte", "$lt", "$lte"):
            a, b = _numbers(r, args)
            return certainly({"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op])
    return F.lit(False)


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _same(a: Typed, b: Typed, args: list) -> Column:
    if is_plain_number(args[1]) or args[1] is None or isinstance(args[1], bool) or isinstance(args[1], str) and not args[1].startswith("$"):
        return certainly(equals(a, args[1]))
    if a.is_missing or b.is_missing:
        return is_nil(a) & is_nil(b)
    if a.is_number and b.is_number or a.type == b.type:
        return a.col.eqNullSafe(b.col)
    return is_nil(a) & is_nil(b)
