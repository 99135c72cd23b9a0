"""$group accumulators as aggregate Columns. Only numbers count in $sum, $avg, $min, $max and the deviations."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import value
from .paths import Resolver, Typed, as_number

NAMES = {"$sum", "$avg", "$min", "$max", "$count", "$first", "$last", "$push", "$addToSet", "$stdDevPop", "$stdDevSamp", "$avgVectorScore", "$maxVectorScore", "$minVectorScore", "$topN"}


@dataclass(frozen=True)
class Order:
    """Arrival order of rows: columns with True for ascending."""

    keys: tuple[tuple[str, bool], ...]

    def columns(self) -> list[Column]:
        return [F.col(f"`{k}`").asc_nulls_first() if up else F.col(f"`{k}`").desc_nulls_last() for k, up in self.keys]

    def rank(self, schema: T.StructType) -> tuple[Column, bool] | None:
        """A value that ascends (or, if False, descends) with the order; None if no single one does."""
        kinds = {f.name: f.dataType for f in schema.fields}
        directions = {up for _, up in self.keys}
        if len(directions) == 1:
            return F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, (k, _) in enumerate(self.keys)]), directions == {True}
        parts: list[Column] = []
        for k, up in self.keys:
            if up:
                parts.append(F.col(f"`{k}`"))
                continue
            falling = descending(F.col(f"`{k}`"), kinds.get(k))
            if falling is None:
                return None
            parts += [F.col(f"`{k}`").isNull(), falling]  # nulls last
        return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]), True


def descending(c: Column, kind: T.DataType | None) -> Column | None:
    """A value that ascends as c descends; None for kinds that have none."""
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(c)
    if isinstance(kind, T.NumericType):
        return -c
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(c)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        # complemented bytes, and an end that is larger than all of them, as the longer of two texts comes first
        return F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return None


def numeric(v: Typed) -> Column:
    return v.col if v.is_number else as_number(v)


def accumulate(r: Resolver, op: str, operand: Any, order: Order | None) -> Column:
    v = None if op in ("$count", "$avgVectorScore", "$maxVectorScore", "$minVectorScore", "$topN") else value(r, operand)
    if op == "$sum":
        if isinstance(operand, (int, float)) and not isinstance(operand, bool):
            return F.count(F.lit(1)).cast("double") * F.lit(float(operand))
        return F.coalesce(F.sum(numeric(v).cast("double")), F.lit(0.0))
    if op == "$avg":
        return F.avg(numeric(v).cast("double"))
    if op in ("$min", "$max"):
        return (F.min if op == "$min" else F.max)(numeric(v)).cast("double")
    if op == "$count":
        return F.count(F.lit(1))
    if op in ("$stdDevPop", "$stdDevSamp"):
        return (F.stddev_pop if op == "$stdDevPop" else F.stddev_samp)(numeric(v).cast("double"))
    if op in ("$first", "$last"):
        return _first_or_last(r, v, op == "$first", order)
    if op == "$push":
        if order is None:
            return F.transform(F.array_sort(F.collect_list(F.struct(v.col.alias("v")))), lambda x: x["v"])
        rank, up = _ranked(order, r)
        items = F.array_sort(F.collect_list(F.struct(rank.alias("o"), v.col.alias("v"))))
        return F.transform(items if up else F.reverse(items), lambda x: x["v"])
    if op == "$addToSet":
        return F.transform(F.array_sort(F.collect_set(F.struct(v.col.alias("v")))), lambda x: x["v"])
    score = r.get("vectorScore")
    s = F.lit(None).cast("double") if score.is_missing else score.col.cast("double")
    if op == "$avgVectorScore":
        return F.coalesce(F.avg(s), F.lit(0.0))
    if op == "$maxVectorScore":
        return F.greatest(F.coalesce(F.max(s), F.lit(0.0)), F.lit(0.0))
    if op == "$minVectorScore":
        return F.coalesce(F.min(s), F.lit(0.0))
    raise ValueError(f"unknown accumulator {op}")


def _first_or_last(r: Resolver, v: Typed, first: bool, order: Order | None) -> Column:
    if order is None:
        return (F.first if first else F.last)(v.col)
    rank, up = _ranked(order, r)
    # a struct, so that a null value is kept
    return (F.min_by if first == up else F.max_by)(F.struct(v.col.alias("v")), rank)["v"]


def _ranked(order: Order, r: Resolver) -> tuple[Column, bool]:
    ranked = order.rank(r.schema)
    if ranked is None:
        raise ValueError("$first, $last and $push need an order of one direction, or whose descending keys are numbers, texts, times or booleans")
    return ranked


def is_accumulator(x: Any) -> bool:
    return isinstance(x, dict) and len(x) == 1 and next(iter(x)) in NAMES
