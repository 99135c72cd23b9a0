"""Pipeline stages: each takes a Frame and a specification and returns a Frame. Nothing is collected."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.accumulators import NAMES, Order, accumulate
from ..functions.expressions import value
from ..functions.paths import Resolver, Typed, as_key, as_number, quoted
from ..functions.predicates import match


@dataclass(frozen=True)
class Context:
    """What stages know besides the rows: other collections, and the key that gives rows their arrival order."""

    collections: dict[str, DataFrame] = field(default_factory=dict)
    key: str = "_id"


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    context: Context = field(default_factory=Context)
    #: set by $sort: the order that $limit, $skip, $first and $push go by
    order: Order | None = None
    #: whether the rows still lie in that order; a join may have moved them
    in_order: bool = False

    @property
    def paths(self) -> Resolver:
        return Resolver(self.df.schema)

    def with_df(self, df: DataFrame, keep_order: bool = True) -> Frame:
        names = set(df.columns)
        order = self.order if keep_order and self.order and all(k in names for k, _ in self.order.keys) else None
        return replace(self, df=df, order=order)

    def arrival(self) -> Order | None:
        """The order set, else by key."""
        if self.order:
            return self.order
        return Order(((self.context.key, True),)) if self.context.key in self.df.columns else None


Stage = Callable[[Frame, Any], Frame]


def match_stage(f: Frame, spec: dict) -> Frame:
    return f.with_df(f.df.filter(match(f.paths, spec)))


def _accumulators(spec: dict) -> dict[str, tuple[str, Any]]:
    """Both spellings, {"total": {"$sum": "$x"}} and {"$sum": {"total": "$x"}}."""
    out = {}
    for name, what in spec.items():
        if name == "_id":
            continue
        if name in NAMES:
            out |= {n: (name, operand) for n, operand in (what.items() if isinstance(what, dict) else [(what, None)])}
        elif isinstance(what, dict) and len(what) == 1 and next(iter(what)) in NAMES:
            out[name] = next(iter(what.items()))
        else:
            raise ValueError(f"not an accumulator: {name}: {what!r}")
    return out


def group_stage(f: Frame, spec: dict) -> Frame:
    """One row per key; an object as key becomes a struct; no key is one group, of which no rows make none. $centroid and
    $topN, which need more than an aggregate, are joined by key."""
    from .vector import centroids, top_n

    r, key = f.paths, spec.get("_id")
    if isinstance(key, dict) and not any(k.startswith("$") for k in key):
        parts = {k: as_key(value(r, v)) for k, v in key.items()}
        key_col = F.struct(*[v.col.alias(k) for k, v in parts.items()])
    else:
        key_col = F.lit(None).cast("string") if key is None else as_key(value(r, key)).col
    order = f.arrival()
    special = {k: v for k, v in spec.items() if isinstance(v, dict) and next(iter(v), "") in ("$centroid", "$topN")}
    aggs = [accumulate(r, op, operand, order).alias(name) for name, (op, operand) in _accumulators({k: v for k, v in spec.items() if k not in special}).items()]
    keyed = f.df.withColumn("__key", key_col)
    out = keyed.groupBy("__key").agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
    out = out.drop("__n") if not aggs else out
    for name, how in special.items():
        op, operand = next(iter(how.items()))
        if op == "$centroid":
            more = centroids(keyed, "__key", r.get(operand.lstrip("$")).col).withColumnsRenamed({"centroid": name})
        else:
            more = top_n(keyed, "__key", operand.get("by", "vectorScore").lstrip("$"), int(operand.get("n", 5)), f.context.key).withColumnsRenamed({"items": name})
        more = more.withColumnRenamed("__key", "__key2")
        out = out.join(more, F.col("__key").eqNullSafe(F.col("__key2")), "left").drop("__key2")
    return replace(f, df=out.withColumnRenamed("__key", "_id"), order=None, context=replace(f.context, key="_id"))


def sort_stage(f: Frame, spec: dict) -> Frame:
    """Keys in written order, nulls first ascending and last descending, the key column last."""
    names = list(f.df.columns)
    df, keys = f.df, []
    for path, direction in spec.items():
        v = as_key(f.paths.get(path))
        up = direction == 1
        if v.is_missing:
            continue
        if path not in names:
            helper = f"__sort_{len(keys)}"
            df = df.withColumn(helper, v.col)
            keys.append((helper, up))
        else:
            keys.append((path, up))
    if f.context.key in names and f.context.key not in [k for k, _ in keys]:
        keys.append((f.context.key, True))
    order = Order(tuple(keys))
    out = df.orderBy(*order.columns()) if keys else df
    helpers = [k for k, _ in keys if k.startswith("__sort_")]
    if helpers:
        return replace(f, df=out.drop(*helpers), order=None)
    return replace(f, df=out, order=order, in_order=True)


def _sorted(f: Frame) -> DataFrame:
    """Rows in arrival order; a $sort before may have put them so."""
    order = f.arrival()
    return f.df if f.order and f.in_order or order is None else f.df.orderBy(*order.columns())


def limit_stage(f: Frame, n: int) -> Frame:
    return replace(f.with_df(_sorted(f).limit(int(n))), in_order=True)


def skip_stage(f: Frame, n: int) -> Frame:
    return replace(f.with_df(_sorted(f).offset(int(n))), in_order=True)


def project_stage(f: Frame, spec: dict) -> Frame:
    """True or 1 includes, False or 0 excludes (only if nothing is included), objects are expressions, other values
    literals. The key isn't kept unless named."""
    r, chosen, dropped = f.paths, [], []
    for name, what in spec.items():
        if what is True or what == 1 and not isinstance(what, (str, dict, bool)):
            v = r.get(name)
            if not v.is_missing:
                chosen.append(v.col.alias(name))
        elif what is False or what == 0 and not isinstance(what, (str, dict, bool)):
            dropped.append(name)
        else:
            v = value(r, what)
            chosen.append(v.col.alias(name))
    if chosen:
        return f.with_df(f.df.select(*chosen))
    return f.with_df(f.df.drop(*[F.col(quoted(d)) for d in dropped if d in f.df.columns]))


def add_fields_stage(f: Frame, spec: dict) -> Frame:
    """Columns from expressions over the rows as they came."""
    r = f.paths
    return f.with_df(f.df.withColumns({name: value(r, what).col for name, what in spec.items()}))


def unset_stage(f: Frame, spec: str | list) -> Frame:
    names = [spec] if isinstance(spec, str) else list(spec)
    return f.with_df(f.df.drop(*[F.col(quoted(n)) for n in names if n in f.df.columns]))


def lookup_stage(f: Frame, spec: dict) -> Frame:
    """Left outer, null-safe: an array of the rows of another collection whose field is equal, empty if there are none.
    Matching is by hash or merge; the other side is grouped first, so that rows aren't multiplied."""
    name, into = spec["from"], spec["as"]
    other = f.context.collections.get(name)
    local = as_key(f.paths.get(spec["localField"]))
    if other is None:
        return f.with_df(f.df.withColumn(into, F.array().cast("array<string>")))
    foreign = as_key(Resolver(other.schema).get(spec["foreignField"]))
    if foreign.is_missing:
        foreign = Typed(F.lit(None).cast(local.type if not local.is_missing else "string"), local.type)
    local_col = F.lit(None).cast(foreign.type) if local.is_missing else local.col
    row = F.struct(*[F.col(quoted(c)) for c in other.columns])
    grouped = other.groupBy(foreign.col.alias("__fk")).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    out = f.df.join(grouped, local_col.eqNullSafe(F.col("__fk")), "left")
    kind = grouped.schema["__rows"].dataType
    return replace(f.with_df(out.withColumn(into, F.coalesce("__rows", F.array().cast(kind))).drop("__fk", "__rows")), in_order=False)


def lookup_unwound(f: Frame, spec: dict, unwind: str | dict) -> Frame | None:
    """A $lookup whose array the next stage takes apart again, as the join that it is: no array is made of a hot key's rows, and
    only the fields that are used are read. None where that isn't the same, as with an index into the array."""
    unwind = {"path": unwind} if isinstance(unwind, str) else unwind
    other, into = f.context.collections.get(spec["from"]), spec["as"]
    if other is None or unwind["path"].lstrip("$") != into or unwind.get("includeArrayIndex"):
        return None
    local, foreign = as_key(f.paths.get(spec["localField"])), as_key(Resolver(other.schema).get(spec["foreignField"]))
    if local.is_missing or foreign.is_missing:
        return None
    rows = other.select(foreign.col.alias("__fk"), F.struct(*[F.col(quoted(c)) for c in other.columns]).alias("__row"))
    out = f.df.withColumn("__lk", local.col).join(rows, F.col("__lk").eqNullSafe(F.col("__fk")), "left" if unwind.get("preserveNullAndEmptyArrays") else "inner")
    out = out.withColumn(into, F.col("__row")).drop("__lk", "__fk", "__row")
    return replace(f.with_df(out), in_order=False)


def unwind_stage(f: Frame, spec: str | dict) -> Frame:
    """One row per element. Rows without elements go, or with preserveNullAndEmptyArrays stay as they are; includeArrayIndex
    counts from 0 and is null on those."""
    spec = {"path": spec} if isinstance(spec, str) else spec
    path, keep, index = spec["path"].lstrip("$"), spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    v = f.paths.get(path)
    if not isinstance(v.type, T.ArrayType):
        return f if keep else f.with_df(f.df.filter(F.lit(False)))
    head, _, rest = path.partition(".")
    others = [F.col(quoted(c)) for c in f.df.columns]
    out = f.df.select(*others, (F.posexplode_outer if keep else F.posexplode)(v.col).alias("__at", "__item"))
    if rest:
        out = out.withColumn(head, F.col(quoted(head)).withField(rest, F.col("__item")))
    else:
        out = out.withColumn(head, F.col("__item"))
    if index:
        out = out.withColumn(index, F.col("__at").cast("long"))
    return f.with_df(out.drop("__at", "__item"))


def count_stage(f: Frame, name: str) -> Frame:
    return replace(f, df=f.df.agg(F.count(F.lit(1)).alias(name)), order=None)


def facet_frames(f: Frame, spec: dict) -> dict[str, Frame]:
    """The sub-pipelines, each over the rows as they came; the form to use where results are large."""
    from ..plans.pipeline import apply

    return {name: apply(f, stages) for name, stages in spec.items()}


def facet_stage(f: Frame, spec: dict) -> Frame:
    """One row with an array of rows for each sub-pipeline."""
    out = None
    for name, sub in facet_frames(f, spec).items():
        order = sub.arrival()
        rows = F.collect_list(F.struct(*[F.col(quoted(c)) for c in sub.df.columns]))
        one = sub.df.agg((rows if sub.order else F.array_sort(rows) if order else rows).alias(name)).withColumn("__one", F.lit(1))
        out = one if out is None else out.join(one, "__one")
    return replace(f, df=out.drop("__one"), order=None)


def bucket_stage(f: Frame, spec: dict) -> Frame:
    """A row for every bucket [b_i, b_i+1), also an empty one, in order, with count; other rows go to `default`, if named."""
    r, bounds, default = f.paths, list(spec["boundaries"]), spec.get("default")
    x = as_number(value(r, spec["groupBy"]))
    place = F.lit(None).cast("int")
    for i in range(len(bounds) - 2, -1, -1):
        place = F.when((x >= F.lit(float(bounds[i]))) & (x < F.lit(float(bounds[i + 1]))), F.lit(i)).otherwise(place)
    place = F.coalesce(place, F.lit(len(bounds) - 1 if default is not None else None).cast("int"))
    aggs = [F.count(F.lit(1)).alias("count")] + [accumulate(r, op, operand, f.arrival()).alias(n) for n, (op, operand) in _accumulators(spec.get("output", {})).items() if n != "count"]
    counted = f.df.withColumn("__place", place).filter(F.col("__place").isNotNull()).groupBy("__place").agg(*aggs)
    names = [str(b) for b in bounds[:-1]] if default is not None else bounds[:-1]
    kind = "string" if default is not None else "double" if any(isinstance(b, float) for b in bounds) else "long"
    frame = f.df.sparkSession.range(len(bounds) - 1).select(F.col("id").cast("int").alias("__place"))
    frame = frame.withColumn("_id", F.get(F.array(*[F.lit(n) for n in names]).cast(f"array<{kind}>"), F.col("__place")))
    out = frame.join(counted, "__place", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    if default is not None:
        rest = counted.filter(F.col("__place") == len(bounds) - 1).withColumn("_id", F.lit(str(default)))
        out = out.unionByName(rest.select(*out.columns))
    out = out.orderBy("__place").drop("__place")
    return replace(f, df=out, order=None, context=replace(f.context, key="_id"))


def sort_by_count_stage(f: Frame, spec: str) -> Frame:
    v = as_key(value(f.paths, spec))
    out = f.df.groupBy(v.col.alias("_id")).agg(F.count(F.lit(1)).alias("count"))
    return replace(f, df=out.orderBy(F.desc("count"), F.asc_nulls_first("_id")), order=Order((("count", False), ("_id", True))), context=replace(f.context, key="_id"))


def replace_root_stage(f: Frame, spec: str | dict) -> Frame:
    """The named object as the row; rows without it go."""
    v = value(f.paths, spec["newRoot"] if isinstance(spec, dict) and "newRoot" in spec else spec)
    if not isinstance(v.type, T.StructType):
        raise ValueError("$replaceRoot needs an object with known fields")
    return replace(f, df=f.df.select(v.col.alias("__root")).filter(F.col("__root").isNotNull()).select("__root.*"), order=None)


def distinct_values(f: Frame, name: str) -> DataFrame:
    """Distinct values that exist of a top-level field."""
    v = as_key(f.paths.get(name))
    return f.df.select(v.col.alias("value")).filter(F.col("value").isNotNull()).distinct()


def distinct_count(f: Frame, name: str) -> DataFrame:
    """One row: how many distinct values exist of a top-level field."""
    return distinct_values(f, name).agg(F.count(F.lit(1)).alias("count"))


def _vector(name: str) -> Stage:
    def run(f: Frame, spec: Any) -> Frame:
        from . import vector

        return getattr(vector, name)(f, spec)

    return run


STAGES: dict[str, Stage] = {
    "$match": match_stage, "$group": group_stage, "$sort": sort_stage, "$project": project_stage, "$limit": limit_stage, "$skip": skip_stage,
    "$addFields": add_fields_stage, "$set": add_fields_stage, "$unset": unset_stage, "$lookup": lookup_stage, "$unwind": unwind_stage, "$count": count_stage,
    "$facet": facet_stage, "$bucket": bucket_stage, "$sortByCount": sort_by_count_stage, "$replaceRoot": replace_root_stage,
    "$vectorMatch": _vector("vector_match_stage"), "$hybridSearch": _vector("hybrid_search_stage"), "$vectorCluster": _vector("vector_cluster_stage"), "$semanticGroup": _vector("semantic_group_stage"),
}

