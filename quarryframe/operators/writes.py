"""Inserts, updates, patches and deletes as transformations: each returns the collection's next version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Schema, validate


class DuplicateKey(ValueError):
    pass


class MissingKey(ValueError):
    pass


class Invalid(ValueError):
    pass


def _some(df: DataFrame, n: int = 3) -> list:
    return [tuple(r) for r in df.limit(n).collect()]


def insert(current: DataFrame, rows: DataFrame, schema: Schema | None = None, key: str = "_id") -> DataFrame:
    """All or nothing: a row that is invalid, that repeats a key, or whose key is there stops the batch."""
    _, bad = validate(rows, schema)
    if found := _some(bad.select(key, "errors.message") if key in rows.columns else bad.select("errors.message")):
        raise Invalid(f"invalid rows: {found}")
    _once(rows, key)
    if found := _some(rows.join(current.select(key), key, "left_semi").select(key)):
        raise DuplicateKey(f"keys exist: {found}")
    return current.unionByName(rows, allowMissingColumns=True)


def _once(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """rows with each key once: of rows that repeat one that with the largest value of order, which is a column. Without order
    there is no last row, and a key that repeats stops the batch."""
    if order is not None:
        return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("__r")).select("__r.*")
    if found := _some(rows.groupBy(key).count().filter("count > 1").select(key)):
        raise DuplicateKey(f"keys repeat in the batch: {found}")
    return rows


def upsert(current: DataFrame, rows: DataFrame, key: str = "_id", order: str | None = None) -> DataFrame:
    """Rows replace those of the same key as a whole, others are added. A key that repeats in rows counts once, by order."""
    rows = _once(rows, key, order)
    return current.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def update(current: DataFrame, rows: DataFrame, schema: Schema | None = None, key: str = "_id", created: str = "_createdAt") -> DataFrame:
    """Whole rows replaced; the time of creation stays. A key that isn't there stops the batch."""
    _check(current, rows, schema, key)
    if created in current.columns:
        rows = rows.drop(created).join(current.select(key, created), key)
    return upsert(current, rows, key)


def patch(current: DataFrame, rows: DataFrame, key: str = "_id", strict: bool = True, order: str | None = None) -> DataFrame:
    """Shallow merge: the columns that rows has replace those of the row with the same key where they aren't null. A struct
    column present__<name>, boolean, decides instead where there is one, so that null can be set. A key that repeats in rows
    counts once, by order."""
    rows = _once(rows, key, order)
    if strict:
        _check(current, rows, None, key)
    changed = [c for c in rows.columns if c != key and not c.startswith("present__")]
    new = rows.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in changed], *[F.col(c) for c in rows.columns if c.startswith("present__")], F.lit(True).alias("__there"))
    joined = current.join(new, current[key] == new["__key"], "left")
    out = []
    for c in current.columns:
        if c not in changed:
            out.append(F.col(c))
        elif f"present__{c}" in rows.columns:
            out.append(F.when(F.coalesce(F.col(f"present__{c}"), F.lit(False)), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c))
    out += [F.col(f"__new_{c}").alias(c) for c in changed if c not in current.columns]
    return joined.select(*out)


def delete(current: DataFrame, keys: DataFrame, key: str = "_id", strict: bool = False) -> DataFrame:
    if strict:
        _check(current, keys, None, key)
    return current.join(keys.select(key), key, "left_anti")


def _check(current: DataFrame, rows: DataFrame, schema: Schema | None, key: str) -> None:
    _, bad = validate(rows, schema)
    if found := _some(bad.select(key, "errors.message")):
        raise Invalid(f"invalid rows: {found}")
    if found := _some(rows.join(current.select(key), key, "left_anti").select(key)):
        raise MissingKey(f"keys don't exist: {found}")
