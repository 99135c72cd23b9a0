"""Dotted paths over typed columns, structs, maps and VARIANT.

A value is a Typed: a Column with the type that the schema gives it. The type decides once, while the plan is built, which
comparisons can hold at all; nothing is guessed per row, except inside a VARIANT, where the stored type is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Typed:
    col: Column
    type: T.DataType

    @property
    def is_number(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def is_string(self) -> bool:
        return isinstance(self.type, (T.StringType, T.VarcharType, T.CharType))

    @property
    def is_variant(self) -> bool:
        return isinstance(self.type, T.VariantType)

    @property
    def is_time(self) -> bool:
        return isinstance(self.type, (T.TimestampType, T.TimestampNTZType, T.DateType))

    @property
    def is_missing(self) -> bool:
        return isinstance(self.type, T.NullType)


NUMBER_IN_VARIANT = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def missing() -> Typed:
    return Typed(F.lit(None), T.NullType())


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Resolver:
    """Finds the value at a path of a frame with the given schema. A column named like the whole dotted path wins."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def get(self, path: str) -> Typed:
        fields = {f.name: f for f in self.schema.fields}
        if path in fields:
            return Typed(F.col(quoted(path)), fields[path].dataType)
        head, _, rest = path.partition(".")
        if path not in fields and isinstance(unified := getattr(fields.get("fields"), "dataType", None), T.StructType):
            # a unified document: fields.<name>.scalar, else .vector, else the field itself
            inner = {f.name: f.dataType for f in unified.fields}
            if path in inner:
                at = Typed(F.col("fields").getField(path), inner[path])
                parts = {f.name: f.dataType for f in at.type.fields} if isinstance(at.type, T.StructType) else {}
                part = next((p for p in ("scalar", "vector") if p in parts), None)
                return Typed(at.col.getField(part), parts[part]) if part else at
        if head not in fields or not rest:
            return missing()
        at = Typed(F.col(quoted(head)), fields[head].dataType)
        parts = rest.split(".")
        for i, part in enumerate(parts):
            if isinstance(at.type, T.StructType):
                inner = {f.name: f for f in at.type.fields}
                if part not in inner:
                    return missing()
                at = Typed(at.col.getField(part), inner[part].dataType)
            elif isinstance(at.type, T.MapType) and isinstance(at.type.keyType, T.StringType):
                at = Typed(F.try_element_at(at.col, F.lit(part)), at.type.valueType)
            elif at.is_variant:
                names = "".join("['" + p.replace("'", "\\'") + "']" for p in parts[i:])
                return Typed(F.try_variant_get(at.col, "$" + names, "variant"), T.VariantType())
            else:
                return missing()
        return at

    def exists(self, path: str) -> Column:
        """Whether the path is there. In typed columns null means missing; inside a VARIANT an explicit null is there."""
        at = self.get(path)
        return F.lit(False) if at.is_missing else at.col.isNotNull()


def variant_type(v: Typed) -> Column:
    return F.schema_of_variant(v.col)


def as_number(v: Typed) -> Column:
    """The value as double, null if it isn't a number. Strings and booleans aren't."""
    if v.is_number:
        return v.col.cast("double")
    if v.is_variant:
        return F.when(variant_type(v).rlike(NUMBER_IN_VARIANT), F.try_variant_get(v.col, "$", "double"))
    return F.lit(None).cast("double")


def as_string(v: Typed) -> Column:
    """The value if it is a string, else null."""
    if v.is_string:
        return v.col
    if v.is_variant:
        return F.when(variant_type(v) == "STRING", F.try_variant_get(v.col, "$", "string"))
    return F.lit(None).cast("string")


def as_boolean(v: Typed) -> Column:
    if isinstance(v.type, T.BooleanType):
        return v.col
    if v.is_variant:
        return F.when(variant_type(v) == "BOOLEAN", F.try_variant_get(v.col, "$", "boolean"))
    return F.lit(None).cast("boolean")


def is_nil(v: Typed) -> Column:
    """Missing or null."""
    if v.is_missing:
        return F.lit(True)
    if v.is_variant:
        return v.col.isNull() | F.is_variant_null(v.col)
    return v.col.isNull()


def as_key(v: Typed) -> Typed:
    """A form that can be grouped and ordered: a VARIANT as its JSON text."""
    if v.is_variant:
        return Typed(F.when(~F.is_variant_null(v.col), F.to_json(v.col)), T.StringType())
    return v
