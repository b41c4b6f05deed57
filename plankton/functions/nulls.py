"""Declared nullability: making a column nullable or required without changing a value."""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def widen(c: Column) -> Column:
    """The same values, declared nullable (a comparison with null that never holds)."""
    return F.nullif(c, F.lit(None))


def narrow(c: Column, default) -> Column:
    """Nulls replaced by `default`; declared required."""
    return F.coalesce(c, F.lit(default) if not isinstance(default, Column) else default)


def widen_all(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Declares the named columns (all by default) nullable."""
    chosen = set(df.columns if names is None else names)
    return df.select(*[widen(F.col(f"`{c}`")).alias(c) if c in chosen and not df.schema[c].nullable else F.col(f"`{c}`") for c in df.columns])


def some_value(t: T.DataType) -> Column:
    """Any required value of a type."""
    kind = t.typeName()
    if kind == "struct":
        return F.struct(*[some_value(f.dataType).alias(f.name) for f in t.fields])
    if kind == "array":
        return F.array().cast(t)
    if kind == "map":
        return F.create_map().cast(t)
    plain = {"string": "", "binary": bytearray(), "boolean": False, "date": datetime.date(1970, 1, 1), "timestamp": datetime.datetime(1970, 1, 1), "timestamp_ntz": datetime.datetime(1970, 1, 1), "decimal": Decimal(0)}
    return F.lit(plain.get(kind, 0)).cast(t)


def required(c: Column, t: T.DataType) -> Column:
    """A column of type t that holds no null, declared so."""
    return F.coalesce(c, some_value(t))


def declared(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns that `schema` declares required, and that hold no null, declared so again (after a step that forgot it)."""
    was = {f.name: f for f in schema.fields if not f.nullable}
    return df.select(*[required(F.col(f"`{c}`"), was[c].dataType).alias(c) if c in was else F.col(f"`{c}`") for c in df.columns])
