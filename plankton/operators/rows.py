"""Projection, filter, column mapping and names: operators on one input that keep its rows' order of columns exact."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Invalid(ValueError):
    """What was asked for breaks a rule of the operator."""


def columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or `name` with underscores until no column of `df` has it (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def distinct_names(names: Sequence[str]) -> None:
    """Refuses an output in which two columns would share a name (whatever its case)."""
    lower = [n.lower() for n in names]
    if again := [n for n, x in zip(names, lower, strict=True) if lower.count(x) > 1]:
        raise Invalid(f"the output would have two columns {again[0]}")


def emit(df: DataFrame, mapping: Sequence[int] | None = None) -> DataFrame:
    """Columns of the operator's own output by position, reordered, dropped or (under a new name) repeated; None passes all on."""
    if mapping is None:
        return df
    if bad := [i for i in mapping if not 0 <= i < len(df.columns)]:
        raise Invalid(f"no column {bad[0]}: the output has {len(df.columns)}")
    seen: dict[int, int] = {}
    out = []
    for i in mapping:
        n = seen[i] = seen.get(i, -1) + 1
        out.append(columns(df)[i].alias(df.columns[i] + f"_{n}" * bool(n)))
    return df.select(*out)


def project(df: DataFrame, **new: Column) -> DataFrame:
    """The input's columns and after them the new ones; nothing is replaced."""
    distinct_names([*df.columns, *new])
    return df.select("*", *[c.alias(n) for n, c in new.items()])


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true, not null or false."""
    return df.where(condition)


def mask(df: DataFrame, fields: Sequence[str | tuple[str, Sequence]], *, reorder: bool = False) -> DataFrame:
    """Listed columns; a pair (name, fields) keeps only some fields of a struct, to any depth.

    Whether a mask may reorder is not settled: fields must be listed in the
    order in which the input has them, unless reorder says to take them as
    listed.  A null struct stays null.
    """

    def narrowed(c: Column, t: T.DataType, listed: Sequence, null: bool) -> Column:
        order = [f.name for f in t.fields]
        at = [order.index(x if isinstance(x, str) else x[0]) for x in listed]
        if at != sorted(at) and not reorder:
            raise Invalid("the mask lists fields out of order")
        parts = []
        for x, i in zip(listed, at, strict=True):
            part = c[order[i]]
            parts.append((part if isinstance(x, str) else narrowed(part, t.fields[i].dataType, x[1], t.fields[i].nullable)).alias(order[i]))
        made = F.struct(*parts)
        return F.when(c.isNotNull(), made) if null else made

    names = [x if isinstance(x, str) else x[0] for x in fields]
    if missing := [n for n in names if n not in df.columns]:
        raise Invalid(f"no column {missing[0]}")
    at = [df.columns.index(n) for n in names]
    if at != sorted(at) and not reorder:
        raise Invalid("the mask lists columns out of order")
    return df.select(*[F.col(f"`{x}`") if isinstance(x, str) else narrowed(F.col(f"`{x[0]}`"), df.schema[x[0]].dataType, x[1], df.schema[x[0]].nullable).alias(x[0]) for x in fields])


def read_filtered(df: DataFrame, *, condition: Callable[[DataFrame], Column] | None = None, fields: Sequence | None = None) -> DataFrame:
    """A scan with a filter over the whole schema and then a mask; both reach a columnar source as pushed filters and pruned columns."""
    df = df if condition is None else df.where(condition(df))
    return df if fields is None else mask(df, fields)


def rename(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Names for all columns and, depth first, all struct fields inside them; types and nullability stay."""
    left = list(names)

    def take() -> str:
        if not left:
            raise Invalid("too few names")
        return left.pop(0)

    def renamed(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(take(), renamed(f.dataType), f.nullable) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(renamed(t.elementType), t.containsNull)
        if isinstance(t, T.MapType):
            return T.MapType(renamed(t.keyType), renamed(t.valueType), t.valueContainsNull)
        return t

    out = []
    for f in df.schema.fields:
        name = take()
        t = renamed(f.dataType)
        c = F.col(f"`{f.name}`")
        out.append((c if t == f.dataType else c.cast(t)).alias(name))
    if left:
        raise Invalid(f"{len(left)} names too many")
    return df.select(*out)
