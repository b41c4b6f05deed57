"""Window functions over one partitioning and ordering, each a column more."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.nulls import widen
from .rows import Invalid, distinct_names


def spec(partition: Sequence[str] = (), order: Sequence[Column] = (), rows: tuple[int | None, int | None] | None = None, values: tuple[int | None, int | None] | None = None) -> WindowSpec:
    """The frame by `rows`, offsets of its first and last row from the current one, or by `values`, offsets of the one ordering value (a RANGE frame).

    Negative offsets precede; None has no bound.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    if rows is not None and values is not None:
        raise Invalid("a frame is by rows or by values")
    if rows is None and values is None:
        return w
    lo, hi = rows or values
    first, last = Window.unboundedPreceding if lo is None else lo, Window.unboundedFollowing if hi is None else hi
    return w.rowsBetween(first, last) if rows else w.rangeBetween(first, last)


def window(df: DataFrame, w: WindowSpec, **calls: Column | Whole) -> DataFrame:
    """The input's columns and one for each call, declared nullable."""
    distinct_names([*df.columns, *calls])
    return df.select("*", *[widen(c.over(w)).alias(n) for n, c in calls.items()])


class Whole:
    """A ranking function whose result is a 64-bit number."""

    def __init__(self, c: Column):
        self.c = c

    def over(self, w: WindowSpec) -> Column:
        return self.c.over(w).cast("long")


def row_number() -> Whole:
    return Whole(F.row_number())


def rank() -> Whole:
    return Whole(F.rank())


def dense_rank() -> Whole:
    return Whole(F.dense_rank())


def ntile(n: int) -> Whole:
    return Whole(F.ntile(n))
