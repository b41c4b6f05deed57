"""Measures with declared result types, in one step or split into phases that a user can see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Measures whose partial results can be merged.
DECOMPOSABLE = ("sum", "count", "min", "max", "avg")


def quotient(total: Column, n: Column) -> Column:
    """total / n truncated toward zero; null for n = 0."""
    return F.call_function("div", total, F.nullif(n, F.lit(0).cast("long")))


def average(c: Column) -> Column:
    """Mean of whole numbers as a nullable whole number, truncated toward zero."""
    return quotient(F.sum(c.cast("long")), F.count(c))


def final(name: str, c: Column) -> Column:
    """The measure in one step: input rows to result."""
    if name == "avg":
        return average(c)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[name](c)


def intermediate(name: str, c: Column) -> Column:
    """Input rows to an intermediate value: avg is (sum, count), the others are themselves."""
    if name not in DECOMPOSABLE:
        raise ValueError(f"{name} cannot be split into phases")
    if name == "avg":
        return F.struct(F.sum(c.cast("long")).alias("sum"), F.count(c).alias("count"))
    return final(name, c)


def merge(name: str, c: Column, finish: bool = True) -> Column:
    """Intermediate values to one intermediate value, or to the result."""
    if name not in DECOMPOSABLE:
        raise ValueError(f"{name} cannot be split into phases")
    if name == "avg":
        total, n = F.sum(c["sum"]), F.sum(c["count"])
        return quotient(total, n) if finish else F.struct(total.alias("sum"), n.alias("count"))
    if name == "count":
        return F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return final(name, c)


def decimal_sum_type(p: int, s: int) -> T.DecimalType:
    """Type of a sum of decimals."""
    return T.DecimalType(min(38, p + 10), s)
