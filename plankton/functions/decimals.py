"""Decimal arithmetic with declared result types.

P and S are precision and scale of the two operands.  Add and subtract, multiply
and modulus have the types that Spark gives them under ANSI mode with precision
loss allowed; division takes its integer digits from P2 (`by="precision"`,
the default) or from S2 as Spark does (`by="scale"`).
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from math import floor

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 38


def clamp(p: int, s: int) -> tuple[int, int]:
    """At most 38 digits: whole digits stay, of the scale at least min(s, 6)."""
    return (p, s) if p <= MOST else (MOST, max(s - (p - MOST), min(s, 6)))


def result_type(op: str, a: tuple[int, int], b: tuple[int, int], by: str = "precision") -> tuple[int, int]:
    """(precision, scale) of `a op b`."""
    (p1, s1), (p2, s2) = a, b
    if op in ("add", "subtract"):
        s = max(s1, s2)
        return clamp(s + max(p1 - s1, p2 - s2) + 1, s)
    if op == "multiply":
        return clamp(p1 + p2 + 1, s1 + s2)
    if op == "divide":
        s = max(6, s1 + p2 + 1)
        return clamp(p1 - s1 + (p2 if by == "precision" else s2) + s, s)
    if op == "modulus":
        s = max(s1, s2)
        return clamp(min(p1 - s1, p2 - s2) + s, s)
    raise ValueError(f"no decimal rule for {op}")


def arithmetic(op: str, x: Column, y: Column, a: tuple[int, int], b: tuple[int, int], by: str = "precision") -> Column:
    """`x op y` of declared decimal types a and b, in the declared result type.

    A quotient is rounded once, half away from zero, to the declared scale.
    Division by zero is an error under ANSI mode.  Nullable where an operand
    is, and required otherwise (but for a remainder without whole digits).
    """
    to = T.DecimalType(*result_type(op, a, b, by))
    # A column that is null where an operand is, and declared nullable only then.
    either = (x == y).cast(to)
    if op == "add":
        return (x + y).cast(to)
    if op == "subtract":
        return (x - y).cast(to)
    if op == "multiply":
        return (x * y).cast(to)
    if op == "modulus":
        return F.coalesce((x % y).cast(to), either)
    return F.coalesce(quotient(x, y, a, b, to.scale).cast(to), either)


def quotient(x: Column, y: Column, a: tuple[int, int], b: tuple[int, int], s: int) -> Column:
    """x / y rounded once at scale s, half away from zero.

    Spark rounds a quotient at a scale of its own, which above the clamp is
    finer than s, so rounding it again could round twice.  Here it only says
    between which two multiples of 10**-s the quotient lies; the remainder of x
    by y * 10**-s, which Spark gives exactly, says which is nearer.  Types whose
    remainder would need more than 38 digits go through Python's decimals.
    """
    rounded = x / y
    if result_type("divide", a, b, by="scale")[1] == s:
        return rounded
    unit = (b[0] + s, b[1] + s)
    rest = (min(a[0] - a[1], b[0] - b[1]) + max(a[1], unit[1]), max(a[1], unit[1]))
    if unit[0] > MOST - 1 or rest[0] > MOST - 1:
        return wide_quotient(s)(x, y)
    step = F.abs(y * F.lit(Decimal(1).scaleb(-s)))
    over = F.abs(x % step)
    down, up = F.floor(F.abs(rounded), F.lit(s)), F.ceil(F.abs(rounded), F.lit(s))
    return F.when(over + over >= step, up).otherwise(down) * F.when((x < 0) != (y < 0), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")


def wide_quotient(s: int):
    """The same in Python, for operands of any width; division by zero is an error, a result of more than 38 digits null."""

    @F.pandas_udf(T.DecimalType(MOST, s))
    def divided(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: Decimal, q: Decimal) -> Decimal | None:
            exact = Fraction(p) / Fraction(q)
            whole = floor(abs(exact) * 10**s + Fraction(1, 2))
            return Decimal((exact < 0, Decimal(whole).as_tuple().digits, -s)) if whole < 10**MOST else None

        return pd.Series([None if p is None or q is None else one(p, q) for p, q in zip(x, y, strict=True)], dtype=object)

    return divided
