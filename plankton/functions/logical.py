"""Types that Spark has no type for, kept with a column as its metadata.

Spark carries a column's metadata through projections, filters, joins and
unions' first input, so a declared type is still known where the column comes
out; notation.schema_of() shows it.  The values obey the declaration: a value
that does not fit is an error, as it is when a declared table is read.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nulls import required

KEY = "plankton.type"
KINDS = ("uuid", "fbin", "fchar", "vchar", "precision_timestamp", "precision_timestamp_tz")
#: Digits of a second that Spark keeps.
DIGITS = 6


def parsed(logical: str) -> tuple[str, int]:
    m = re.fullmatch(r"(\w+?)(?:\((\d+)\))?", logical)
    if not m or m[1] not in KINDS or (m[1] == "uuid") != (m[2] is None):
        raise ValueError(f"no declared type {logical}")
    n = int(m[2] or 0)
    if m[1].startswith("precision") and n > DIGITS:
        raise ValueError(f"{logical}: Spark keeps {DIGITS} digits of a second, and more would be lost silently")
    return m[1], n


def _fits(c: Column, condition: Column, logical: str) -> Column:
    return F.when(c.isNull() | condition, c).otherwise(F.raise_error(F.concat(F.lit(f"a value does not fit {logical}: "), c.cast("string"))))


def _truncated(c: Column, digits: int) -> Column:
    """A timestamp without what is finer than so many digits of a second."""
    fine = F.extract(F.lit("SECOND"), c) % F.lit(Decimal(1).scaleb(-digits)).cast("decimal(8,6)")
    return c - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), fine)


def declare(df: DataFrame, **logical: str) -> DataFrame:
    """Declares columns: uuid (a string in lower case), fbin(n), fchar(n) (padded), vchar(n), precision_timestamp(p), precision_timestamp_tz(p).

    Nullability stays; timestamps are cut to p digits.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in logical:
            kind, n = parsed(logical[f.name])
            t: T.DataType = f.dataType
            if kind == "uuid":
                c = F.lower(c)
                c = _fits(c, c.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), logical[f.name])
            elif kind == "fbin":
                c = _fits(c, F.octet_length(c) == n, logical[f.name])
            elif kind in ("fchar", "vchar"):
                c = _fits(c, F.char_length(c) <= n, logical[f.name])
                c = F.rpad(c, n, " ") if kind == "fchar" else c
            elif n < DIGITS:
                c = _truncated(c, n)
            c = c if f.nullable else required(c, t)
            c = c.alias(f.name, metadata={KEY: logical[f.name]})
        out.append(c)
    return df.select(*out)
