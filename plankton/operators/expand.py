"""Expand, exchange and shared subplans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import Invalid, distinct_names

#: Bytes of rows that a broadcast exchange may send to every task, by the optimizer's estimate.
BROADCAST_BYTES = 256 << 20


def expand(df: DataFrame, fields: Sequence[Column | Sequence[Column]], *, index: str = "duplicate") -> DataFrame:
    """Several rows for each input row, and the required 32-bit number of the duplicate.

    fields define the output's columns by position: one expression is the same
    in all duplicates, a list has one for each duplicate.  Input columns beyond
    the definitions pass through.  A switching column is nullable if any of its
    expressions is.
    """
    switching = [f for f in fields if not isinstance(f, Column)]
    counts = {len(f) for f in switching}
    if len(counts) > 1:
        raise Invalid("switching fields have different numbers of duplicates")
    n = counts.pop() if counts else 1
    names = df.columns
    if len(fields) > len(names):
        names = [*names, *[f"field{i}" for i in range(len(names), len(fields))]]
    distinct_names([*names, index])
    rows = [F.struct(*[(f if isinstance(f, Column) else f[i]).alias(f"_f{j}") for j, f in enumerate(fields)]) for i in range(n)]
    dealt = df.select(*[F.col(f"`{c}`").alias(f"_p{j}") for j, c in enumerate(df.columns)], F.posexplode(F.array(*rows)).alias(index, "_row"))
    out = [F.col("_row")[f"_f{j}"].alias(names[j]) for j in range(len(fields))]
    out += [F.col(f"_p{j}").alias(names[j]) for j in range(len(fields), len(df.columns))]
    return dealt.select(*out, index)


def exchange(df: DataFrame, kind: str = "round_robin", *, partitions: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The same rows, dealt anew: `round_robin`, by the hash of `keys` (`scatter`), by ranges of them (`range`), into one partition (`single`) or to every task (`broadcast`).

    A broadcast takes effect where the rows are joined; it is refused if the
    optimizer's estimate of their size is over BROADCAST_BYTES or unknown.
    """
    if kind == "broadcast":
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size > BROADCAST_BYTES:
            raise Invalid(f"about {size} bytes are too many for a broadcast")
        return F.broadcast(df)
    if kind == "single":
        return df.coalesce(1)
    if kind in ("scatter", "range") and not keys:
        raise Invalid(f"{kind} needs keys")
    size = [partitions] if partitions else []
    if kind == "scatter":
        return df.repartition(*size, *keys)
    if kind == "range":
        return df.repartitionByRange(*size, *keys)
    if kind == "round_robin":
        return df.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    raise Invalid(f"no exchange of kind {kind}")
