"""Aggregation with one or several grouping sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import Invalid, distinct_names, fresh


def filtered(argument: Column, condition: Column) -> Column:
    """The argument of a measure that counts only rows for which the condition is true: null elsewhere."""
    return F.when(condition, argument)


def aggregate(df: DataFrame, keys: Sequence[str] = (), sets: Sequence[Sequence[str]] | None = None, *, index: str = "set_index", **measures: Column) -> DataFrame:
    """Keys in their order, measures, and with more than one grouping set the required 32-bit ordinal of the set.

    A key that is not in every set is declared nullable and is null in the sets
    without it.  Equal sets are different ones, with an ordinal each.  All sets
    are made from one scan and one shuffle: each row is dealt to every set, and
    rows are summed up before they are shuffled.  A set without keys gives one
    row for an empty input, as SQL has it; to tell, one row of the input is read
    once more.
    """
    if not keys and not measures:
        raise Invalid("an aggregation needs a key or a measure")
    sets = [list(keys)] if sets is None else [list(s) for s in sets]
    if unknown := [k for s in sets for k in s if k not in keys]:
        raise Invalid(f"grouping set with unknown key {unknown[0]}")
    named = [c.alias(n) for n, c in measures.items()]
    if len(sets) == 1:
        held = [F.col(f"`{k}`") for k in keys if k in sets[0]]
        distinct_names([*[k for k in keys if k in sets[0]], *measures])
        out = df.groupBy(*held)
        return out.agg(*named) if named else df.select(*held).distinct()
    distinct_names([*keys, *measures, index])
    at = fresh(df, "_set")
    dealt = df.withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(len(sets) - 1))))
    groups = []
    for i, k in enumerate(keys):
        holds = [n for n, s in enumerate(sets) if k in s]
        c = F.col(f"`{k}`")
        groups.append((c if len(holds) == len(sets) else F.when(F.col(at).isin(holds), c)).alias(f"_k{i}"))
    inner = [f"_m{i}" for i in range(len(measures))]
    out = dealt.groupBy(*groups, F.col(at).alias("_s")).agg(*([c.alias(n) for c, n in zip(measures.values(), inner, strict=True)] or [F.count(F.lit(1)).alias("_n")]))
    out = out.select(*[F.col(f"_k{i}") for i in range(len(keys))], *inner, "_s")
    if bare := [i for i, s in enumerate(sets) if not s]:
        empty = df.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(F.explode(F.array(*map(F.lit, bare))).alias("_s"))
        totals = df.where(F.lit(False)).agg(*([c.alias(n) for c, n in zip(measures.values(), inner, strict=True)] or [F.count(F.lit(1)).alias("_n")]))
        rows = empty.crossJoin(totals).select(*[F.lit(None).cast(out.schema[f"_k{i}"].dataType).alias(f"_k{i}") for i in range(len(keys))], *inner, "_s")
        out = out.unionAll(rows)
    return out.toDF(*keys, *measures, index)


def rollup_sets(keys: Sequence[str]) -> list[list[str]]:
    """All leading runs of the keys, the longest first."""
    return [list(keys[:n]) for n in range(len(keys), -1, -1)]


def cube_sets(keys: Sequence[str]) -> list[list[str]]:
    """All subsets of the keys, in order."""
    n = len(keys)
    return [[k for i, k in enumerate(keys) if not m >> (n - 1 - i) & 1] for m in range(1 << n)]
