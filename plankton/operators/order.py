"""Sorting, offset and count, top-n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import Invalid

#: Direction and place of nulls are one choice.
DIRECTIONS = {"asc_nulls_first": F.asc_nulls_first, "asc_nulls_last": F.asc_nulls_last, "desc_nulls_first": F.desc_nulls_first, "desc_nulls_last": F.desc_nulls_last}


def order(keys: Sequence[tuple[str, str]]) -> list[Column]:
    if bad := [d for _, d in keys if d not in DIRECTIONS]:
        raise Invalid(f"no sort direction {bad[0]}")
    return [DIRECTIONS[d](c) for c, d in keys]


def sort(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*order(keys))


def fetch(df: DataFrame, count: int | None = None, offset: int | None = None) -> DataFrame:
    """Skips offset rows (None: none) and passes on count (None: all)."""
    if (offset or 0) < 0 or (count or 0) < 0:
        raise Invalid("offset and count are not negative")
    df = df.offset(offset) if offset else df
    return df if count is None else df.limit(count)


def topn(df: DataFrame, keys: Sequence[tuple[str, str]], count: int, offset: int | None = None) -> DataFrame:
    """The first rows of the order: each task keeps offset + count, and no full sort is made."""
    return fetch(sort(df, keys), count, offset)
