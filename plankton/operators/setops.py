"""Set operations over a primary input and one or more others.

Distinct operations count a row once and treat nulls as equal.  Spark's own
operators declare each column nullable exactly where a null can come through.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame

from .rows import Invalid


def _checked(inputs: tuple[DataFrame, ...]) -> list[DataFrame]:
    if len(inputs) < 2:
        raise Invalid("a set operation takes two inputs at least")
    first = [t for _, t in inputs[0].dtypes]
    for x in inputs[1:]:
        own = [t for _, t in x.dtypes]
        if len(own) != len(first):
            raise Invalid(f"inputs have {len(first)} and {len(own)} columns")
        if own != first:
            raise Invalid(f"inputs differ in type: {first} and {own}")
    return [x.toDF(*inputs[0].columns) for x in inputs]


def _fold(method: str, inputs: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda x, y: getattr(x, method)(y), inputs)


def minus_primary(*inputs: DataFrame) -> DataFrame:
    """Distinct rows of the primary that no other input has."""
    return _fold("subtract", _checked(inputs))


def minus_primary_all(*inputs: DataFrame) -> DataFrame:
    """Each occurrence in another input takes away one in the primary."""
    return _fold("exceptAll", _checked(inputs))


def minus_multiset(*inputs: DataFrame) -> DataFrame:
    """Distinct rows of the primary that not all other inputs have."""
    primary, *others = _checked(inputs)
    return primary.subtract(_fold("intersect", others))


def intersection_primary(*inputs: DataFrame) -> DataFrame:
    """Distinct rows of the primary that some other input has."""
    primary, *others = _checked(inputs)
    return primary.intersect(_fold("unionAll", others))


def intersection_multiset(*inputs: DataFrame) -> DataFrame:
    """Distinct rows that all inputs have."""
    return _fold("intersect", _checked(inputs))


def intersection_multiset_all(*inputs: DataFrame) -> DataFrame:
    """Rows as often as the input that has them least often."""
    return _fold("intersectAll", _checked(inputs))


def union_distinct(*inputs: DataFrame) -> DataFrame:
    """Distinct rows of all inputs."""
    return _fold("unionAll", _checked(inputs)).distinct()


def union_all(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs."""
    return _fold("unionAll", _checked(inputs))
