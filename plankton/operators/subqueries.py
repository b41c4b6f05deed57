"""Truth values of comparisons with all members of a list, as a column more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import widen
from .joins import join
from .rows import Invalid, distinct_names

#: The comparisons, and for those by order whether `any` looks at the greatest member.
ORDERED = {"<": True, "<=": True, ">": False, ">=": False}
COMPARISONS = (*ORDERED, "=", "<>")


def compare(df: DataFrame, column: str, comparison: str, quantifier: str, members: DataFrame, *, name: str = "mark") -> DataFrame:
    """df with `name`: column comparison any (or all) of the one column of `members`, three-valued.

    `any` is true if a member makes the comparison true, else null if one makes
    it unknown, else false; `all` is false if one makes it false, else null if
    one makes it unknown, else true.  An empty list gives false and true.
    Members are summed up in one row; equality with any is a mark join.
    """
    if comparison not in COMPARISONS:
        raise Invalid(f"no comparison {comparison}")
    if quantifier not in ("any", "all"):
        raise Invalid(f"no quantifier {quantifier}")
    if len(members.columns) != 1:
        raise Invalid("the list has one column")
    distinct_names([*df.columns, name])
    if (comparison, quantifier) in (("=", "any"), ("<>", "all")):
        out = join(df, members, [(column, members.columns[0])], "left_mark", mark=name)
        return out if quantifier == "any" else out.withColumn(name, ~F.col(f"`{name}`"))
    negated = (comparison, quantifier) == ("<>", "any")  # as not (= all)
    quantifier = "all" if negated else quantifier
    m = F.col(f"`{members.columns[0]}`")
    about = members.agg(F.struct(F.min(m).alias("low"), F.max(m).alias("high"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(m)).alias("unknown")).alias("_about"))
    inner = df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).crossJoin(F.broadcast(about))
    x, low, high = F.col(f"_c{df.columns.index(column)}"), F.col("_about.low"), F.col("_about.high")
    known: Column
    if comparison in ORDERED:
        edge = high if ORDERED[comparison] == (quantifier == "any") else low
        known = {"<": x < edge, "<=": x <= edge, ">": x > edge, ">=": x >= edge}[comparison]
    else:
        known = (x == low) & (x == high)
    decisive = quantifier == "any"
    some = F.lit(None).cast("boolean")
    value = F.when(F.col("_about.n") == 0, F.lit(not decisive)).when(known == decisive, F.lit(decisive))
    value = value.when(x.isNull() | (F.col("_about.unknown") > 0), some).otherwise(F.lit(not decisive))
    return inner.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)], widen(~value if negated else value).alias(name))
