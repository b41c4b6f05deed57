"""The twelve join types, cross and lateral joins.

Every join names its inputs' columns uniquely inside, so self joins and inputs
with equal names need no aliases.  The output has the left columns and then the
right ones (semi, anti and mark joins: one side, mark joins with one boolean
more); a right name that the left has too gets the suffix `_r`.  Spark's own
joins declare exactly the sides nullable that may lack a partner.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import declared, widen, widen_all
from .rows import Invalid, distinct_names

#: Join kinds and Spark's names of those that it has itself.
SPARK = {"inner": "inner", "outer": "full", "left": "left", "right": "right", "left_semi": "left_semi", "left_anti": "left_anti"}
SWAPPED = {"right_semi": "left_semi", "right_anti": "left_anti", "right_single": "left_single", "right_mark": "left_mark"}
KINDS = (*SPARK, *SWAPPED, "left_single", "left_mark")
#: How a physical join asks for its algorithm; the optimizer may still choose another.
HINTS = {"hash": "shuffle_hash", "merge": "merge"}
#: How a key pair is compared: `equal` has no partner for a null, to `same` a null is like any value.
COMPARISONS = ("equal", "same")
#: Comparisons of a left with a right column that a residual may be, each with what it is from the right side's view.
ORDERS = {"<": (operator.lt, ">"), "<=": (operator.le, ">="), ">": (operator.gt, "<"), ">=": (operator.ge, "<=")}


class Side:
    """Columns of one input of a join, by name or position."""

    def __init__(self, df: DataFrame, prefix: str):
        self.names = df.columns
        self.inner = [f"{prefix}{i}" for i in range(len(self.names))]
        self.df = df.toDF(*self.inner)

    def __getitem__(self, key: str | int) -> Column:
        try:
            return F.col(self.inner[key if isinstance(key, int) else self.names.index(key)])
        except (IndexError, ValueError):
            raise Invalid(f"no column {key!r} among {self.names}") from None

    def nullable(self, key: str) -> bool:
        return self.df.schema[self.names.index(key)].nullable

    def type(self, key: str) -> T.DataType:
        return self.df.schema[self.names.index(key)].dataType

    def output(self, others: Sequence[str] = ()) -> list[str]:
        return [n + "_r" * (n in others) for n in self.names]

    def shown(self, others: Sequence[str] = ()) -> list[Column]:
        return [F.col(c).alias(n) for c, n in zip(self.inner, self.output(others), strict=True)]


class Named:
    """Columns of the right side of a lateral join, which Spark resolves only inside the join."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)

    def __getitem__(self, key: str | int) -> Column:
        try:
            return F.col(f"`{self.names[key if isinstance(key, int) else self.names.index(key)]}`")
        except (IndexError, ValueError):
            raise Invalid(f"no column {key!r} among {self.names}") from None


class Outer:
    """Columns of a side as a correlated subquery sees them."""

    def __init__(self, side: Side):
        self.side = side

    def __getitem__(self, key: str | int) -> Column:
        return self.side[key].outer()


Condition = Callable[[Side, Side], Column]
Key = tuple[str, str, str]
Keys = Sequence[tuple[str, str] | Key]
Order = tuple[str, str, str]


def _all(conditions: Iterable[Column]) -> Column:
    return functools.reduce(lambda p, q: p & q, conditions, F.lit(True))


def _compared(x: Column, y: Column, how: str) -> Column:
    return x == y if how == "equal" else x.eqNullSafe(y)


def _ordered(order: Order) -> Condition:
    x, how, y = order
    return lambda a, b: ORDERS[how][0](a[x], b[y])


def _both(a: Side, b: Side) -> list[Column]:
    distinct_names([*a.names, *b.output(a.names)])
    return [*a.shown(), *b.shown(a.names)]


def join(left: DataFrame, right: DataFrame, on: Condition | Keys, kind: str = "inner", *, algorithm: str | None = None, residual: Condition | Order | None = None, post_filter: Callable[[DataFrame], Column] | None = None, mark: str = "mark") -> DataFrame:
    """Joins by a condition or by key pairs (left, right) that must be equal: a null key has no partner, but in a triple (left, right, "same") null equals null.

    algorithm: `hash` or `merge`, a wish for key joins.  residual: one more
    condition on pairs, or a triple (left, order, right) such as ("a", "<", "b"),
    for which marks of key lists need no pairs.  post_filter: a condition on the
    output's columns.  Single joins raise an error when a row has more than one partner.  A mark is
    true if some pair is, else null if some pair is unknown, else false.  An
    output in which two columns would share a name is refused.
    """
    if kind not in KINDS:
        raise Invalid(f"no join kind {kind}")
    if not callable(on):
        on = [k if len(k) == 3 else (*k, "equal") for k in on]
        if bad := [k for k in on if k[2] not in COMPARISONS]:
            raise Invalid(f"no comparison {bad[0][2]}")
    order = residual if residual is not None and not callable(residual) else None
    if order is not None:
        if len(order) != 3 or order[1] not in ORDERS:
            raise Invalid(f"no comparison {order}")
        residual = _ordered(order)
    if kind in SWAPPED:
        swapped = [(b, a, how) for a, b, how in on] if not callable(on) else lambda x, y: on(y, x)
        rest = (order[2], ORDERS[order[1]][1], order[0]) if order is not None else None if residual is None else lambda x, y: residual(y, x)
        out = join(right, left, swapped, SWAPPED[kind], algorithm=algorithm, residual=rest, mark=mark)
        if kind == "right_single":
            n = len(right.columns)
            places = [*range(n, n + len(left.columns)), *range(n)]
            names = [*left.columns, *[c + "_r" * (c in left.columns) for c in right.columns]]
            distinct_names(names)
            out = out.toDF(*[f"_{i}" for i in range(len(places))]).select(*[F.col(f"_{i}").alias(c) for i, c in zip(places, names, strict=True)])
    else:
        a, b = Side(left, "_l"), Side(right, "_r")
        keys = None if callable(on) else on
        condition = on(a, b) if keys is None else _all(_compared(a[x], b[y], how) for x, y, how in keys)
        rest = None if residual is None else residual(a, b)
        condition = condition if rest is None else condition & rest
        if kind == "left_single":
            out = _single(a, b, condition, keys if rest is None else None)
        elif kind == "left_mark":
            distinct_names([*a.names, mark])
            if keys is None:
                out = _mark_theta(a, b, condition, mark)
            elif rest is None:
                out = _mark(a, b, keys, mark)
            elif order is not None and a.type(order[0]) == b.type(order[2]):
                out = _mark_ordered(a, b, keys, order, mark)
            else:
                out = _mark_residual(a, b, keys, rest, mark)
        else:
            other = b.df.hint(HINTS[algorithm]) if algorithm in HINTS else b.df
            out = a.df.join(other, condition, SPARK[kind])
            out = out.select(*a.shown()) if kind in ("left_semi", "left_anti") else out.select(*_both(a, b))
    return out if post_filter is None else out.where(post_filter(out))


def _one(n: Column, row: Column) -> Column:
    """row, but an error if there are more than one; part of each output column, so no pruning can lose it."""
    return F.when(n > 1, F.raise_error(F.lit("a row of a single join has more than one partner"))).otherwise(row)


def _single(a: Side, b: Side, condition: Column, keys: Keys | None) -> DataFrame:
    distinct_names([*a.names, *b.output(a.names)])
    if keys is not None:
        # One row a key on the right, with the count that decides; a hot key is summed up before the shuffle.
        once = b.df.groupBy(*[b[y].alias(f"_k{i}") for i, (_, y, _) in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*b.inner)).alias("_row"))
        out = a.df.join(once, _all(_compared(a[x], F.col(f"_k{i}"), how) for i, (x, _, how) in enumerate(keys)), "left")
    else:
        rows = a.df.withColumn("_id", F.monotonically_increasing_id()).join(b.df.withColumn("_there", F.lit(1)), condition, "left")
        # The left side is read once; ids need not survive a second reading.
        out = rows.groupBy("_id").agg(*[F.first(c).alias(c) for c in a.inner], F.count("_there").alias("_n"), F.first(F.when(F.col("_there").isNotNull(), F.struct(*b.inner)), ignorenulls=True).alias("_row"))
        out = declared(out, a.df.schema)
    one = _one(F.col("_n"), F.col("_row"))
    return widen_all(out.select(*a.shown(), *[one[c].alias(n) for c, n in zip(b.inner, b.output(a.names), strict=True)]), b.output(a.names))


def _mark(a: Side, b: Side, keys: list[Key], name: str) -> DataFrame:
    """Marks of key joins, without making a pair.

    A pair is true if all keys are equal and unknown if those that are not null
    on both sides are equal and some key is null.  So for each set of keys that
    may be null the other keys of the left row are looked up among the distinct
    ones of the right rows whose nulls lie in that set, together with which
    nulls they have; with no other key left, that is one row.  One key needs
    one lookup and that row; k keys that may be null need 2**k lookups.
    """
    equal = b.df.select(*[b[y].alias(f"_k{i}") for i, (_, y, _) in enumerate(keys)]).distinct().withColumn("_hit", F.lit(True))
    rows = a.df.join(equal, _all(_compared(a[x], F.col(f"_k{i}"), how) for i, (x, _, how) in enumerate(keys)), "left").select(*a.inner, "_hit")
    open_keys = [i for i, (x, y, how) in enumerate(keys) if how == "equal" and (a.nullable(x) or b.nullable(y))]
    bits = lambda side, at, within: functools.reduce(lambda p, q: p + q, [F.when(side[keys[i][at]].isNull(), 1 << i).otherwise(0) for i in within])
    unknown = F.lit(False)
    for chosen in range(1, 1 << len(open_keys)):
        skipped = [i for k, i in enumerate(open_keys) if chosen >> k & 1]
        whole = sum(1 << i for i in skipped)
        rest = [i for i in range(len(keys)) if i not in skipped]
        right = b.df.where(_all(b[keys[i][1]].isNotNull() for i in rest if keys[i][2] == "equal")) if rest else b.df
        held = right.groupBy(*[b[keys[i][1]].alias(f"_k{i}") for i in rest]).agg(F.collect_set(bits(b, 1, skipped)).alias("_nulls"))
        if rest:
            rows = rows.join(held, _all(_compared(a[keys[i][0]], F.col(f"_k{i}"), keys[i][2]) for i in rest), "left").drop(*[f"_k{i}" for i in rest])
        else:
            rows = rows.crossJoin(F.broadcast(held))
        # The nulls of both rows together are those skipped keys and no fewer.
        meets = F.exists(F.transform("_nulls", bits(a, 0, skipped).bitwiseOR), _is(whole))
        rows = rows.withColumn("_unknown", F.coalesce(meets, F.lit(False)) | (F.col("_unknown") if "_unknown" in rows.columns else F.lit(False))).drop("_nulls")
        unknown = F.col("_unknown")
    value = F.when(F.col("_hit"), F.lit(True)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return rows.select(*a.shown(), widen(value).alias(name))


def _is(value: int) -> Callable[[Column], Column]:
    return lambda x: x == value


def _mark_ordered(a: Side, b: Side, keys: list[Key], order: Order, name: str) -> DataFrame:
    """Marks of key joins with one comparison of a left with a right column more, without making a pair.

    Some row of a key compares true if the greatest (for < and <=) or the least
    one does, and some compares to unknown if either column is null.  So the
    lookups are those of _mark, with these two of the rows of each key and of
    their nulls; rows are summed up in each task before they are shuffled.
    """
    x, how, y = order
    extreme = F.max if how in ("<", "<=") else F.min
    open_keys = [i for i, (p, q, kind) in enumerate(keys) if kind == "equal" and (a.nullable(p) or b.nullable(q))]
    bits = lambda side, at, within: functools.reduce(lambda p, q: p + q, [F.when(side[keys[i][at]].isNull(), 1 << i).otherwise(0) for i in within], F.lit(0))
    rows = a.df.withColumns({"_hit": F.lit(False), "_unknown": F.lit(False)})
    for chosen in range(1 << len(open_keys)):
        skipped = [i for k, i in enumerate(open_keys) if chosen >> k & 1]
        whole = sum(1 << i for i in skipped)
        rest = [i for i in range(len(keys)) if i not in skipped]
        right = b.df.where(_all(b[keys[i][1]].isNotNull() for i in rest if keys[i][2] == "equal"))
        names = [f"_k{i}" for i in rest]
        right = right.groupBy(*[b[keys[i][1]].alias(n) for i, n in zip(rest, names, strict=True)], bits(b, 1, skipped).alias("_nulls")).agg(extreme(b[y]).alias("_end"), F.bool_or(b[y].isNull()).alias("_open"))
        held = right.groupBy(*names).agg(F.collect_list(F.struct("_nulls", "_end", "_open")).alias("_held"))
        rows = rows.join(held, _all(_compared(a[keys[i][0]], F.col(f"_k{i}"), keys[i][2]) for i in rest), "left").drop(*names) if rest else rows.crossJoin(F.broadcast(held))
        # The nulls of both rows together are those skipped keys and no fewer.
        meets = F.filter("_held", lambda h: bits(a, 0, skipped).bitwiseOR(h["_nulls"]) == whole)  # noqa: B023
        true = F.coalesce(F.exists(meets, lambda h: F.coalesce(ORDERS[how][0](a[x], h["_end"]), F.lit(False))), F.lit(False))
        null = F.coalesce(F.exists(meets, lambda h: a[x].isNull() | h["_open"]), F.lit(False))
        # With a null key a pair is unknown unless the comparison is false.
        rows = rows.withColumns({"_unknown": F.col("_unknown") | null | true} if skipped else {"_hit": true, "_unknown": null}).drop("_held")
    value = F.when(F.col("_hit"), F.lit(True)).when(F.col("_unknown"), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return rows.select(*a.shown(), widen(value).alias(name))


def _mark_residual(a: Side, b: Side, keys: list[Key], residual: Column, name: str) -> DataFrame:
    """Marks of key joins with one more condition on pairs.

    Only pairs whose keys are equal or unknown are made, by one join on the
    keys: each row is dealt to every set of keys that may count as null, its
    own nulls among them, with those keys blanked.
    """
    open_keys = [i for i, (x, y, how) in enumerate(keys) if how == "equal" and (a.nullable(x) or b.nullable(y))]
    sets = [[i for k, i in enumerate(open_keys) if n >> k & 1] for n in range(1 << len(open_keys))]

    def dealt(df: DataFrame, side: Side, at: int, p: str) -> DataFrame:
        nulls = functools.reduce(lambda u, v: u + v, [F.when(side[keys[i][at]].isNull(), 1 << i).otherwise(0) for i in open_keys], F.lit(0))
        rows = [F.struct(F.lit(sum(1 << i for i in s)).alias(f"{p}set"), *[(F.lit(None).cast(side.type(keys[i][at])) if i in s else side[keys[i][at]]).alias(f"{p}k{i}") for i in range(len(keys))]) for s in sets]
        df = df.withColumn(f"{p}nulls", nulls).withColumn(f"{p}d", F.explode(F.array(*rows))).select("*", f"{p}d.*").drop(f"{p}d")
        return df.where(F.col(f"{p}nulls").bitwiseAND(F.col(f"{p}set")) == F.col(f"{p}nulls"))

    left = dealt(a.df.withColumn("_id", F.monotonically_increasing_id()), a, 0, "_a")
    right = dealt(b.df.withColumn("_there", F.lit(1)), b, 1, "_b")
    same = _all([F.col("_aset") == F.col("_bset"), *[F.col(f"_ak{i}").eqNullSafe(F.col(f"_bk{i}")) for i in range(len(keys))]])
    exact = F.col("_anulls").bitwiseOR(F.col("_bnulls")) == F.col("_aset")
    pairs = left.join(right, same & exact & F.coalesce(residual, F.lit(True)), "left")
    hit = F.bool_or(F.when(F.col("_there").isNotNull(), (F.col("_aset") == 0) & F.coalesce(residual, F.lit(False))))
    return _summed(pairs, a, hit, name)


def _mark_theta(a: Side, b: Side, condition: Column, name: str) -> DataFrame:
    """Marks of a condition: pairs that are true or unknown; the rest could not change a mark.  Every pair is compared."""
    pairs = a.df.withColumn("_id", F.monotonically_increasing_id()).join(b.df.withColumn("_there", F.lit(1)), F.coalesce(condition, F.lit(True)), "left")
    return _summed(pairs, a, F.bool_or(F.when(F.col("_there").isNotNull(), F.coalesce(condition, F.lit(False)))), name)


def _summed(pairs: DataFrame, a: Side, hit: Column, name: str) -> DataFrame:
    """One row a left row, with its mark, of the pairs that are true (hit) or unknown.  The left side is read once, so its ids need not survive a second reading."""
    out = pairs.groupBy("_id").agg(*[F.first(c).alias(c) for c in a.inner], hit.alias("_hit"), F.count("_there").alias("_n"))
    value = F.when(F.col("_hit"), F.lit(True)).when(F.col("_n") > 0, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return declared(out, a.df.schema).select(*a.shown(), widen(value).alias(name))


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows; nullability stays as it is."""
    a, b = Side(left, "_l"), Side(right, "_r")
    return a.df.crossJoin(b.df).select(*_both(a, b))


def lateral(left: DataFrame, right: Callable[[Callable[[str], Column]], DataFrame], kind: str = "inner", *, condition: Condition | None = None, post_filter: Callable[[DataFrame], Column] | None = None, mark: str = "mark") -> DataFrame:
    """Joins each left row with the rows that right(outer) has for it; outer(name) is a column of that left row.

    Kinds: inner, left, left_semi, left_anti, left_single, left_mark.
    condition(a, b) is one more condition on pairs, of columns of the two
    sides; with it a mark is three-valued as that of a join (without it every
    row of right(outer) is a true pair).  post_filter: a condition on the
    output's columns.  Spark turns the correlation into a join where it can.
    """
    a = Side(left, "_l")
    sub = right(lambda name: a[name].outer())
    b = Named(a.df.lateralJoin(sub).columns[len(a.names) :])
    shown = [n + "_r" * (n in a.names) for n in b.names]
    if kind in ("inner", "left"):
        distinct_names([*a.names, *shown])
        out = a.df.lateralJoin(sub, on=None if condition is None else condition(a, b), how=kind).toDF(*a.names, *shown)
    elif kind in ("left_semi", "left_anti", "left_single"):
        held = sub if condition is None else sub.where(condition(Outer(a), b))
        if kind == "left_single":
            got = a.df.select("*", held.select(F.struct("*")).scalar().alias("_row"))
            distinct_names([*a.names, *shown])
            out = got.select(*a.shown(), *[F.col("_row")[c].alias(o) for c, o in zip(b.names, shown, strict=True)])
        else:
            out = a.df.where(held.exists() if kind == "left_semi" else ~held.exists()).select(*a.shown())
    elif kind == "left_mark":
        distinct_names([*a.names, mark])
        if condition is None:
            out = a.df.select(*a.shown(), widen(sub.exists()).alias(mark))
        else:
            rows = a.df.withColumn("_id", F.monotonically_increasing_id()).lateralJoin(sub.select("*", F.lit(1).alias("_there")), how="left")
            truth = F.when(F.col("_there").isNotNull(), condition(a, b))
            rows = rows.withColumn("_there", F.when(F.coalesce(truth, F.lit(True)), F.col("_there")))
            out = _summed(rows, a, F.bool_or(F.coalesce(truth, F.lit(False))), mark)
    else:
        raise Invalid(f"no lateral join of kind {kind}")
    return out if post_filter is None else out.where(post_filter(out))
