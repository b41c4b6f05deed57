"""Joins, set operations and grouping sets on random small tables with nulls, against plain Python."""

import operator
import random
from collections import Counter

import pytest
from helpers import bag, table
from pyspark.sql import functions as F

from plankton.operators import aggregate as agg
from plankton.operators import setops
from plankton.operators.joins import KINDS, join
from plankton.operators.rows import Invalid


def rows(rng, n, unique=False):
    keys = rng.sample(range(8), n) if unique else [rng.choice([None, *range(5)]) for _ in range(n)]
    return [(k, rng.choice([None, 1, 2, 3])) for k in keys]


def equal(a, b):
    return None if a is None or b is None else a == b


def both(p, q):
    """Three-valued and."""
    return False if p is False or q is False else None if p is None or q is None else True


def expected(kind, left, right, on):
    if kind.startswith("right_"):
        got = expected("left_" + kind[6:], right, left, lambda x, y: on(y, x))
        return [(*r[2:], *r[:2]) for r in got] if kind == "right_single" else got
    out, hit = [], [False] * len(right)
    for x in left:
        truths = [on(x, y) for y in right]
        partners = [y for y, t in zip(right, truths) if t]
        hit = [h or bool(t) for h, t in zip(hit, truths)]
        if kind in ("inner", "outer", "left", "right", "left_single"):
            out += [(*x, *y) for y in partners]
            if not partners and kind in ("outer", "left", "left_single"):
                out.append((*x, None, None))
        elif kind == "left_mark":
            out.append((*x, True if any(truths) else None if None in truths else False))
        elif bool(partners) == (kind == "left_semi"):
            out.append(x)
    if kind in ("outer", "right"):
        out += [(None, None, *y) for y, h in zip(right, hit) if not h]
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("kind", KINDS)
def test_joins(spark, kind, seed):
    rng = random.Random(f"{kind}{seed}")
    single = kind.endswith("single")
    left, right = rows(rng, rng.randrange(6), single), rows(rng, rng.randrange(6), single)
    a, b = table(spark, "k long, v long", *left), table(spark, "k long, w long", *right)
    one = expected(kind, left, right, lambda x, y: equal(x[0], y[0]))
    assert bag(join(a, b, [("k", "k")], kind)) == sorted(one, key=repr)
    if single:
        return
    two = expected(kind, left, right, lambda x, y: both(equal(x[0], y[0]), equal(x[1], y[1])))
    assert bag(join(a, b, [("k", "k"), ("v", "w")], kind)) == sorted(two, key=repr)
    more = expected(kind, left, right, lambda x, y: both(both(equal(x[0], y[0]), equal(x[1], y[1])), None if y[1] is None else y[1] > 1))
    assert bag(join(a, b, [("k", "k"), ("v", "w")], kind, residual=(lambda p, q: q["w"] > 1))) == sorted(more, key=repr)
    theta = expected(kind, left, right, lambda x, y: None if x[0] is None or y[0] is None else x[0] < y[0])
    assert bag(join(a, b, lambda p, q: p["k"] < q["k"], kind)) == sorted(theta, key=repr)


@pytest.mark.parametrize("kind,order", [*[(k, o) for k in ("left_mark", "right_mark") for o in ("<", "<=", ">", ">=")], ("inner", "<"), ("right_anti", ">=")])
def test_joins_with_an_order(spark, kind, order):
    """A residual that is a triple, over keys and columns that may be null; keys to which null is like any value; other types."""
    rng = random.Random(f"{kind}{order}")
    some = lambda: [tuple(rng.choice([None, 1, 2]) for _ in range(2)) + (rng.choice([None, 1, 2, 3]),) for _ in range(rng.randrange(1, 12))]
    left, right = some(), some()
    a, b = table(spark, "k long, v long, x long", *left), table(spark, "k long, w long, y long", *right)
    by = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[order]
    late = lambda p, q: None if p[2] is None or q[2] is None else by(p[2], q[2])
    for keys, truth in (
        ([("k", "k"), ("v", "w")], lambda p, q: both(both(equal(p[0], q[0]), equal(p[1], q[1])), late(p, q))),
        ([("k", "k")], lambda p, q: both(equal(p[0], q[0]), late(p, q))),
        ([("k", "k", "same"), ("v", "w")], lambda p, q: both(both(p[0] == q[0], equal(p[1], q[1])), late(p, q))),
    ):
        assert bag(join(a, b, keys, kind, residual=("x", order, "y"))) == sorted(expected(kind, left, right, truth), key=repr)
        assert bag(join(a, b.withColumn("y", F.col("y").cast("int")), keys, kind, residual=("x", order, "y"))) == sorted(expected(kind, left, right, truth), key=repr)


def test_marks_with_an_order_make_no_pairs(spark):
    """One key, 4e10 pairs."""
    many = spark.range(200_000)
    a, b = many.select(F.lit(1).alias("k"), F.col("id").alias("x")), many.select(F.lit(1).alias("q"), (F.col("id") - 5).alias("y"))
    out = join(a, b, [("k", "q")], "left_mark", residual=("x", "<", "y"))
    assert out.groupBy("mark").count().collect() and out.where("mark").count() == 199_994


def test_an_unknown_order_is_refused(spark):
    a, b = table(spark, "k long", (1,)), table(spark, "q long", (1,))
    with pytest.raises(Invalid):
        join(a, b, [("k", "q")], "left_mark", residual=("k", "<>", "q"))


def counted(name, first, *rest):
    a, others = Counter(first), [Counter(x) for x in rest]
    if name == "minus_primary":
        return [x for x in a if not any(x in o for o in others)]
    if name == "minus_multiset":
        return [x for x in a if not all(x in o for o in others)]
    if name == "intersection_primary":
        return [x for x in a if any(x in o for o in others)]
    if name == "intersection_multiset":
        return [x for x in a if all(x in o for o in others)]
    if name == "union_distinct":
        return list(set(first).union(*rest))
    for o in others:
        a = a - o if name == "minus_primary_all" else a & o if name == "intersection_multiset_all" else a + o
    return list(a.elements())


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("name", ["minus_primary", "minus_primary_all", "minus_multiset", "intersection_primary", "intersection_multiset", "intersection_multiset_all", "union_distinct", "union_all"])
def test_set_operations(spark, name, seed):
    rng = random.Random(f"{name}{seed}")
    inputs = [[(rng.choice([None, 1, 2]), rng.choice(["a", None])) for _ in range(rng.randrange(9))] for _ in range(3)]
    got = getattr(setops, name)(*[table(spark, "x long, y string", *i) for i in inputs])
    assert bag(got) == sorted(counted(name, *inputs), key=repr)


def test_grouping_sets(spark):
    rng = random.Random(0)
    data = [(rng.choice([None, 1, 2]), rng.choice([None, "a"]), rng.choice([None, 5, 7])) for _ in range(40)]
    sets = agg.cube_sets(["g", "h"])
    assert sets == [["g", "h"], ["g"], ["h"], []]
    want = []
    for i, s in enumerate(sets):
        groups = {}
        for g, h, v in data:
            groups.setdefault((g if "g" in s else None, h if "h" in s else None), []).append(v)
        want += [(*k, sum(x for x in v if x is not None) if any(x is not None for x in v) else None, i) for k, v in groups.items()]
    got = agg.aggregate(table(spark, "g long, h string, v long", *data), ["g", "h"], sets, s=F.sum("v"))
    assert bag(got) == sorted(want, key=repr)
