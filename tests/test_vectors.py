"""Small inputs with declared nullability: output schema and rows of each operator."""

import random
from decimal import Decimal
from fractions import Fraction
from math import floor

import pytest
from helpers import bag, table
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plankton.functions import aggregates, decimals, logical
from plankton.functions.notation import schema_of
from plankton.functions.nulls import narrow, widen, widen_all
from plankton.operators import aggregate as agg
from plankton.operators import expand, order, rows, setops, subqueries, window
from plankton.operators.joins import cross, join, lateral
from plankton.operators.rows import Invalid
from plankton.sources import tables

ON = [("a0", "b0")]


@pytest.fixture
def left(spark):
    return table(spark, "a0 long not null, a1 long", (1, None), (2, 2))


@pytest.fixture
def right(spark):
    return table(spark, "b0 long not null, b1 long", (2, 20), (5, 50))


JOINS = {
    "inner": ("i64 i64? i64 i64?", [(2, 2, 2, 20)]),
    "outer": ("i64? i64? i64? i64?", [(1, None, None, None), (2, 2, 2, 20), (None, None, 5, 50)]),
    "left": ("i64 i64? i64? i64?", [(1, None, None, None), (2, 2, 2, 20)]),
    "right": ("i64? i64? i64 i64?", [(2, 2, 2, 20), (None, None, 5, 50)]),
    "left_semi": ("i64 i64?", [(2, 2)]),
    "left_anti": ("i64 i64?", [(1, None)]),
    "right_semi": ("i64 i64?", [(2, 20)]),
    "right_anti": ("i64 i64?", [(5, 50)]),
    "left_single": ("i64 i64? i64? i64?", [(1, None, None, None), (2, 2, 2, 20)]),
    "right_single": ("i64? i64? i64 i64?", [(2, 2, 2, 20), (None, None, 5, 50)]),
    "left_mark": ("i64 i64? bool?", [(1, None, False), (2, 2, True)]),
    "right_mark": ("i64 i64? bool?", [(2, 20, True), (5, 50, False)]),
}


@pytest.mark.parametrize("kind", JOINS)
@pytest.mark.parametrize("on", [ON, lambda a, b: a["a0"] == b["b0"]], ids=["keys", "condition"])
def test_join(left, right, kind, on):
    out = join(left, right, on, kind)
    schema, want = JOINS[kind]
    assert schema_of(out) == schema.split()
    assert bag(out) == sorted(want, key=repr)


@pytest.mark.parametrize("algorithm", ["hash", "merge"])
@pytest.mark.parametrize("kind", [k for k in JOINS])
def test_physical_join_gives_the_same(left, right, kind, algorithm):
    assert bag(join(left, right, ON, kind, algorithm=algorithm)) == sorted(JOINS[kind][1], key=repr)


@pytest.mark.parametrize("on", [ON, lambda a, b: a["a0"] == b["b0"]], ids=["keys", "condition"])
def test_single_join_refuses_two_partners(spark, left, on):
    twice = table(spark, "b0 long not null, b1 long", (2, 20), (2, 21))
    with pytest.raises(Exception, match="more than one partner"):
        join(left, twice, on, "left_single").collect()
    with pytest.raises(Exception, match="more than one partner"):
        rows.emit(join(left, twice, on, "left_single"), [0, 2]).collect()


@pytest.mark.parametrize("on", [[("a1", "b1")], lambda a, b: a["a1"] == b["b1"]], ids=["keys", "condition"])
def test_mark_is_three_valued(spark, on):
    a = table(spark, "a0 long not null, a1 long", (1, None), (2, 2), (3, 3))
    known = table(spark, "b1 long", (2,), (5,))
    unknown = table(spark, "b1 long", (2,), (None,))
    none = known.where("b1 > 9")
    marks = lambda b: {r["a0"]: r["mark"] for r in join(a, b, on, "left_mark").collect()}
    assert marks(known) == {1: None, 2: True, 3: False}
    assert marks(unknown) == {1: None, 2: True, 3: None}
    assert marks(none) == {1: False, 2: False, 3: False}


def test_post_filter_and_residual(left, right):
    assert bag(join(left, right, ON, residual=lambda a, b: b["b1"] > 20)) == []
    assert bag(join(left, right, ON, "left", post_filter=lambda d: d["b1"].isNull())) == [(1, None, None, None)]


def test_nested_loop_with_a_true_condition(left, right):
    true = lambda a, b: F.lit(True)
    assert bag(join(left, right, true, "left_anti")) == []
    assert len(bag(join(left, right, true))) == 4


def test_self_join_and_unknown_columns(left):
    assert bag(join(left, left, [("a0", "a1")])) == [(2, 2, 2, 2)]
    with pytest.raises(Invalid):
        join(left, left, [("nope", "a0")])
    with pytest.raises(Invalid):
        join(left, left, [("a0", "a0")], "sideways")


def test_cross_keeps_nullability(spark):
    l, r = table(spark, "l0 long not null, l1 long", (1, None)), table(spark, "r0 long, r1 long not null", (7, 8), (9, 10))
    out = cross(l, r)
    assert schema_of(out) == ["i64", "i64?", "i64?", "i64"]
    assert bag(out) == [(1, None, 7, 8), (1, None, 9, 10)]


@pytest.mark.parametrize("kind", ["inner", "left", "left_semi", "left_anti", "left_single", "left_mark"])
def test_lateral(left, right, kind):
    out = lateral(left, lambda outer: right.where(F.col("b0") == outer("a0")), kind)
    want = {(*r[:2], r[2]) if kind == "left_mark" else tuple(r) for r in JOINS[kind][1]}
    assert set(bag(out)) == want
    assert schema_of(out) == JOINS[kind][0].split()


def test_lateral_condition_and_three_valued_mark(spark):
    a = table(spark, "a0 long not null, a1 long", (1, None), (2, 2), (3, 3))
    b = table(spark, "b1 long", (2,), (None,))
    none = b.where("b1 > 9")
    same = lambda p, q: p["a1"] == q["b1"]
    marks = lambda r: {x["a0"]: x["mark"] for x in lateral(a, lambda outer: r, "left_mark", condition=same).collect()}
    assert marks(b) == {x["a0"]: x["mark"] for x in join(a, b, [("a1", "b1")], "left_mark").collect()} == {1: None, 2: True, 3: None}
    assert marks(none) == {1: False, 2: False, 3: False}
    assert bag(lateral(a, lambda outer: b, condition=same)) == [(2, 2, 2)]
    assert bag(lateral(a, lambda outer: b, "left", condition=same, post_filter=lambda d: d["b1"].isNull())) == [(1, None, None), (3, 3, None)]
    assert bag(lateral(a, lambda outer: b, "left_semi", condition=same)) == [(2, 2)]
    assert bag(lateral(a, lambda outer: b, "left_anti", condition=same)) == [(1, None), (3, 3)]
    assert bag(lateral(a, lambda outer: b.where("b1 IS NOT NULL"), "left_single", condition=same)) == [(1, None, None), (2, 2, 2), (3, 3, None)]


def test_null_safe_keys(spark):
    a, b = table(spark, "x long, p long", (1, 1), (None, 2), (3, 3)), table(spark, "y long, q long", (1, 10), (None, 20), (4, 30))
    on = [("x", "y", "same")]
    assert bag(join(a, b, on)) == [(1, 1, 1, 10), (None, 2, None, 20)]
    assert bag(join(a, b, on, "left_single").select("p", "q")) == [(1, 10), (2, 20), (3, None)]
    assert bag(join(a, b, on, "left_mark").select("p", "mark")) == [(1, True), (2, True), (3, False)]
    assert bag(join(a, b, on, "right_anti").select("q")) == [(30,)]
    with pytest.raises(Invalid):
        join(a, b, [("x", "y", "like")])


def test_marks_of_several_keys_make_no_pairs(spark):
    t = table(spark, "x long, y long", (1, 2))
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    big = spark.range(10).select(F.col("id").alias("u"), F.nullif(F.col("id") % 3, F.lit(1)).alias("v"))
    plan = text(join(t, big, [("x", "u"), ("y", "v")], "left_mark"))
    # The one nested loop joins the one row that says which nulls the right side has.
    assert "CartesianProduct" not in plan and all("Aggregate" in x.split("BroadcastExchange")[1].split("\n")[1] for x in plan.split("BroadcastNestedLoopJoin")[1:])
    plan = text(join(t, big, [("x", "u"), ("y", "v")], "left_mark", residual=lambda a, b: a["x"] < b["v"]))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_outputs_with_two_columns_of_one_name_are_refused(spark, left, right):
    a, b = table(spark, "id long, id_r long", (1, 1)), table(spark, "id long", (1,))
    for kind in ("inner", "left", "left_single", "right_single"):
        with pytest.raises(Invalid):
            join(a, b, [("id", "id")], kind)
    with pytest.raises(Invalid):
        cross(a, b)
    marked = left.withColumnRenamed("a1", "mark")
    for f in (lambda: join(marked, right, ON, "left_mark"), lambda: lateral(marked, lambda outer: right, "left_mark"), lambda: window.window(left, window.spec(), a1=F.count("a0")), lambda: expand.expand(left, [], index="a0"),
              lambda: agg.aggregate(left, ["a0"], a0=F.sum("a1")), lambda: agg.aggregate(left, ["a0"], [["a0"], []], set_index=F.sum("a1")), lambda: subqueries.compare(marked, "a0", "<", "any", right.select("b0"))):
        with pytest.raises(Invalid):
            f()


NAMES = ["_set", "_s", "_k0", "_n", "_m0", "_l0", "_r0", "_id", "_there", "_hit", "_nulls", "_unknown", "_row", "_p0", "_f0", "_c0", "_about", "_aset", "_bset", "_1"]


def test_inner_names_do_not_clash(spark):
    """Every operator over an input with columns of all the names that some operator uses inside."""
    t = table(spark, "k long, " + ", ".join(f"`{n}` long" for n in NAMES), *[(k, *[v] * len(NAMES)) for k, v in ((1, 7), (2, 21), (None, 5))])
    u = table(spark, "q long, p long", (1, 1), (None, 2))
    v = F.col("_set")
    two = lambda df, *more: bag(df.select("k", "_set", *more))
    assert bag(agg.aggregate(t, ["_set"], [["_set"], []], s=F.sum("_s"), n=F.max("_k0"))) == sorted([(7, 7, 7, 0), (21, 21, 21, 0), (5, 5, 5, 0), (None, 33, 21, 1)], key=repr)
    assert two(join(t, u, [("k", "q")], "left_mark"), "mark") == sorted([(1, 7, True), (2, 21, None), (None, 5, None)], key=repr)
    assert two(join(t, u, [("k", "q"), ("_id", "p")], "left_mark"), "mark") == sorted([(1, 7, False), (2, 21, False), (None, 5, False)], key=repr)
    assert two(join(t, u, [("k", "q")], "left_mark", residual=lambda a, b: a["_n"] > b["p"]), "mark") == sorted([(1, 7, True), (2, 21, None), (None, 5, None)], key=repr)
    single = sorted([(1, 7, 1, 1), (2, 21, None, None), (None, 5, None, None)], key=repr)
    assert two(join(t, u, lambda a, b: a["k"] == b["q"], "left_single"), "q", "p") == two(join(t, u, [("k", "q")], "left_single"), "q", "p") == single
    assert two(lateral(t, lambda outer: u.where(F.col("q") == outer("k")), "left_single"), "q", "p") == single
    assert two(lateral(t, lambda outer: u, "left_mark", condition=lambda a, b: a["k"] == b["q"]), "mark") == sorted([(1, 7, True), (2, 21, None), (None, 5, None)], key=repr)
    assert len(two(expand.expand(t, [F.col("k"), [v, F.col("k")]]))) == 6
    assert two(subqueries.compare(t, "_c0", ">", "all", u.select("q")), "mark") == sorted([(1, 7, None), (2, 21, None), (None, 5, None)], key=repr)


@pytest.mark.parametrize("quantifier", ["any", "all"])
@pytest.mark.parametrize("comparison", subqueries.COMPARISONS)
def test_comparison_with_a_list(spark, comparison, quantifier):
    import operator

    does = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq, "<>": operator.ne}[comparison]
    t = table(spark, "x long", (1,), (2,), (3,), (None,))
    for members in ([], [2], [2, 2], [1, 3], [2, None], [None], [1, 2, 3, None]):
        got = {r["x"]: r["mark"] for r in subqueries.compare(t, "x", comparison, quantifier, table(spark, "m long", *[(m,) for m in members])).collect()}
        for x in (1, 2, 3, None):
            truths = [None if x is None or m is None else does(x, m) for m in members]
            first, last = (True, False) if quantifier == "any" else (False, True)
            assert got[x] is (first if first in truths else None if None in truths else last), (members, x)
    with pytest.raises(Invalid):
        subqueries.compare(t, "x", "~", "any", t)
    with pytest.raises(Invalid):
        subqueries.compare(t, "x", "<", "some", t)


def test_emit(left):
    assert rows.emit(left).columns == ["a0", "a1"]
    assert bag(rows.emit(left, [1, 0])) == [(2, 2), (None, 1)]
    assert rows.emit(left, [0, 0]).columns == ["a0", "a0_1"]
    with pytest.raises(Invalid):
        rows.emit(left, [2])


def test_project_appends(left):
    out = rows.project(left, s=F.col("a0") + F.col("a1"), t=F.col("a0") + 1, n=F.col("a1").isNull())
    assert schema_of(out) == ["i64", "i64?", "i64?", "i64", "bool"]
    with pytest.raises(Invalid):
        rows.project(left, a0=F.lit(1))


def test_masks(spark):
    t = table(spark, "a long not null, s struct<x: long, y: string, z: boolean>", (1, (2, "p", True)), (2, None))
    out = rows.mask(t, ["a", ("s", ["x", "z"])])
    assert out.schema["s"].dataType.names == ["x", "z"]
    assert bag(out) == [(1, (2, True)), (2, None)]
    assert rows.mask(t, ["s"]).columns == ["s"]
    assert set(bag(rows.mask(t, [("s", ["z", "x"]), "a"], reorder=True))) == {((True, 2), 1), (None, 2)}
    for wrong in (["s", "a"], [("s", ["z", "x"])], ["b"]):
        with pytest.raises(Invalid):
            rows.mask(t, wrong)


def test_names_depth_first(spark):
    schema = T.StructType([
        T.StructField("a", T.StructType([T.StructField("b", T.LongType(), False), T.StructField("c", T.LongType())]), False),
        T.StructField("d", T.LongType(), False),
    ])
    out = rows.rename(spark.createDataFrame([((1, 2), 3)], schema), ["p", "q", "r", "s"])
    assert out.columns == ["p", "s"] and out.schema["p"].dataType.names == ["q", "r"]
    assert schema_of(out) == ["struct(i64, i64?)", "i64"]
    for wrong in (["p"], list("pqrst")):
        with pytest.raises(Invalid):
            rows.rename(out, wrong)


def test_read_checks(spark, left):
    want = T.StructType([T.StructField("a0", T.LongType(), False), T.StructField("a1", T.LongType())])
    tables.check_schema(left, want)
    with pytest.raises(Invalid):
        tables.check_schema(left, T.StructType([T.StructField("a0", T.LongType(), False), T.StructField("a1", T.LongType(), False)]))
    with pytest.raises(Invalid):
        tables.read_files(spark, "/tmp/none", "csv")
    assert bag(tables.expression_rows(spark, [{"n": F.lit(1) + 1}, {"n": F.lit(5)}])) == [(2,), (5,)]


def test_write(spark, left):
    spark.sql("DROP TABLE IF EXISTS plankton_w")
    assert bag(tables.write(left, "plankton_w", create=True)) == []
    out = tables.write(left, "plankton_w", output="modified_records")
    assert schema_of(out) == ["i64", "i64?"] and bag(out) == [(1, None), (2, 2)]
    assert spark.table("plankton_w").count() == 4
    spark.sql("DROP TABLE plankton_w")
    assert schema_of(tables.create_table(spark, "plankton_w", left.schema)) == [] and bag(tables.read_named(spark, "plankton_w")) == []
    tables.write(spark.range(5).select(F.col("id").alias("a0"), F.lit(None).cast("long").alias("a1")), "plankton_w")
    # An input that reads the table it goes to: three rows are written, and these three are returned.
    out = tables.write(spark.table("plankton_w").where("a0 < 3"), "plankton_w", output="modified_records")
    assert bag(out) == [(0, None), (1, None), (2, None)] and spark.table("plankton_w").count() == 8
    spark.sql("DROP TABLE plankton_w")
    assert schema_of(tables.create_view(left, "plankton_v")) == []
    assert bag(tables.read_named(spark, "plankton_v")) == [(1, None), (2, 2)]
    assert bag(tables.update(left, F.col("a1").isNull(), a0=F.lit(9))) == [(2, 2), (9, None)]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_files(spark, left, tmp_path, fmt):
    left.write.format(fmt).save(f"{tmp_path}/t")
    assert bag(tables.read_files(spark, f"{tmp_path}/t", fmt, left.schema)) == [(1, None), (2, 2)]


def test_grouping_sets(spark):
    t = table(spark, "g0 long not null, g1 string not null, v long not null", (1, "a", 10), (1, "b", 20))
    out = agg.aggregate(t, ["g0", "g1"], [["g0", "g1"], ["g0"]], s=F.sum("v"))
    assert schema_of(out) == ["i64", "str?", "i64?", "i32"]
    assert bag(out) == [(1, "a", 10, 0), (1, "b", 20, 0), (1, None, 30, 1)]
    assert schema_of(agg.aggregate(t, ["g0", "g1"], s=F.sum("v"), n=F.count("v"))) == ["i64", "str", "i64?", "i64"]
    assert bag(agg.aggregate(t, ["g1"], [["g1"], ["g1"]], n=F.count(F.lit(1)))) == [("a", 1, 0), ("a", 1, 1), ("b", 1, 0), ("b", 1, 1)]
    assert bag(agg.aggregate(t, ["g0"])) == [(1,)]
    with pytest.raises(Invalid):
        agg.aggregate(t)
    with pytest.raises(Invalid):
        agg.aggregate(t, ["g0"], [["g1"]])


def test_integer_average_and_phases(spark):
    t = table(spark, "k long not null, v long", (1, -3), (1, -4), (1, None), (2, 7), (2, 8), (3, None))
    want = [(1, -3), (2, 7), (3, None)]
    out = agg.aggregate(t, ["k"], m=aggregates.average(F.col("v")))
    assert schema_of(out) == ["i64", "i64?"] and bag(out) == want
    part = agg.aggregate(t.withColumn("half", F.col("v") % 2), ["k", "half"], m=aggregates.intermediate("avg", F.col("v")))
    assert schema_of(part)[2].startswith("struct(i64")
    assert bag(agg.aggregate(part, ["k"], m=aggregates.merge("avg", F.col("m")))) == want
    with pytest.raises(ValueError):
        aggregates.intermediate("median", F.col("v"))


SETS = {  # fixed values: the rows of each operation over the three inputs before it
    "minus_primary": ([1, 2, 2, 3, 3, 3, 4], [1, 2], [3], [4]),
    "minus_primary_all": ([1, 2, 2, 3, 3, 3, 3], [1, 2, 3, 4], [3], [2, 3, 3]),
    "minus_multiset": ([1, 2, 3, 4], [1, 2], [1, 2, 3], [3, 4]),
    "intersection_primary": ([1, 2, 2, 3, 3, 3, 4], [1, 2, 3, 5], [2, 3, 6], [1, 2, 3]),
    "intersection_multiset": ([1, 2, 3, 4], [2, 3], [3, 4], [3]),
    "intersection_multiset_all": ([1, 2, 2, 3, 3, 3, 4], [1, 2, 3, 3, 5], [2, 3, 3, 6], [2, 3, 3]),
    "union_distinct": ([1, 2, 2, 3, 3, 3, 4], [2, 3, 5], [1, 6], [1, 2, 3, 4, 5, 6]),
    "union_all": ([1, 2, 2, 3, 3, 3, 4], [2, 3, 5], [1, 6], [1, 1, 2, 2, 2, 3, 3, 3, 3, 4, 5, 6]),
}
NULLS = {"minus": "RRRRNNNN", "intersection_primary": "RRRRRNNN", "intersection_multiset": "RRRRRRRN", "union": "RNNNNNNN"}


@pytest.mark.parametrize("name", SETS)
def test_set_operation(spark, name):
    *inputs, want = SETS[name]
    op = getattr(setops, name)
    assert bag(op(*[table(spark, "x long not null", *[(v,) for v in i]) for i in inputs])) == [(v,) for v in want]
    frames = [table(spark, ", ".join(f"c{i} long" + " not null" * (n == "R") for i, n in enumerate(p))) for p in ("RRRRNNNN", "RRNNRRNN", "RNRNRNRN")]
    pattern = "".join("N" if f.nullable else "R" for f in op(*frames).schema)
    assert pattern == next(v for k, v in NULLS.items() if name.startswith(k))


def test_set_operations_refuse_other_shapes(spark):
    two, three, other = table(spark, "a long, b long"), table(spark, "a long, b long, c long"), table(spark, "a long, b string")
    for inputs in ((two,), (two, three), (two, other)):
        with pytest.raises(Invalid):
            setops.union_all(*inputs)


def test_windows(spark):
    t = table(spark, "id long not null", *[(i,) for i in range(1, 5)])
    by = [F.asc("id")]
    out = window.window(t, window.spec(order=by), rn=window.row_number(), share=F.cume_dist(), following=F.lead("id"))
    assert schema_of(out) == ["i64", "i64?", "fp64?", "i64?"]
    out = window.window(t, window.spec(order=by, rows=(-1, 0)), s=F.sum("id"))
    assert bag(out) == [(1, 1), (2, 3), (3, 5), (4, 7)]
    gaps = t.where("id <> 2")
    assert bag(window.window(gaps, window.spec(order=by, values=(-1, 0)), s=F.sum("id"))) == [(1, 1), (3, 3), (4, 7)]
    with pytest.raises(Invalid):
        window.spec(rows=(0, 1), values=(0, 1))
    with pytest.raises(Exception, match="(?i)window"):
        window.window(t, window.spec(order=by), s=F.abs("id")).collect()


def test_order(spark):
    t = table(spark, "k long, v string not null", (3, "c"), (None, "n"), (1, "a"), (2, "b"))
    letters = lambda d, **k: "".join(r["v"] for r in order.fetch(order.sort(t, [("k", d)]), **k).collect())
    assert [letters(d) for d in order.DIRECTIONS] == ["nabc", "abcn", "ncba", "cban"]
    assert letters("asc_nulls_last", offset=1) == "bcn"
    assert letters("asc_nulls_last", offset=1, count=2) == "bc"
    assert letters("asc_nulls_last", count=0) == ""
    assert [r["v"] for r in rows.emit(order.sort(t, [("k", "asc_nulls_last")]), [1]).collect()] == list("abcn")
    with pytest.raises(Invalid):
        order.fetch(t, count=-1)


def test_expand(spark):
    t = table(spark, "c0 long not null, c1 long, c2 string not null", (1, None, "x"))
    out = expand.expand(t, [F.col("c0"), [F.col("c0"), F.col("c1")]])
    assert schema_of(out) == ["i64", "i64?", "str", "i32"]
    assert bag(out) == [(1, 1, "x", 0), (1, None, "x", 1)]
    assert schema_of(expand.expand(t, [F.col("c0"), [F.col("c0"), F.col("c0") + 1]]))[1] == "i64"
    with pytest.raises(Invalid):
        expand.expand(t, [[F.col("c0")], [F.col("c0"), F.col("c1")]])


def test_a_broadcast_has_a_bound(spark, left, monkeypatch):
    some = spark.range(3).select(F.col("id").alias("b0"))
    out = join(left, expand.exchange(some, "broadcast"), ON)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString() and bag(out) == [(1, None, 1), (2, 2, 2)]
    assert bag(expand.exchange(some, "broadcast")) == bag(some)
    monkeypatch.setattr(expand, "BROADCAST_BYTES", 10)
    for refused in (some, left):
        with pytest.raises(Invalid):
            expand.exchange(refused, "broadcast")


@pytest.mark.parametrize("kind", ["round_robin", "scatter", "range", "single"])
def test_exchange_keeps_rows(left, kind):
    out = expand.exchange(left, kind, partitions=3, keys=["a0"])
    assert bag(out) == [(1, None), (2, 2)] and schema_of(out) == ["i64", "i64?"]
    with pytest.raises(Invalid):
        expand.exchange(left, "sideways")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from plankton.sources import scratch

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(Session)
    assert scratch.shared_dir(spark)


def test_nullability_helpers(spark, left):
    assert schema_of(left.select(widen(F.col("a0")), narrow(F.col("a1"), 0))) == ["i64?", "i64"]
    nested = left.select(F.struct("a0").alias("s"))
    assert schema_of(nested) == ["struct(i64)"] and schema_of(widen_all(nested)) == ["struct(i64)?"]


def test_notation(spark):
    t = table(spark, "a decimal(10,2) not null, b date, c timestamp_ntz, d array<int>, e map<string, double>, f binary")
    spark.sql("DROP TABLE IF EXISTS plankton_n")
    spark.sql("CREATE TABLE plankton_n (a VARCHAR(4), b CHAR(3)) USING parquet")
    assert schema_of(spark.table("plankton_n")) == ["vchar(4)?", "fchar(3)?"]
    spark.sql("DROP TABLE plankton_n")
    assert schema_of(t) == ["dec(10,2)", "date?", "precision_timestamp(6)?", "list(i32?)?", "map(str, fp64?)?", "vbin?"]


def test_decimal_types(spark):
    cases = [((10, 2), (5, 1)), ((38, 10), (38, 10)), ((3, 3), (7, 0)), ((20, 18), (19, 3))]
    for a, b in cases:
        t = spark.range(1).select(F.lit(1).cast(f"decimal({a[0]},{min(a[1], a[0] - 1)})").alias("p"), F.lit(1).cast("decimal(1,0)").alias("q"))
        for op in ("add", "subtract", "multiply", "divide", "modulus"):
            assert t.select(decimals.arithmetic(op, F.col("p"), F.col("q"), a, b)).schema[0].dataType == T.DecimalType(*decimals.result_type(op, a, b))
    assert decimals.result_type("divide", (10, 2), (5, 1)) == (21, 8)
    assert decimals.result_type("divide", (10, 2), (5, 1), by="scale") == (17, 8)
    assert decimals.result_type("multiply", (10, 2), (5, 1)) == (16, 3)
    assert decimals.result_type("multiply", (38, 10), (38, 10)) == (38, 6)
    assert decimals.result_type("modulus", (10, 2), (5, 1)) == (6, 2)


def test_decimal_types_are_those_of_spark(spark):
    for p1, s1, p2, s2 in [(10, 2, 5, 1), (38, 10, 38, 10), (38, 38, 5, 0), (20, 4, 30, 25)]:
        t = table(spark, f"x decimal({p1},{s1}) not null, y decimal({p2},{s2}) not null")
        for op, c in (("add", F.col("x") + F.col("y")), ("subtract", F.col("x") - F.col("y")), ("multiply", F.col("x") * F.col("y")), ("modulus", F.col("x") % F.col("y"))):
            assert t.select(c).schema[0].dataType == T.DecimalType(*decimals.result_type(op, (p1, s1), (p2, s2)))
        assert t.select(F.col("x") / F.col("y")).schema[0].dataType == T.DecimalType(*decimals.result_type("divide", (p1, s1), (p2, s2), by="scale"))


def exact_quotient(x: Decimal, y: Decimal, s: int) -> Decimal:
    """The quotient in plain Python, rounded half away from zero at scale s."""
    n = abs(x) * 10 ** (s + 1) // abs(y)
    n = (n + 5) // 10
    sign = -1 if (x < 0) != (y < 0) else 1
    return Decimal(sign * int(n)).scaleb(-s)


CLAMPED = [((20, 6), (15, 2)), ((38, 10), (38, 10)), ((30, 5), (20, 20)), ((38, 38), (5, 0)), ((20, 4), (30, 25)), ((12, 2), (38, 0)), ((25, 25), (20, 3))]


@pytest.mark.parametrize("a,b", CLAMPED)
def test_clamped_quotients_are_rounded_once(spark, a, b):
    """Random operands, half of them within one unit of a tie."""
    rng = random.Random(str((a, b)))
    p, s = decimals.result_type("divide", a, b)
    pairs = []
    while len(pairs) < 60:
        x, y = (rng.choice([1, -1]) * Decimal(rng.randrange(1, 10 ** rng.randrange(1, t[0] + 1))).scaleb(-t[1]) for t in (a, b))
        if rng.random() < 0.5:
            tie = int(Fraction(2 * rng.randrange(10**6) + 1, 2) * Fraction(abs(y)) / 10**s * 10 ** a[1]) + rng.choice([-1, 0, 1])
            x = Decimal(tie).scaleb(-a[1])
        if abs(Fraction(x)) < 10 ** (a[0] - a[1]) and abs(Fraction(x) / Fraction(y)) < 10 ** (p - s) - 1:
            pairs.append((x, y))
    t = spark.createDataFrame(pairs, f"x decimal({a[0]},{a[1]}) not null, y decimal({b[0]},{b[1]}) not null")
    out = t.select("x", "y", decimals.arithmetic("divide", F.col("x"), F.col("y"), a, b).alias("q"))
    assert not out.schema["q"].nullable and out.schema["q"].dataType == T.DecimalType(p, s)
    for r in out.collect():
        whole = floor(abs(Fraction(r["x"]) / Fraction(r["y"])) * 10**s + Fraction(1, 2))
        assert Fraction(r["q"]) == Fraction(whole, 10**s) * (-1 if (r["x"] < 0) != (r["y"] < 0) else 1)


def test_quotients_of_null_and_zero(spark):
    for a, b in (((10, 2), (5, 1)), ((20, 6), (15, 2)), ((38, 10), (38, 10))):
        t = table(spark, f"x decimal({a[0]},{a[1]}), y decimal({b[0]},{b[1]}) not null", (None, Decimal(1)), (Decimal(1), Decimal(2)))
        q = decimals.arithmetic("divide", F.col("x"), F.col("y"), a, b)
        assert [r[0] for r in t.select(q).collect()] == [None, Decimal("0.5")] and t.select(q).schema[0].nullable
        with pytest.raises(Exception, match="(?i)zero"):
            t.select(decimals.arithmetic("divide", F.col("x"), F.col("y") - F.col("y"), a, b)).collect()


def test_the_quotient_that_was_rounded_twice(spark):
    t = table(spark, "x decimal(20,6) not null, y decimal(15,2) not null", (Decimal("999994999.999999"), Decimal("9999999999999.99")))
    assert t.select(decimals.arithmetic("divide", F.col("x"), F.col("y"), (20, 6), (15, 2))).first()[0] == Decimal("0.000099999")
    assert schema_of(t.select(decimals.arithmetic("modulus", F.col("x"), F.col("y"), (20, 6), (15, 2)))) == ["dec(19,6)"]


def test_decimal_quotient(spark):
    pairs = [(Decimal("1.00"), Decimal("3.0")), (Decimal("-2.00"), Decimal("7.0")), (Decimal("12345678.90"), Decimal("-9999.9"))]
    t = spark.createDataFrame(pairs, "x decimal(10,2), y decimal(5,1)")
    got = [r[0] for r in t.select(decimals.arithmetic("divide", F.col("x"), F.col("y"), (10, 2), (5, 1))).collect()]
    assert got == [exact_quotient(x, y, 8) for x, y in pairs]


def test_overlapping_grouping_sets(spark):
    t = table(spark, "g0 long not null, g1 string not null, v long not null", (1, "a", 10), (1, "b", 20))
    out = agg.aggregate(t, ["g0", "g1"], [["g0"], ["g0", "g1"]], total=F.sum("v"))
    assert schema_of(out) == ["i64", "str?", "i64?", "i32"]
    assert set(bag(out)) == {(1, None, 30, 0), (1, "a", 10, 1), (1, "b", 20, 1)}


def test_shared_input_and_deep_names(spark):
    t = table(spark, "a long not null, b string", (1, "x"), (2, None))
    assert len(bag(setops.union_all(t, t))) == 4
    nested = t.select(F.struct(F.struct("a").alias("in"), "b").alias("s"))
    assert schema_of(rows.rename(nested, list("wxyz"))) == ["struct(struct(i64), str?)"]


def test_temporal_values_keep_their_precision(spark):
    t = table(spark, "d date not null, missing date").unionByName(spark.sql("SELECT DATE'2024-03-01' AS d, CAST(NULL AS DATE) AS missing"))
    assert schema_of(t) == ["date", "date?"]
    ts = "2024-03-01 12:00:00.123456"
    x = spark.sql(f"SELECT TIMESTAMP_NTZ'{ts}' AS s, TIMESTAMP_NTZ'{ts}' AS ms, TIMESTAMP_NTZ'{ts}' AS us")
    out = logical.declare(x, s="precision_timestamp(0)", ms="precision_timestamp(3)", us="precision_timestamp(6)")
    assert schema_of(out) == ["precision_timestamp(0)", "precision_timestamp(3)", "precision_timestamp(6)"]
    assert [v.microsecond for v in out.first()] == [0, 123000, 123456]
    with pytest.raises(ValueError, match="lost silently"):
        logical.declare(x, s="precision_timestamp(9)")


def test_declared_types_travel_and_are_kept(spark):
    t = table(spark, "k long not null, u string, b binary not null, c string not null, v string", (1, "123E4567-E89B-12D3-A456-426614174000", b"\x01\x02", "de", "abc"), (2, None, b"\x03\x04", "f", None))
    out = logical.declare(t, u="uuid", b="fbin(2)", c="fchar(5)", v="vchar(10)")
    want = ["i64", "uuid?", "fbin(2)", "fchar(5)", "vchar(10)?"]
    assert schema_of(out) == want
    assert [r["c"] for r in out.orderBy("k").collect()] == ["de   ", "f    "] and out.where("k = 1").first()["u"].startswith("123e")
    joined = join(out, out.select("k"), [("k", "k")], "left_semi")
    assert schema_of(joined) == want and schema_of(rows.emit(out, [3, 1])) == ["fchar(5)", "uuid?"]
    for wrong in ({"b": "fbin(3)"}, {"v": "vchar(2)"}, {"v": "uuid"}):
        with pytest.raises(Exception, match="does not fit"):
            logical.declare(t, **wrong).collect()
    for wrong in ("uuid(3)", "fbin", "other"):
        with pytest.raises(ValueError):
            logical.declare(t, v=wrong)
