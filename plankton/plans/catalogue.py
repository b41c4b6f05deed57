"""Registered queries over the test tables, each with an equivalent SQL text."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates, decimals
from ..functions.nulls import narrow, widen
from ..operators import aggregate as agg
from ..operators import expand, order, rows, setops, subqueries, window
from ..operators.joins import cross, join, lateral
from ..sources import tables
from ..sources.scratch import Scratch
from ..streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader under its own name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def dec(c: str, p: int = 12, s: int = 2):
    return F.col(c).cast(f"decimal({p},{s})")


# Scans, projection, filter -------------------------------------------------


@query("""SELECT l_partkey, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS qty, count(*) AS n
  FROM lineitem WHERE l_discount > 0.05 GROUP BY l_partkey ORDER BY qty DESC, l_partkey LIMIT 20""")
def flagship_topn(t):
    x = rows.read_filtered(t("lineitem"), condition=lambda d: d["l_discount"] > 0.05, fields=["l_partkey", "l_quantity"])
    x = agg.aggregate(x, ["l_partkey"], qty=F.sum(dec("l_quantity")), n=F.count(F.lit(1)))
    return order.topn(x, [("qty", "desc_nulls_last"), ("l_partkey", "asc_nulls_last")], 20)


@query("SELECT n_name, n_nationkey FROM nation")
def emit_reorder_drop(t):
    return rows.emit(t("nation"), [1, 0])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def read_filter_and_mask(t):
    return rows.read_filtered(t("orders"), condition=lambda d: d["o_orderpriority"] == "1-URGENT", fields=["o_orderkey", "o_totalprice"])


@query("SELECT c_custkey, c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def read_nested_mask(t):
    x = t("customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("s"))
    return rows.mask(x, ["c_custkey", ("s", ["nation", "segment"])]).select("c_custkey", "s.*")


@query("SELECT *, s_acctbal * 2 AS twice, s_acctbal IS NULL AS missing FROM supplier")
def project_appends(t):
    return rows.project(t("supplier"), twice=F.col("s_acctbal") * 2, missing=F.col("s_acctbal").isNull())


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 40 AND p_retailprice IS NOT NULL")
def filter_rows(t):
    return rows.keep(t("part").select("p_partkey", "p_size", "p_retailprice"), (F.col("p_size") > 40) & F.col("p_retailprice").isNotNull()).drop("p_retailprice")


@query("SELECT 1 AS n, 'a' AS s UNION ALL SELECT 2, NULL")
def virtual_table(t):
    return tables.literal_rows(t("region").sparkSession, [(1, "a"), (2, None)], "n int not null, s string")


@query("SELECT n_nationkey AS id, n_regionkey AS region, n_name AS name FROM nation")
def names_depth_first(t):
    return rows.rename(t("nation").select("n_nationkey", F.struct("n_regionkey", "n_name")), ["id", "about", "region", "name"]).select("id", "about.*")


# Joins ---------------------------------------------------------------------

DOCUMENTS = "(SELECT doc_id, n_chars, CASE WHEN lang IS NOT NULL AND n_chars > 40 THEN doc_id END AS k FROM documents)"
LABELS = "(SELECT quality, CASE WHEN toxic = 0 THEN doc_id END AS label_k FROM labels)"


def docs(t):
    """Documents, of which some have no key and many no label."""
    return t("documents").select("doc_id", "n_chars", F.when(F.col("lang").isNotNull() & (F.col("n_chars") > 40), F.col("doc_id")).alias("k"))


def labels(t):
    """Labels, of which those of toxic documents have no key."""
    return t("labels").select("quality", F.when(F.col("toxic") == 0, F.col("doc_id")).alias("label_k"))


for kind, sql in {
    "inner": "SELECT d.*, l.* FROM {d} d JOIN {l} l ON k = label_k",
    "outer": "SELECT d.*, l.* FROM {d} d FULL JOIN {l} l ON k = label_k",
    "left": "SELECT d.*, l.* FROM {d} d LEFT JOIN {l} l ON k = label_k",
    "right": "SELECT d.*, l.* FROM {d} d RIGHT JOIN {l} l ON k = label_k",
    "left_semi": "SELECT d.* FROM {d} d WHERE EXISTS (SELECT 1 FROM {l} l WHERE k = label_k)",
    "left_anti": "SELECT d.* FROM {d} d WHERE NOT EXISTS (SELECT 1 FROM {l} l WHERE k = label_k)",
    "right_semi": "SELECT l.* FROM {l} l WHERE EXISTS (SELECT 1 FROM {d} d WHERE k = label_k)",
    "right_anti": "SELECT l.* FROM {l} l WHERE NOT EXISTS (SELECT 1 FROM {d} d WHERE k = label_k)",
    "left_single": "SELECT d.*, (SELECT quality FROM {l} l WHERE k = label_k) AS quality, (SELECT label_k FROM {l} l WHERE k = label_k) AS label_k FROM {d} d",
    "right_single": "SELECT d.*, l.* FROM {d} d RIGHT JOIN {l} l ON k = label_k",
    "left_mark": "SELECT d.*, k IN (SELECT label_k FROM {l}) AS mark FROM {d} d",
    "right_mark": "SELECT l.*, label_k IN (SELECT k FROM {d}) AS mark FROM {l} l",
}.items():

    def joined(t, kind=kind):
        return join(docs(t), labels(t), [("k", "label_k")], kind)

    joined.__name__ = f"join_{kind}"
    query(sql.format(d=DOCUMENTS, l=LABELS))(joined)


@query(f"SELECT doc_id, n_chars, k, quality, label_k FROM {DOCUMENTS} d JOIN (SELECT min(quality) AS quality, label_k FROM {LABELS} GROUP BY label_k) l ON k IS NOT DISTINCT FROM label_k")
def join_same_keys(t):
    """A key pair to which a null is like any value."""
    once = agg.aggregate(labels(t), ["label_k"], quality=F.min("quality")).select("quality", "label_k")
    return join(docs(t), once, [("k", "label_k", "same")])


MARKED = """SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM r WHERE {c}) THEN true WHEN EXISTS (SELECT 1 FROM r WHERE ({c}) IS NULL) THEN NULL ELSE false END AS mark
  FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_orderstatus END AS a, o_orderpriority AS b, o_orderdate AS since FROM orders),"""
SEGMENTS = "SELECT CASE WHEN o_totalprice < 460000 THEN o_orderstatus END AS x, o_orderpriority AS y, o_orderdate AS until FROM orders WHERE o_totalprice > 450000"


def marked_orders(t):
    left = t("orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")).alias("a"), F.col("o_orderpriority").alias("b"), F.col("o_orderdate").alias("since"))
    right = t("orders").where("o_totalprice > 450000").select(F.when(F.col("o_totalprice") < 460000, F.col("o_orderstatus")).alias("x"), F.col("o_orderpriority").alias("y"), F.col("o_orderdate").alias("until"))
    return left, right


@query(f"WITH r AS ({SEGMENTS}) " + MARKED.format(c="a = x AND b = y").rstrip(","))
def join_mark_two_keys(t):
    return join(*marked_orders(t), [("a", "x"), ("b", "y")], "left_mark").select("o_orderkey", "mark")


@query(f"WITH r AS ({SEGMENTS}) " + MARKED.format(c="a = x AND b = y AND since < until").rstrip(","))
def join_mark_residual(t):
    return join(*marked_orders(t), [("a", "x"), ("b", "y")], "left_mark", residual=("since", "<", "until")).select("o_orderkey", "mark")


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o_custkey = c_custkey AND p > low) THEN true WHEN EXISTS (SELECT 1 FROM o WHERE o_custkey = c_custkey AND (p > low) IS NULL) THEN NULL ELSE false END AS mark
  FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal * 40 END AS low FROM customer), (SELECT 1)""".replace("), (SELECT 1)", ")").replace("FROM o ", "FROM (SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS p FROM orders) o "))
def join_lateral_left_mark(t):
    c = t("customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 40).alias("low"))
    o = t("orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("p"))
    out = lateral(c, lambda outer: o.where(F.col("o_custkey") == outer("c_custkey")), "left_mark", condition=lambda a, b: b["p"] > a["low"])
    return out.select("c_custkey", "mark")


@query("SELECT c_custkey, p FROM customer LEFT JOIN LATERAL (SELECT o_totalprice AS p FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC LIMIT 1) x ON p > c_acctbal * 40 WHERE p IS NULL OR p > 200000")
def join_lateral_condition(t):
    o = t("orders").select("o_custkey", "o_totalprice")
    top = lambda outer: o.where(F.col("o_custkey") == outer("c_custkey")).orderBy(F.desc("o_totalprice")).limit(1).select(F.col("o_totalprice").alias("p"))
    out = lateral(t("customer").select("c_custkey", "c_acctbal"), top, "left", condition=lambda a, b: b["p"] > a["c_acctbal"] * 40, post_filter=lambda d: d["p"].isNull() | (d["p"] > 200000))
    return out.select("c_custkey", "p")


@query("SELECT s_suppkey, s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS mark FROM supplier")
def join_mark_general(t):
    x = join(t("supplier").select("s_suppkey", "s_nationkey"), t("nation").where("n_regionkey = 1"), lambda a, b: a["s_nationkey"] == b["n_nationkey"], "left_mark")
    return x.select("s_suppkey", "mark")


@query("SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey >= n_regionkey AND r_regionkey <= n_regionkey) AS r_name FROM nation")
def join_single_general(t):
    x = join(t("nation"), t("region"), lambda a, b: (b["r_regionkey"] >= a["n_regionkey"]) & (b["r_regionkey"] <= a["n_regionkey"]), "left_single")
    return x.select("n_nationkey", "r_name")


@query("SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation, region")
def join_cross(t):
    return cross(t("nation").select("n_nationkey", "n_name"), t("region"))


@query("SELECT a.n_nationkey, b.n_nationkey AS n_nationkey_r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t):
    n = t("nation").select("n_nationkey", "n_regionkey")
    return join(n, n, [("n_regionkey", "n_regionkey")], residual=lambda a, b: a["n_nationkey"] < b["n_nationkey"]).select("n_nationkey", "n_nationkey_r")


for algorithm in ("hash", "merge"):
    for kind, word in (("left_anti", "NOT EXISTS"), ("left_semi", "EXISTS")):

        def physical(t, algorithm=algorithm, kind=kind):
            return join(t("customer").select("c_custkey", "c_name"), t("orders").where("o_totalprice > 400000"), [("c_custkey", "o_custkey")], kind, algorithm=algorithm)

        physical.__name__ = f"join_{algorithm}_{kind}"
        query(f"SELECT c_custkey, c_name FROM customer WHERE {word} (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")(physical)


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey WHERE length(n_name) > length(r_name)")
def join_nested_loop_post_filter(t):
    return join(t("nation").select("n_name", "n_regionkey"), t("region"), lambda a, b: a["n_regionkey"] < b["r_regionkey"], post_filter=lambda d: F.length(d["n_name"]) > F.length(d["r_name"])).select("n_name", "r_name")


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) x""")
def join_lateral_top2(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    right = lambda outer: o.where(F.col("o_custkey") == outer("c_custkey")).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2).select("o_orderkey", "o_totalprice")
    return lateral(t("customer").select("c_custkey"), right)


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS n FROM customer")
def join_lateral_single(t):
    o = t("orders").select("o_custkey", "o_totalprice")
    right = lambda outer: o.where((F.col("o_custkey") == outer("c_custkey")) & (F.col("o_totalprice") > 300000)).select(F.count(F.lit(1)).alias("n"))
    return lateral(t("customer").select("c_custkey"), right, "left_single")


for kind, word in (("left_semi", "EXISTS"), ("left_anti", "NOT EXISTS")):

    def lateral_exists(t, kind=kind):
        o = t("orders").select("o_custkey", "o_totalprice")
        return lateral(t("customer").select("c_custkey"), lambda outer: o.where((F.col("o_custkey") == outer("c_custkey")) & (F.col("o_totalprice") > 400000)), kind)

    lateral_exists.__name__ = f"join_lateral_{kind}"
    query(f"SELECT c_custkey FROM customer WHERE {word} (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")(lateral_exists)


# Aggregation ---------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS sum_qty, count(*) AS n,
  count(*) FILTER (l_discount > 0.05) AS discounted, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL""")
def aggregate_single_set(t):
    big = F.count(agg.filtered(F.lit(1), F.col("l_discount") > 0.05))
    return agg.aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], sum_qty=F.sum(dec("l_quantity")), n=F.count(F.lit(1)), discounted=big, suppliers=F.count_distinct("l_suppkey"))


@query("SELECT CAST(min(p_size) AS INTEGER) AS low, CAST(max(p_size) AS INTEGER) AS high, count(*) AS n FROM part WHERE p_size < 0")
def aggregate_no_keys(t):
    return agg.aggregate(t("part").where("p_size < 0"), low=F.min("p_size"), high=F.max("p_size"), n=F.count(F.lit(1)))


@query("""SELECT p_brand, p_size, count(*) AS n, CAST(0 AS INTEGER) AS set_index FROM part GROUP BY p_brand, p_size UNION ALL
  SELECT p_brand, NULL, count(*), 1 FROM part GROUP BY p_brand UNION ALL SELECT p_brand, NULL, count(*), 2 FROM part GROUP BY p_brand""")
def aggregate_set_index(t):
    return agg.aggregate(t("part"), ["p_brand", "p_size"], [["p_brand", "p_size"], ["p_brand"], ["p_brand"]], n=F.count(F.lit(1)))


@query("""SELECT NULL AS o_orderstatus, o_orderpriority, count(*) AS n, CAST(0 AS INTEGER) AS set_index FROM orders GROUP BY o_orderpriority UNION ALL
  SELECT o_orderstatus, o_orderpriority, count(*), 1 FROM orders GROUP BY o_orderstatus, o_orderpriority UNION ALL SELECT o_orderstatus, NULL, count(*), 2 FROM orders GROUP BY o_orderstatus""")
def aggregate_overlapping_sets(t):
    keys = ["o_orderstatus", "o_orderpriority"]
    return agg.aggregate(t("orders"), keys, [keys[1:], keys, keys[:1]], n=F.count(F.lit(1)))


@query("""SELECT CAST(NULL AS VARCHAR) AS o_orderstatus, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS top, CAST(1 AS INTEGER) AS set_index""")
def aggregate_rollup_of_nothing(t):
    """A set without keys has its one row for an empty input too."""
    none = t("orders").where("o_totalprice < 0")
    return agg.aggregate(none, ["o_orderstatus"], agg.rollup_sets(["o_orderstatus"]), n=F.count(F.lit(1)), top=F.max("o_totalprice"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(CASE grouping_id(o_orderstatus, o_orderpriority) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS set_index
  FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def aggregate_rollup(t):
    keys = ["o_orderstatus", "o_orderpriority"]
    return agg.aggregate(t("orders"), keys, agg.rollup_sets(keys), n=F.count(F.lit(1)))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS INTEGER) AS set_index
  FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def aggregate_cube(t):
    keys = ["o_orderstatus", "o_orderpriority"]
    return agg.aggregate(t("orders"), keys, agg.cube_sets(keys), n=F.count(F.lit(1)))


@query("SELECT o_custkey, CAST(trunc(sum(o_orderkey)::HUGEINT // count(*)) AS BIGINT) AS mean FROM orders GROUP BY o_custkey")
def aggregate_integer_avg(t):
    return agg.aggregate(t("orders"), ["o_custkey"], mean=aggregates.average(F.col("o_orderkey")))


@query("SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) // count(*) AS mean, count(*) AS n FROM orders GROUP BY o_custkey")
def aggregate_phases(t):
    first = agg.aggregate(t("orders"), ["o_custkey", "o_orderstatus"], mean=aggregates.intermediate("avg", F.col("o_orderkey")), n=aggregates.intermediate("count", F.col("o_orderkey")))
    return agg.aggregate(first, ["o_custkey"], mean=aggregates.merge("avg", F.col("mean")), n=aggregates.merge("count", F.col("n")))


@query("""SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderpriority) AS TINYINT) AS folded, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def aggregate_grouping_function(t):
    return t("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderpriority").alias("folded"), F.count(F.lit(1)).alias("n"))


# Subqueries: truth values that are projected come from mark joins ----------


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def subquery_not_in(t):
    marked = join(t("customer").select("c_custkey"), t("orders").where("o_totalprice > 400000").select("o_custkey"), [("c_custkey", "o_custkey")], "left_mark")
    return rows.keep(marked, ~F.col("mark")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_totalprice > 2000 THEN o_custkey END FROM orders)")
def subquery_not_in_with_null(t):
    listed = t("orders").select(F.when(F.col("o_totalprice") > 2000, F.col("o_custkey")).alias("k"))
    return rows.keep(join(t("customer").select("c_custkey"), listed, [("c_custkey", "k")], "left_mark"), ~F.col("mark")).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def subquery_scalar(t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    return o.where(F.col("o_totalprice") > o.select((F.avg("o_totalprice") * 1.5).alias("m")).scalar()).select("o_orderkey")


LISTED = "(SELECT CASE WHEN p_retailprice > {p} THEN p_size END FROM part WHERE p_brand = 'Brand#11')"


def listed(t, price):
    return t("part").where("p_brand = 'Brand#11'").select(F.when(F.col("p_retailprice") > price, F.col("p_size")).alias("size"))


@query(f"SELECT p_partkey, p_size >= ALL {LISTED.format(p=0)} AS mark FROM part")
def subquery_comparison_all(t):
    return subqueries.compare(t("part").select("p_partkey", "p_size"), "p_size", ">=", "all", listed(t, 0)).select("p_partkey", "mark")


@query(f"SELECT p_partkey, p_size < ANY {LISTED.format(p=1200)} AS mark FROM part")
def subquery_comparison_any(t):
    return subqueries.compare(t("part").select("p_partkey", "p_size"), "p_size", "<", "any", listed(t, 1200)).select("p_partkey", "mark")


@query(f"SELECT p_partkey, p_size = ANY {LISTED.format(p=1200)} AS mark FROM part")
def subquery_comparison_equal_any(t):
    return subqueries.compare(t("part").select("p_partkey", "p_size"), "p_size", "=", "any", listed(t, 1200)).select("p_partkey", "mark")


# Set operations ------------------------------------------------------------

P, S1, S2 = (f"SELECT l_partkey AS k, CAST(l_quantity AS INTEGER) AS f FROM lineitem WHERE l_returnflag = '{flag}'" for flag in "ANR")

for name, sql in {
    "minus_primary": "SELECT DISTINCT * FROM (({p}) EXCEPT ({a}) EXCEPT ({b}))",
    "minus_primary_all": "({p}) EXCEPT ALL ({a}) EXCEPT ALL ({b})",
    "minus_multiset": "({p}) EXCEPT (({a}) INTERSECT ({b}))",
    "intersection_primary": "({p}) INTERSECT (({a}) UNION ALL ({b}))",
    "intersection_multiset": "({p}) INTERSECT ({a}) INTERSECT ({b})",
    "intersection_multiset_all": "({p}) INTERSECT ALL ({a}) INTERSECT ALL ({b})",
    "union_distinct": "({p}) UNION ({a}) UNION ({b})",
    "union_all": "({p}) UNION ALL ({a}) UNION ALL ({b})",
}.items():

    def set_op(t, name=name):
        x = t("lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").cast("int").alias("f"), "l_returnflag")
        return getattr(setops, name)(*[x.where(F.col("l_returnflag") == flag).drop("l_returnflag") for flag in "ANR"])

    set_op.__name__ = f"set_{name}"
    query(sql.format(p=P, a=S1, b=S2))(set_op)


# Windows -------------------------------------------------------------------


@query("""SELECT o_orderkey, row_number() OVER w AS rn, cume_dist() OVER w AS share, lead(o_orderkey) OVER w AS following, rank() OVER w AS place,
  CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS DECIMAL(22,2)) AS last_two
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def window_functions(t):
    o = t("orders").select("o_orderkey", "o_custkey", dec("o_totalprice").alias("price"))
    w = window.spec(["o_custkey"], order.order([("o_orderkey", "asc_nulls_last")]))
    out = window.window(o, w, rn=window.row_number(), share=F.cume_dist(), following=F.lead("o_orderkey"), place=window.rank())
    near = window.spec(["o_custkey"], order.order([("o_orderkey", "asc_nulls_last")]), rows=(-1, 0))
    return window.window(out, near, last_two=F.sum("price")).drop("o_custkey", "price")


@query("""SELECT p_partkey, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS part, lag(p_size) OVER v AS earlier, percent_rank() OVER w AS percent,
  first_value(p_size) OVER v AS first_size, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ahead
  FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size), v AS (PARTITION BY p_brand ORDER BY p_partkey)""")
def window_more_functions(t):
    p = t("part").select("p_partkey", "p_brand", "p_size")
    out = window.window(p, window.spec(["p_brand"], [F.asc("p_size")]), dense=window.dense_rank(), percent=F.percent_rank())
    out = window.window(out, window.spec(["p_brand"], [F.asc("p_partkey")]), part=window.ntile(4), earlier=F.lag("p_size"), first_size=F.first("p_size"))
    return window.window(out, window.spec(["p_brand"], [F.asc("p_partkey")], rows=(0, 2)), ahead=F.max("p_size")).drop("p_brand", "p_size")


@query("""SELECT o_orderkey, CAST(sum(o_shippriority) OVER (PARTITION BY o_orderstatus ORDER BY day RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS BIGINT) AS month
  FROM (SELECT o_orderkey, o_orderstatus, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day, o_custkey AS o_shippriority FROM orders)""")
def window_range_frame(t):
    """A frame by values: the thirty days up to the row's own."""
    o = t("orders").select("o_orderkey", "o_orderstatus", F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("day"), "o_custkey")
    return window.window(o, window.spec(["o_orderstatus"], [F.asc("day")], values=(-30, 0)), month=F.sum("o_custkey")).select("o_orderkey", "month")


# Order ---------------------------------------------------------------------

NULLED = "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS bal FROM customer"
for direction, sql in (("asc_nulls_first", "bal ASC NULLS FIRST"), ("asc_nulls_last", "bal ASC NULLS LAST"), ("desc_nulls_first", "bal DESC NULLS FIRST"), ("desc_nulls_last", "bal DESC NULLS LAST")):

    def fetched(t, direction=direction):
        x = t("customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("bal"))
        return order.fetch(order.sort(x, [("bal", direction), ("c_custkey", "asc_nulls_last")]), count=25, offset=20)

    fetched.__name__ = f"fetch_{direction}"
    query(f"SELECT * FROM ({NULLED}) ORDER BY {sql}, c_custkey LIMIT 25 OFFSET 20")(fetched)


@query("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def topn_emit(t):
    return rows.emit(order.topn(t("customer").select("c_custkey", "c_name", "c_acctbal"), [("c_acctbal", "desc_nulls_last"), ("c_custkey", "asc_nulls_last")], 10), [1])


@query("SELECT r_regionkey FROM (SELECT * FROM region ORDER BY r_regionkey OFFSET 2)")
def fetch_unset_count(t):
    return order.fetch(order.sort(t("region").select("r_regionkey"), [("r_regionkey", "asc_nulls_last")]), offset=2)


# Expand, exchange, shared subplans -----------------------------------------


@query("""SELECT n_nationkey, n_name, n_regionkey, CAST(0 AS INTEGER) AS duplicate FROM nation UNION ALL SELECT n_nationkey, NULL, n_regionkey, 1 FROM nation""")
def expand_switching(t):
    return expand.expand(t("nation"), [F.col("n_nationkey"), [F.col("n_name"), F.lit(None).cast("string")]])


@query("SELECT * FROM supplier")
def exchange_round_robin(t):
    return expand.exchange(t("supplier"), partitions=4)


@query("SELECT * FROM supplier")
def exchange_scatter(t):
    return expand.exchange(t("supplier"), "scatter", partitions=4, keys=["s_nationkey"])


@query("SELECT * FROM supplier")
def exchange_range(t):
    return expand.exchange(t("supplier"), "range", partitions=4, keys=["s_acctbal"])


@query("SELECT * FROM supplier")
def exchange_single(t):
    return expand.exchange(t("supplier"), "single")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def exchange_broadcast(t):
    return join(t("supplier"), expand.exchange(t("nation"), "broadcast"), [("s_nationkey", "n_nationkey")]).select("s_suppkey", "n_name")


@query("SELECT p_partkey, p_size FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, p_size FROM part WHERE p_size < 10")
def reference_shared_subtree(t):
    shared = t("part").where("p_size < 10").select("p_partkey", "p_size")
    return setops.union_all(shared, shared)


# Functions -----------------------------------------------------------------


@query("""SELECT o_orderkey, CAST(a + b AS DECIMAL(13,2)) AS added, CAST(a - b AS DECIMAL(13,2)) AS taken, CAST(a * b AS DECIMAL(18,3)) AS product,
  CAST(CAST(a AS DECIMAL(38,10)) - CAST(trunc(a / b) AS DECIMAL(18,0)) * b AS DECIMAL(6,2)) AS rest
  FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS a, CAST(o_orderkey % 900 + 1 AS DECIMAL(5,1)) AS b FROM orders)""")
def decimal_arithmetic(t):
    x = t("orders").select("o_orderkey", dec("o_totalprice").alias("a"), (F.col("o_orderkey") % 900 + 1).cast("decimal(5,1)").alias("b"))
    a, b = (12, 2), (5, 1)
    op = lambda name: decimals.arithmetic(name, F.col("a"), F.col("b"), a, b)
    return x.select("o_orderkey", op("add").alias("added"), op("subtract").alias("taken"), op("multiply").alias("product"), op("modulus").cast("decimal(6,2)").alias("rest"))


# A quotient is compared as a whole number of its last place, rounded half up by whole-number division.


@query("""SELECT o_orderkey, CAST((2 * a * 10000000 + b) // (2 * b) AS DECIMAL(38,0)) AS q FROM
  (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(10,2)) * 100 AS HUGEINT) AS a, CAST((o_orderkey % 900 + 1) * 10 AS HUGEINT) AS b FROM orders)""")
def decimal_divide(t):
    x = t("orders").select("o_orderkey", dec("o_totalprice", 10, 2).alias("a"), (F.col("o_orderkey") % 900 + 1).cast("decimal(5,1)").alias("b"))
    q = decimals.arithmetic("divide", F.col("a"), F.col("b"), (10, 2), (5, 1))
    return x.select("o_orderkey", (q * F.lit(100000000)).cast("decimal(38,0)").alias("q"))


@query("""SELECT o_orderkey, CAST((2 * a * 100000 + b) // (2 * b) AS DECIMAL(38,0)) AS q FROM
  (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(10,2)) * 100 AS HUGEINT) * 10000 + o_custkey AS a, CAST(o_orderkey AS HUGEINT) * 700000001 + 1 AS b FROM orders)""")
def decimal_divide_clamped(t):
    """decimal(15,6) by decimal(20,2): 56 digits clamped to (38,9), one rounding; the divisor holds order keys up to 1e11."""
    whole = F.col("o_orderkey").cast("decimal(13,0)")
    x = t("orders").select("o_orderkey", (dec("o_totalprice", 10, 2) + (F.col("o_custkey") * F.lit(Decimal("0.000001"))).cast("decimal(14,6)")).cast("decimal(15,6)").alias("a"), ((whole * 700000001 + 1) * F.lit(Decimal("0.01"))).cast("decimal(20,2)").alias("b"))
    q = decimals.arithmetic("divide", F.col("a"), F.col("b"), (15, 6), (20, 2))
    return x.select("o_orderkey", (q * F.lit(1000000000).cast("decimal(10,0)")).cast("decimal(38,0)").alias("q"))


@query("""SELECT l_returnflag, CAST(sum(d) AS DECIMAL(22,2)) AS total, CAST(CAST(sum(d) * 100 + 50 AS HUGEINT) // 100 AS BIGINT) AS whole, CAST((2 * CAST(sum(d) * 100 AS HUGEINT) * 10000 + count(*)) // (2 * count(*)) AS BIGINT) AS mean
  FROM (SELECT l_returnflag, CAST(l_extendedprice AS DECIMAL(12,2)) AS d FROM lineitem) GROUP BY l_returnflag""")
def aggregate_decimals(t):
    """Sum and average of decimals; the average as a whole number of its sixth place."""
    x = t("lineitem").select("l_returnflag", dec("l_extendedprice").alias("d"))
    out = agg.aggregate(x, ["l_returnflag"], total=F.sum("d"), mean=F.avg("d"))
    return out.select("l_returnflag", "total", F.round("total", 0).cast("long").alias("whole"), (F.col("mean") * 1000000).cast("long").alias("mean"))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber + CAST(l_quantity AS INTEGER) AS added, l_orderkey + l_partkey AS keys, CASE WHEN l_orderkey < 1000000000 THEN NULL ELSE 0 END AS overflow,
  TRY_CAST(l_returnflag AS INTEGER) AS tried, l_returnflag IN ('A', 'R') AS listed, concat(l_returnflag, '-', l_linestatus) AS both, extract(year FROM l_shipdate) AS year FROM lineitem""")
def scalar_functions(t):
    """Sums of whole numbers; what overflows is null where a query asks for that and an error otherwise."""
    x = t("lineitem")
    huge = F.try_add(F.col("l_orderkey").cast("int") + 1, F.lit(2147483647))
    return x.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("added"), (F.col("l_orderkey") + F.col("l_partkey")).alias("keys"), huge.alias("overflow"), F.col("l_returnflag").try_cast("int").alias("tried"),
                    F.col("l_returnflag").isin("A", "R").alias("listed"), F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("both"), F.year("l_shipdate").cast("long").alias("year"))


@query("""SELECT s_suppkey, s_name AS text, CAST(length(s_name) AS INTEGER) AS size, s_nationkey * 2 AS second, s_acctbal AS bal FROM supplier WHERE s_acctbal > 100""")
def nested_constructors(t):
    """A struct, a list, a map and a lambda over a list; the bound of the filter is a parameter."""
    x = t("supplier").where(F.expr("s_acctbal > 100"))
    x = x.select("s_suppkey", F.struct(F.col("s_name").alias("text"), F.length("s_name").alias("size")).alias("s"), F.transform(F.array("s_nationkey", "s_nationkey"), lambda n: n * 2).alias("l"), F.create_map(F.lit("bal"), "s_acctbal").alias("m"))
    return x.select("s_suppkey", "s.text", "s.size", F.element_at("l", 2).alias("second"), F.element_at("m", F.lit("bal")).alias("bal"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 40 AND p_brand = 'Brand#11'")
def dynamic_parameters(t):
    p = t("part")
    return p.sparkSession.sql("SELECT p_partkey, p_size FROM {p} WHERE p_size > :least AND p_brand = :brand", args={"least": 40, "brand": "Brand#11"}, p=p)


@query("SELECT true AS same_day, true AS zoned FROM region")
def current_values(t):
    """Date, timestamp and zone of the query: required, and one for all rows."""
    return t("region").select((F.to_date(F.current_timestamp()) == F.current_date()).alias("same_day"), (F.length(F.current_timezone()) > 0).alias("zoned"))


@query("""SELECT c_custkey, coalesce(k, -1) AS required, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, TRY_CAST(c_mktsegment AS INTEGER) AS tried,
  CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS switched FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS k, c_mktsegment FROM customer)""")
def expressions(t):
    x = t("customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("k"), "c_mktsegment")
    return x.select("c_custkey", narrow(F.col("k"), -1).alias("required"), F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("parity"), F.col("c_mktsegment").try_cast("int").alias("tried"),
                    widen(F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(0)).alias("switched"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_rows(t):
    return tables.update(t("supplier").select("s_suppkey", "s_acctbal"), F.col("s_acctbal") < 0, s_acctbal=F.lit(0))


# Sources and sinks: what is written is read again from the stored table ----


def own_table(spark: SparkSession, kind: str) -> str:
    """A table name that no other run uses."""
    return f"plankton_{kind}_{uuid.uuid4().hex}"


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def named_table(t):
    s = t("supplier").select("s_suppkey", "s_name", "s_acctbal")
    tables.write(s, name := own_table(s.sparkSession, "named"), create=True, schema=s.schema)
    return tables.read_named(s.sparkSession, name, s.schema)


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 5000 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 5000 AND s_acctbal > 100")
def write_then_read(t):
    """A table made by CREATE TABLE, filled, and filled again from itself."""
    s = t("supplier").select("s_suppkey", "s_acctbal").where("s_acctbal < 5000")
    spark, name = s.sparkSession, own_table(s.sparkSession, "write")
    tables.create_table(spark, name, s.schema)
    tables.write(s, name)
    tables.write(spark.table(name).where("s_acctbal > 100"), name, output="modified_records")
    return tables.read_named(spark, name)


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 100 AND s_acctbal < 5000")
def write_modified_records(t):
    """The rows that an insert from the table itself wrote, and no others."""
    s = t("supplier").select("s_suppkey", "s_acctbal").where("s_acctbal < 5000")
    spark, name = s.sparkSession, own_table(s.sparkSession, "modified")
    tables.write(s, name, create=True)
    return tables.write(spark.table(name).where("s_acctbal > 100"), name, output="modified_records")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 1e9")
def write_no_output(t):
    s = t("supplier").select("s_suppkey", "s_acctbal")
    return tables.write(s, own_table(s.sparkSession, "none"), create=True)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 10")
def view(t):
    s = t("supplier")
    tables.create_view(s.where("s_nationkey < 10").select("s_suppkey", "s_name"), name := own_table(s.sparkSession, "view"))
    return tables.read_named(s.sparkSession, name)


for fmt in ("orc", "csv", "json"):

    def stored(t, fmt=fmt):
        s = t("supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
        path = Scratch(s.sparkSession, "files").path(fmt)
        s.write.format(fmt).save(path)
        return tables.read_files(s.sparkSession, path, fmt, s.schema)

    stored.__name__ = f"read_{fmt}"
    query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")(stored)


# Events --------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(t):
    return ev.windowed(t("events"), n=F.count(F.lit(1))).drop("end")


@query("""SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL""")
def events_sliding(t):
    return ev.windowed(t("events"), size="1 hour", slide="30 minutes", n=F.count(F.lit(1))).drop("end")


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM
  (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def events_sessions(t):
    return ev.sessions(t("events"), n=F.count(F.lit(1)))
