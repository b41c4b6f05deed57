"""Every registered relational query against its SQL, and a few plans."""

import pytest

from helpers import compare, database
from plankton.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    compare(QUERIES[name](spark, SF), con, ORACLES[name])


def test_decimal_divide_clamped_with_large_keys(spark, tmp_path):
    """Order keys of more than 1.4 million, as larger tables have them; prices near the type's end, halves, no price."""
    keys = [0, 1, 149_999, 1_428_570, 1_428_572, 9_000_000, 10**9, 10**11]
    rows = [(k, c, p) for k in keys for c in (0, 14_999, 99_999_999) for p in (0.0, 0.01, 499_993.18, 99_999_999.99, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    big = database(SF)
    big.execute(f"CREATE OR REPLACE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert compare(QUERIES["decimal_divide_clamped"](spark, str(tmp_path)), big, ORACLES["decimal_divide_clamped"]) == len(rows)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["read_filter_and_mask"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>" in text


def test_topn_is_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["flagship_topn"](spark, SF))


def test_grouping_sets_scan_once(spark):
    assert plan(QUERIES["aggregate_set_index"](spark, SF)).split("== Physical Plan ==")[1].count("FileScan") == 1


def test_nested_mask_prunes_the_struct(spark):
    assert "c_name" not in plan(QUERIES["read_nested_mask"](spark, SF)).split("== Physical Plan ==")[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
