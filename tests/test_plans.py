"""Physical plans: pushed filters, pruned columns, no pairing of all rows, no unbounded single partition."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
QUERIES = contract.queries()


def plan(df):
    # the default cuts the list of pushed filters short
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name,pushed,absent",
    [
        ("record_selection", "GreaterThanOrEqual(o_totalprice,250000", "o_shippriority"),
        ("filter_rows", "GreaterThanOrEqual(o_totalprice,100000", "o_custkey"),
        ("semi_filter", "EqualTo(o_orderpriority,1-URGENT)", "o_totalprice"),
        ("read_query", "GreaterThan(o_totalprice,300000.5)", "o_orderdate"),
    ],
)
def test_filters_and_columns_reach_the_scan(spark, name, pushed, absent):
    text = plan(QUERIES[name](spark, FOLDER))
    assert pushed in text
    assert all(absent not in line for line in text.splitlines() if "FileScan" in line)


@pytest.mark.parametrize(
    "name",
    ["lookup", "multi_lookup", "interval_match", "fuzzy_match", "link_tables", "nest_children", "top_n_others", "upsert",
     "apply_changes", "diff_keyed", "diff_rows", "number_parity", "unique_rows", "percent_of_sum", "rank_by_aggregate"],
)
def test_no_pairing_of_all_rows(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    # the one-row sides of totals are the only non-equi joins
    assert "BroadcastNestedLoopJoin" not in text


def test_top_n_drops_rows_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["rank_n_rows"](spark, FOLDER))


def test_split_filter_pushes_the_passing_side(spark):
    from tallyloom.operators.select import split_filter

    good, _ = split_filter(spark.read.parquet(f"{FOLDER}/customer.parquet"), F.col("c_acctbal") > 2500)
    assert "GreaterThan(c_acctbal,2500" in plan(good)
