"""Physical plans keep the shape the operators rely on."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators.ordered import group_quantiles

SF = os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")


def _plan(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_is_limited_before_the_shuffle(spark):
    assert _plan(spark, "top_n_per_group").count("WindowGroupLimit") == 2


def test_day_filter_and_columns_reach_the_scan(spark):
    scan = next(x for x in _plan(spark, "date_range_filter").splitlines() if "FileScan" in x)
    assert "DataFilters: [isnotnull(l_shipdate" in scan and "l_tax" not in scan and "l_suppkey" not in scan


def test_quantiles_scan_once(spark):
    df = entry.queries()["pooled_median"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


@pytest.mark.parametrize("name", ["two_level_median", "supply_clock", "asof_price", "publish_violations", "tier_share", "coverage_top"])
def test_no_nested_loops(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_two_level_median_has_few_exchanges(spark):
    df = entry.queries()["two_level_median"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("Exchange hashpartitioning") <= 8


def test_quantiles_with_large_keys_scan_once(spark, tmp_path):
    path = str(tmp_path / "values")
    spark.range(20_000).selectExpr("IF(id % 3 = 0, 'hot', string(id % 50)) AS k", "double(hash(id)) AS v").write.parquet(path)
    df = group_quantiles(spark.read.parquet(path), ["k"], "v", {"m": (0.5, "inclusive")}, small=1_000)
    assert {r.k: r.m for r in df.collect()} == {r.k: r.m for r in spark.read.parquet(path).selectExpr("k", "v").groupBy("k").agg(F.median("v").alias("m")).collect()}
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_a_task_of_entity_medians_orders_its_rows_once(spark):
    df = entry.queries()["entity_medians"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("+- Window") + final.count("- *Window") == 1 and final.count("Sort [") == 1
    assert "HashAggregate" not in final[: final.index("Window")]
