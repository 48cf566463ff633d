"""Every registered query against its SQL on the smallest tables."""

import __spark_entry__ as entry
import pytest

from checks.compare import check, connect, spark_rows
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_query(spark, con, sf, name):
    assert check(spark, con, sf, name, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_entry(spark):
    names, rows = spark_rows(entry.entry(spark))
    assert names == ["ads", "domain", "headline_chars", "headlines", "records"] and rows


def test_no_plan_has_a_cross_join(spark, sf):
    for name, fn in QUERIES.items():
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


NATIVE = "c1_process c3_price c4_date d1_consolidate d3_filter d4_sort e5_standardise e7_title_case e8_clean_prices f1_sanitise f7_join_url h6_issues"


@pytest.mark.parametrize("name", NATIVE.split())
def test_native_operators_stay_in_the_jvm(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapInArrow" not in plan


def test_filter_and_columns_reach_the_scan(spark, sf):
    plan = entry.queries()["d3_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,5)" in plan and "p_retailprice" not in plan


def test_scans_read_only_what_is_used(spark, sf):
    plan = entry.queries()["h6_issues"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint>" in plan
