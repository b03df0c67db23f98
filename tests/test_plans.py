"""Plan shape guards for scale: no cartesian / nested-loop joins anywhere,
and line tables are combined map-side before they are shuffled."""

import pytest

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(E.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["report_product_logs", "best_selling_top8", "category_revenue", "cart_totals"])
def test_line_aggregates_are_partial_before_the_shuffle(spark, name):
    plan = _plan(E.queries()[name](spark, SMALL))
    assert "partial_sum" in plan


def test_audit_reads_each_table_once_for_its_keys(spark):
    """Sales and their lines are read again for the sums; several tables are views of
    one file here, so files are read more often than tables."""
    plan = E.queries()["integrity_audit"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 22
