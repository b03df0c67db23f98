"""Canonical storage: a snapshot read back gives the same reports, and day
filters on sales prune partitions at the scan."""

from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.functions.dates import date_lit
from tillpoint.operators import dashboard as DB
from tillpoint.operators import ranking as R
from tillpoint.sinks.snapshot import verify_snapshot, write_snapshot
from tillpoint.sources.store import CanonicalTables
from tillpoint.streaming.live_totals import scratch_path


def test_snapshot_round_trip_and_pruning(spark, tables):
    folder = scratch_path(spark, "store")
    manifest = write_snapshot(tables, folder, P.AS_OF)
    assert manifest.count() == 9
    assert all(r["ok"] for r in verify_snapshot(spark, folder).collect())
    stored = CanonicalTables(spark, folder)
    assert DB.dashboard_metrics(stored, P.AS_OF).collect() == DB.dashboard_metrics(tables, P.AS_OF).collect()
    assert sorted(R.best_selling(stored).collect()) == sorted(R.best_selling(tables).collect())
    plan = stored.sales.filter(F.col("sale_date") == date_lit(P.AS_OF))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(sale_date), EqualTo(sale_date" in plan
    month = stored.sales_in_months(P.AS_OF, P.AS_OF)
    assert "PartitionFilters: [isnotnull(sale_month" in month._jdf.queryExecution().executedPlan().toString()
    assert month.filter(F.col("sale_date") == date_lit(P.AS_OF)).count() == \
        tables.sales.filter(F.col("sale_date") == date_lit(P.AS_OF)).count()


def test_reports_agree_on_stored_tables(spark, tables):
    from tillpoint.operators import digital as D
    from tillpoint.operators import inventory as I
    from tillpoint.operators import recommend as RC
    from tillpoint.operators import sales as S

    folder = scratch_path(spark, "store-reports")
    write_snapshot(tables, folder, P.AS_OF)
    stored = CanonicalTables(spark, folder)
    for build in (lambda t: D.chart_month(t, P.AS_OF), lambda t: D.logs_summary(t, P.AS_OF),
                  lambda t: R.category_share(t), lambda t: S.sales_metrics(t, P.AS_OF),
                  lambda t: I.list_inventory(t, "brand#1"), lambda t: RC.recommendations(t, P.AS_OF),
                  lambda t: D.request_queue(t)):
        assert sorted(build(stored).collect()) == sorted(build(tables).collect())
