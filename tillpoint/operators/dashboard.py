"""Composed one-row reports: QY4 dashboard metrics and ST4 notifications.

Each number is a one-row aggregate. They are combined as scalar
subqueries on a one-row base (Spark runs each subquery as its own
distributed job and reuses identical ones), never by a cross join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.dates import date_lit, shift_days
from tillpoint.functions.text import php_currency
from tillpoint.operators.digital import month_totals, pending_counts
from tillpoint.operators.inventory import inventory_summary
from tillpoint.operators.ranking import best_category


def _struct_scalar(df: DataFrame):
    """One-row DataFrame -> a struct-valued scalar subquery."""
    return df.select(F.struct(*df.columns)).scalar()


def sales_numbers(t, as_of: str) -> DataFrame:
    """The dashboard's numbers from the sales: today, the 7 days up to today and
    all time, in one pass over two columns."""
    d, amount = F.col("sale_date"), F.col("total_amount")
    week = (d >= date_lit(shift_days(as_of, -6))) & (d <= date_lit(as_of))
    zero = F.lit(0).cast("decimal(18,2)")
    return t.sales.agg(F.coalesce(F.sum(F.when(d == date_lit(as_of), amount)), zero).alias("today_total"),
                       F.coalesce(F.sum(F.when(week, amount)), zero).alias("week_total"),
                       F.coalesce(F.sum(amount), zero).alias("total_revenue"))


def dashboard_metrics(t, as_of: str) -> DataFrame:
    """QY4: the dashboard's eleven numbers, one row."""
    inv = _struct_scalar(inventory_summary(t))
    sm = _struct_scalar(sales_numbers(t, as_of))
    best = _struct_scalar(best_category(t))
    return month_totals(t, as_of).select(
        inv["total"].alias("total_products"),
        inv["low_stock"].alias("low_stock_items"),
        inv["out_of_stock"].alias("out_of_stock_items"),
        sm["today_total"].alias("daily_sales"),
        "monthly_sales", "monthly_products", "monthly_load", "monthly_gcash",
        sm["total_revenue"].alias("total_revenue"),
        (sm["week_total"].cast("double") / 7.0).alias("average_daily"),
        best["best_category"].alias("best_category"),
    )


@dataclass(frozen=True)
class AlertSettings:
    """store_settings flags; defaults are the reference's column defaults."""
    low_stock_alert: bool = True
    out_of_stock_alert: bool = True
    daily_sales_alert: bool = True
    weekly_sales_alert: bool = False


def _plural(n, word: str):
    return F.concat(F.lit(word), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


# -- fixed values: the alerts' titles, texts and links below ------------------
def notifications(t, as_of: str, settings: AlertSettings = AlertSettings(), role: str = "Admin",
                  pending: DataFrame | None = None) -> DataFrame:
    """ST4: the alert feed (tone, title, message, link), in feed order. ``pending``
    may give the pending counts (one row, as :func:`pending_counts`) that a caller
    keeps up to date; else they are counted from the requests."""
    pend = _struct_scalar(pending_counts(t) if pending is None else pending)
    inv = _struct_scalar(inventory_summary(t))
    # the week's sales only: the day filter reaches the scan
    d, amount = F.col("sale_date"), F.col("total_amount")
    today, zero = d == date_lit(as_of), F.lit(0).cast("decimal(18,2)")
    base = t.sales.filter(d >= date_lit(shift_days(as_of, -6))).agg(
        F.coalesce(F.sum(F.when(today, amount)), zero).alias("today_total"), F.count_if(today).alias("today_transactions"),
        F.coalesce(F.sum(amount), zero).alias("weekly_total"))
    e, g, total = pend["eload_pending"], pend["gcash_pending"], pend["total_pending"]
    parts = F.concat_ws(" and ", F.when(e > 0, F.concat(e.cast("string"), F.lit(" eLoad"))),
                        F.when(g > 0, F.concat(g.cast("string"), F.lit(" GCash"))))
    low, out = inv["low_stock"], inv["out_of_stock"]
    is_admin = role == "Admin"

    def alert(pos, show, tone, title, message, link):
        return F.struct(F.lit(pos).alias("position"), show.alias("show"), F.lit(tone).alias("tone"),
                        F.lit(title).alias("title"), message.alias("message"),
                        (F.lit(link) if link else F.lit(None).cast("string")).alias("link"))

    feed = F.array(
        alert(1, total > 0, "primary", "Pending digital requests",
              F.concat(parts, F.lit(" "), _plural(total, "request"), F.lit(" waiting to be completed.")), "/eload"),
        alert(2, F.lit(settings.low_stock_alert) & (low > 0), "warning", "Low stock items",
              F.concat(low.cast("string"), F.lit(" "), _plural(low, "item"), F.lit(" need restocking soon.")),
              "/inventory?status=Low%20Stock"),
        alert(3, F.lit(settings.out_of_stock_alert) & (out > 0), "danger", "Out of stock",
              F.concat(out.cast("string"), F.lit(" "), _plural(out, "item"), F.lit(" are unavailable right now.")),
              "/inventory?status=Out%20of%20Stock"),
        alert(4, F.lit(is_admin and settings.daily_sales_alert), "success", "Today's sales",
              F.concat(php_currency(F.col("today_total")), F.lit(" across "),
                       F.col("today_transactions").cast("string"), F.lit(" "),
                       _plural(F.col("today_transactions"), "transaction"), F.lit(".")), None),
        alert(5, F.lit(is_admin and settings.weekly_sales_alert), "info", "Weekly sales",
              F.concat(php_currency(F.col("weekly_total")), F.lit(" recorded in the last 7 days.")), None),
    )
    return (base.select(F.inline(feed)).filter(F.col("show"))
                .select("position", "tone", "title", "message", "link"))
