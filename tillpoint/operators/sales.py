"""Sales reports: SC3, FL5, JN5/NE1, SU2, AG2, AG4, AG5, AG10, SO3.

Line tables are always aggregated per sale (partial + final hash
aggregation) *before* they meet ``sales``, so the join sees one row per
sale and a sale with very many lines is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.dates import date_lit, shift_days
from tillpoint.functions.text import month_short, weekday_short

SALE_COLUMNS = ("id", "transaction_code", "sale_date", "payment_method", "employee_name",
                "total_amount", "created_at")


def report_product_logs(t, sale_filter=None) -> DataFrame:
    """SC3 / JN1: sales that have product lines, with the sum of those lines.

    Sales without product lines (digital-only sales) drop out, as in the
    reference's inner join. ``sale_filter`` (a predicate on the sales
    columns, e.g. one day or one month) is applied to the sales first and
    reaches the lines through a semi join, so only the matching sales'
    lines are aggregated.
    """
    s = t.sales if sale_filter is None else t.sales.filter(sale_filter)
    lines = t.sale_items
    if sale_filter is not None:
        lines = lines.join(s.select(F.col("id").alias("sale_id")), "sale_id", "left_semi")
    per_sale = lines.groupBy("sale_id").agg(F.sum("total").alias("lines_total"))
    return (s.join(per_sale, s.id == per_sale.sale_id, "inner")
             .select(s.id.alias("log_id"), s.transaction_code, s.sale_date, s.employee_name,
                     s.created_at.alias("time_stamp"),
                     F.coalesce(F.col("lines_total"), F.lit(0).cast("decimal(18,2)")).alias("total_amount")))


def period_filter(period: str, as_of: str):
    """FL5: today ``=``, week ``>= d-6``, month ``>= d-29`` (open upper bound)."""
    d = F.col("sale_date")
    if period == "today":
        return d == date_lit(as_of)
    if period == "week":
        return d >= date_lit(shift_days(as_of, -6))
    if period == "month":
        return d >= date_lit(shift_days(as_of, -29))
    return F.lit(True)


def list_sales(t, period: str, as_of: str) -> DataFrame:
    """FL5 / SO3: the sales of a rolling period (filter pushed to the scan),
    newest first."""
    return t.sales.filter(period_filter(period, as_of)).select(*SALE_COLUMNS).orderBy(*sale_order())


def sale_order():
    return [F.col("sale_date").desc(), F.col("id").desc()]


def sale_lines_all(t) -> DataFrame:
    """SU2: product and digital lines under one schema (digital lines have a
    NULL ``inventory_item_id`` and their load value as the item name)."""
    product = t.sale_items.select(
        "sale_id", "inventory_item_id", "item_name", "quantity", "price", "total",
        F.lit("inventory").alias("item_type"), F.lit(0).alias("line_kind"), F.col("line_no"))
    digital = t.sale_digital_items.select(
        "sale_id", F.lit(None).cast("bigint").alias("inventory_item_id"),
        F.col("load_value").alias("item_name"), "quantity", "price", "total",
        F.lit("eload").alias("item_type"), F.lit(1).alias("line_kind"),
        F.lit(None).cast("int").alias("line_no"))
    return product.unionByName(digital)


def sales_nested(t, period: str, as_of: str) -> DataFrame:
    """NE1 / JN5: each sale with its ``items`` array, product lines first.

    One grouped ``collect_list`` per sale (bounded by that sale's lines)
    joined back with a left join, so sales without lines keep ``[]``.
    """
    sales = list_sales(t, period, as_of)
    lines = sale_lines_all(t).join(sales.select(F.col("id").alias("sale_id")), "sale_id", "left_semi")
    item = F.struct("line_kind", "line_no", "inventory_item_id", "item_name", "quantity",
                    "price", "total", "item_type")
    nested = lines.groupBy("sale_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return (sales.join(nested, sales.id == nested.sale_id, "left")
                 .select(*[sales[c] for c in SALE_COLUMNS],
                         F.coalesce(F.col("items"), F.array().cast(nested.schema["items"].dataType)).alias("items"))
                 .orderBy(*sale_order()))


def sales_metrics(t, as_of: str) -> DataFrame:
    """AG2: today total / count / units, 7-day and 30-day totals, one row."""
    s = t.sales
    today = F.col("sale_date") == date_lit(as_of)
    week = F.col("sale_date") >= date_lit(shift_days(as_of, -6))
    month = F.col("sale_date") >= date_lit(shift_days(as_of, -29))
    zero = F.lit(0).cast("decimal(18,2)")
    today_ids = s.filter(today).select(F.col("id").alias("sale_id"))
    units = (sale_lines_all(t).join(today_ids, "sale_id", "left_semi")
             .select(F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint")))
    return s.agg(
        F.coalesce(F.sum(F.when(today, F.col("total_amount"))), zero).alias("today_total"),
        F.count_if(today).alias("today_transactions"),
        units.scalar().alias("today_items"),
        F.coalesce(F.sum(F.when(week, F.col("total_amount"))), zero).alias("weekly_total"),
        F.coalesce(F.sum(F.when(month, F.col("total_amount"))), zero).alias("monthly_total"),
    )


def calendar(spark, first_day: str, n_days: int) -> DataFrame:
    """A small calendar dimension: ``n_days`` dates from ``first_day``."""
    return spark.range(n_days).select(
        F.date_add(date_lit(first_day), F.col("id").cast("int")).alias("day"))


def weekly_series(t, as_of: str) -> DataFrame:
    """AG10: the 7 days ending at ``as_of`` with zero fill."""
    first = shift_days(as_of, -6)
    daily = (t.sales.filter((F.col("sale_date") >= date_lit(first)) & (F.col("sale_date") <= date_lit(as_of)))
             .groupBy(F.col("sale_date").alias("day")).agg(F.sum("total_amount").alias("total")))
    cal = calendar(t.spark, first, 7)
    return (cal.join(daily, "day", "left")
               .select("day", weekday_short(F.col("day")).alias("label"),
                       F.coalesce(F.col("total"), F.lit(0).cast("decimal(18,2)")).alias("total")))


def average_daily(t, as_of: str) -> DataFrame:
    """AG10: mean of the 7-day series (divides by 7, days without sales count)."""
    return weekly_series(t, as_of).agg(
        (F.sum("total").cast("double") / F.lit(7.0)).alias("average_daily"))


def monthly_series(t) -> DataFrame:
    """AG4: revenue per ``YYYY-MM`` (no gap filling; NULL date -> NULL group)."""
    key = F.date_format(F.col("sale_date"), "yyyy-MM")
    return (t.sales.groupBy(key.alias("month_key"))
            .agg(F.sum("total_amount").alias("total"))
            .select("month_key",
                    month_short(F.to_date(F.concat(F.col("month_key"), F.lit("-01")))).alias("label"),
                    "total"))


def total_revenue(t) -> DataFrame:
    """AG5: sum of every sale's total, 0 when there are none."""
    return t.sales.agg(F.coalesce(F.sum("total_amount"), F.lit(0).cast("decimal(18,2)")).alias("total_revenue"))


def recent_sales(t, n: int = 20) -> DataFrame:
    """SO3: newest ``n`` sales (date desc, id desc) as a top-k, not a full sort."""
    return t.sales.orderBy(*sale_order()).limit(n).select(*SALE_COLUMNS)
