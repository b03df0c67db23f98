"""Registered sales queries (QY2, QY3, QY6 parts) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.functions.dates import shift_days
from tillpoint.operators import sales as S
from tillpoint.plans.present import flat, positioned
from tillpoint.plans.registry import register
from tillpoint.plans.sqlviews import with_views

AS_OF = P.AS_OF
WEEK_FROM = shift_days(AS_OF, -6)
MONTH_FROM = shift_days(AS_OF, -29)


def d(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


_SALE_SELECT = (f"id, transaction_code, {d('sale_date')} AS sale_date, payment_method, employee_name, "
                f"CAST(total_amount AS DOUBLE) AS total_amount, {ts('created_at')} AS created_at")


@register("scan_sales", with_views(f"SELECT {_SALE_SELECT} FROM sales", "sales"))
def scan_sales(t):
    return flat(t.sales)


@register("report_product_logs", with_views(f"""
WITH sums AS (SELECT sale_id AS log_id, CAST(sum(total) AS DOUBLE) AS total_amount FROM sale_items GROUP BY sale_id)
SELECT log_id, transaction_code, {d('sale_date')} AS sale_date, employee_name, {ts('created_at')} AS time_stamp, sums.total_amount
FROM sums JOIN sales ON id = log_id""", "sales", "sale_items"))
def report_product_logs(t):
    return flat(S.report_product_logs(t))


@register("sales_today", with_views(
    f"SELECT {_SALE_SELECT} FROM sales WHERE sale_date = DATE '{AS_OF}'", "sales"))
def sales_today(t):
    return flat(S.list_sales(t, "today", AS_OF))


@register("sales_month", with_views(
    f"SELECT {_SALE_SELECT}, CAST(row_number() OVER (ORDER BY sales.sale_date DESC, id DESC) AS BIGINT) AS position "
    f"FROM sales WHERE sales.sale_date >= DATE '{MONTH_FROM}'", "sales"))
def sales_month(t):
    """FL5 / SO3: the month's sales with their place."""
    return flat(positioned(S.list_sales(t, "month", AS_OF), ["id"], S.sale_order(), ["sale_date"]))


_LINES_ALL = """
lines_all AS (
  SELECT sale_id, inventory_item_id, item_name, quantity, price, total, 'inventory' AS item_type FROM sale_items
  UNION ALL
  SELECT sale_id, CAST(NULL AS BIGINT), load_value, quantity, price, total, 'eload' FROM sale_digital_items)"""


@register("sales_week", with_views(f"""
WITH {_LINES_ALL},
per_sale AS (SELECT sale_id, count(*) AS n_lines, sum(quantity) AS n_units, sum(total) AS lines_total
             FROM lines_all GROUP BY sale_id)
SELECT {_SALE_SELECT.replace('id, ', 's.id AS id, ', 1)},
       CAST(COALESCE(p.n_lines, 0) AS BIGINT) AS n_lines, CAST(COALESCE(p.n_units, 0) AS BIGINT) AS n_units,
       CAST(COALESCE(p.lines_total, 0) AS DOUBLE) AS lines_total
FROM sales s LEFT JOIN per_sale p ON p.sale_id = s.id
WHERE s.sale_date >= DATE '{WEEK_FROM}'""", "sales", "sale_items", "sale_digital_items"))
def sales_week(t):
    """QY2: the week's sales with their nested items summarised."""
    n = S.sales_nested(t, "week", AS_OF)
    return flat(n.select(*S.SALE_COLUMNS,
                         F.size("items").cast("bigint").alias("n_lines"),
                         F.aggregate("items", F.lit(0).cast("bigint"), lambda acc, x: acc + x["quantity"]).alias("n_units"),
                         F.aggregate("items", F.lit(0).cast("decimal(38,2)"), lambda acc, x: acc + x["total"]).alias("lines_total")))


@register("sale_lines_all", with_views(f"""
WITH {_LINES_ALL}
SELECT sale_id, inventory_item_id, item_name, CAST(quantity AS BIGINT) AS quantity,
       CAST(price AS DOUBLE) AS price, CAST(total AS DOUBLE) AS total, item_type
FROM lines_all""", "sale_items", "sale_digital_items"))
def sale_lines_all(t):
    return flat(S.sale_lines_all(t).drop("line_kind", "line_no"))


@register("sales_nested", with_views(f"""
WITH keyed AS (
  SELECT sale_id, 0 AS kind, line_no, inventory_item_id AS item_id, CAST(inventory_item_id AS VARCHAR) AS item, item_name, quantity, price, total, 'inventory' AS item_type FROM sale_items
  UNION ALL
  SELECT sale_id, 1, NULL, NULL, '', load_value, quantity, price, total, 'eload' FROM sale_digital_items),
texts AS (SELECT sale_id, string_agg(concat_ws('|', item, item_name, CAST(quantity AS VARCHAR), CAST(price AS VARCHAR), CAST(total AS VARCHAR), item_type),
                                     ';' ORDER BY kind, line_no, item_id, item_name, quantity, price) AS items FROM keyed GROUP BY sale_id)
SELECT {_SALE_SELECT}, coalesce(texts.items, '') AS items,
       CAST(row_number() OVER (ORDER BY sales.sale_date DESC, id DESC) AS BIGINT) AS position
FROM sales LEFT JOIN texts ON texts.sale_id = id WHERE sales.sale_date >= DATE '{WEEK_FROM}'""", "sales", "sale_items", "sale_digital_items"))
def sales_nested(t):
    """NE1: the week's sales with their ``items`` arrays, printed as text."""
    n = S.sales_nested(t, "week", AS_OF)
    item = lambda x: F.concat_ws("|", F.coalesce(x["inventory_item_id"].cast("string"), F.lit("")), x["item_name"],
                                 x["quantity"].cast("string"), x["price"].cast("string"), x["total"].cast("string"), x["item_type"])
    return flat(positioned(n.withColumn("items", F.array_join(F.transform("items", item), ";")), ["id"], S.sale_order(), ["sale_date"]))


@register("sales_metrics", with_views(f"""
WITH {_LINES_ALL}
SELECT CAST(COALESCE(SUM(total_amount) FILTER (WHERE sale_date = DATE '{AS_OF}'), 0) AS DOUBLE) AS today_total,
       CAST(COUNT(*) FILTER (WHERE sale_date = DATE '{AS_OF}') AS BIGINT) AS today_transactions,
       CAST((SELECT COALESCE(SUM(l.quantity), 0) FROM lines_all l
             WHERE l.sale_id IN (SELECT id FROM sales WHERE sale_date = DATE '{AS_OF}')) AS BIGINT) AS today_items,
       CAST(COALESCE(SUM(total_amount) FILTER (WHERE sale_date >= DATE '{WEEK_FROM}'), 0) AS DOUBLE) AS weekly_total,
       CAST(COALESCE(SUM(total_amount) FILTER (WHERE sale_date >= DATE '{MONTH_FROM}'), 0) AS DOUBLE) AS monthly_total
FROM sales""", "sales", "sale_items", "sale_digital_items"))
def sales_metrics(t):
    return flat(S.sales_metrics(t, AS_OF))


_WEEK_CAL = f"cal AS (SELECT CAST(DATE '{WEEK_FROM}' + INTERVAL (i) DAY AS DATE) AS day FROM range(7) r(i))"


@register("weekly_series", with_views(f"""
WITH {_WEEK_CAL},
daily AS (SELECT sale_date AS day, SUM(total_amount) AS total FROM sales
          WHERE sale_date >= DATE '{WEEK_FROM}' AND sale_date <= DATE '{AS_OF}' GROUP BY sale_date)
SELECT {d('cal.day')} AS day, strftime(cal.day, '%a') AS label, CAST(COALESCE(daily.total, 0) AS DOUBLE) AS total
FROM cal LEFT JOIN daily ON daily.day = cal.day""", "sales"))
def weekly_series(t):
    return flat(S.weekly_series(t, AS_OF))


@register("average_daily", with_views(f"""
SELECT CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) / 7.0 AS average_daily FROM sales
WHERE sale_date >= DATE '{WEEK_FROM}' AND sale_date <= DATE '{AS_OF}'""", "sales"))
def average_daily(t):
    return flat(S.average_daily(t, AS_OF))


@register("monthly_series", with_views("""
SELECT strftime(sale_date, '%Y-%m') AS month_key, strftime(sale_date, '%b') AS label,
       CAST(SUM(total_amount) AS DOUBLE) AS total
FROM sales GROUP BY 1, 2""", "sales"))
def monthly_series(t):
    return flat(S.monthly_series(t))


@register("total_revenue", with_views(
    "SELECT CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) AS total_revenue FROM sales", "sales"))
def total_revenue(t):
    return flat(S.total_revenue(t))


@register("recent_sales", with_views(
    f"SELECT {_SALE_SELECT} FROM sales ORDER BY sale_date DESC, id DESC LIMIT 20", "sales"))
def recent_sales(t):
    return flat(S.recent_sales(t, 20))
