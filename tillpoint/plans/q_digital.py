"""Registered digital-request, log and dashboard queries (QY4, QY5, QY8,
QY9, QY10) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.functions.dates import month_length, month_start, next_month_start, shift_days
from tillpoint.operators import dashboard as DB
from tillpoint.operators import digital as D
from tillpoint.plans.present import flat, positioned
from tillpoint.plans.registry import register
from tillpoint.plans.sqlviews import with_views

AS_OF = P.AS_OF
LOG_DAY = P.AS_OF
M0, M1, MLEN = month_start(AS_OF), next_month_start(AS_OF), month_length(AS_OF)
WEEK_FROM = shift_days(AS_OF, -6)
MONTH_FROM = shift_days(AS_OF, -29)


def d(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def local_day(x: str) -> str:
    return f"CAST({x} + INTERVAL 8 HOUR AS DATE)"


_REQ = f"""id, request_code, service_type, status, mobile_number, CAST(amount AS DOUBLE) AS amount, request_kind,
       network, load_type, load_value, reference_no, notes, requested_by_name, {ts('requested_at')} AS requested_at,
       completed_by_name, {ts('completed_at')} AS completed_at, failed_reason, failed_by_name, {ts('failed_at')} AS failed_at"""

_VIEW_TAIL = f"""CAST(amount AS DOUBLE) AS amount,
       COALESCE(completed_by_name, requested_by_name, 'System') AS employee_name,
       {d(local_day('COALESCE(completed_at, requested_at)'))} AS sale_date,
       {ts('COALESCE(completed_at, requested_at)')} AS time_stamp,
       status, requested_by_name, {ts('requested_at')} AS requested_at, completed_by_name,
       {ts('completed_at')} AS completed_at, failed_reason"""


@register("report_eload_logs", with_views(f"""
SELECT id AS request_id, request_code AS transaction_code, mobile_number AS number, network,
       COALESCE(load_value, request_kind, '') AS item_name, {_VIEW_TAIL}
FROM digital_service_requests WHERE service_type = 'eload'""", "digital_service_requests"))
def report_eload_logs(t):
    return flat(D.report_eload_logs(t))


@register("report_gcash_logs", with_views(f"""
SELECT id AS request_id, request_code AS transaction_code, mobile_number AS number, reference_no,
       request_kind, {_VIEW_TAIL}
FROM digital_service_requests WHERE service_type = 'gcash'""", "digital_service_requests"))
def report_gcash_logs(t):
    return flat(D.report_gcash_logs(t))


_LOGS_DIGITAL = f"""
logs AS (
  SELECT id, request_code, 'eload' AS service_type, status, mobile_number AS number, amount, '' AS request_kind,
         network, '' AS load_type, COALESCE(load_value, request_kind, '') AS load_value, '' AS reference_no,
         requested_by_name AS requested_by, requested_at, completed_by_name AS completed_by, completed_at
  FROM digital_service_requests WHERE service_type = 'eload'
  UNION ALL
  SELECT id, request_code, 'gcash', status, mobile_number, amount, request_kind, '', '', '', reference_no,
         requested_by_name, requested_at, completed_by_name, completed_at
  FROM digital_service_requests WHERE service_type = 'gcash'),
day_logs AS (SELECT * FROM logs WHERE {local_day('requested_at')} = DATE '{LOG_DAY}')"""


@register("logs_digital", with_views(f"""
WITH {_LOGS_DIGITAL}
SELECT request_code, service_type, status, number, CAST(amount AS DOUBLE) AS amount, request_kind, network,
       load_type, load_value, reference_no, requested_by, {ts('requested_at')} AS requested_at, completed_by,
       {ts('completed_at')} AS completed_at,
       CAST(row_number() OVER (ORDER BY requested_at DESC, id DESC) AS BIGINT) AS position
FROM day_logs""", "digital_service_requests"))
def logs_digital(t):
    """SO9: newest first."""
    return flat(positioned(D.logs_digital(t, LOG_DAY), ["log_id"], D.log_order("requested_at"), ["requested_at"])).drop("log_id")


_RPL = """
line_sums AS (SELECT sale_id AS log_id, sum(total) AS total_amount FROM sale_items GROUP BY sale_id),
rpl AS (SELECT log_id, transaction_code, sale_date, employee_name, created_at AS time_stamp, line_sums.total_amount
        FROM line_sums JOIN sales ON id = log_id)"""


@register("logs_products", with_views(f"""
WITH {_RPL}
SELECT r.log_id, r.transaction_code, {d('r.sale_date')} AS sale_date, r.employee_name,
       {ts('r.time_stamp')} AS time_stamp, CAST(r.total_amount AS DOUBLE) AS total_amount,
       si.inventory_item_id AS product_id, si.item_name, CAST(si.line_no AS BIGINT) AS line_no,
       CAST(si.quantity AS BIGINT) AS quantity, CAST(si.price AS DOUBLE) AS selling_price,
       CAST(si.quantity * si.price AS DOUBLE) AS amount,
       CAST(row_number() OVER (ORDER BY r.time_stamp DESC, r.log_id DESC, si.line_no, si.inventory_item_id) AS BIGINT) AS position
FROM rpl r JOIN sale_items si ON si.sale_id = r.log_id
WHERE r.sale_date = DATE '{LOG_DAY}'""", "sales", "sale_items"))
def logs_products(t):
    """SO9: newest log first, its lines in order."""
    return flat(positioned(D.logs_products(t, LOG_DAY), ["log_id", "line_no", "product_id"], D.product_log_order(), ["time_stamp"]))


@register("logs_products_nested", with_views(f"""
WITH {_RPL},
texts AS (SELECT sale_id AS log_id, string_agg(concat_ws('|', CAST(inventory_item_id AS VARCHAR), item_name, CAST(quantity AS VARCHAR), CAST(price AS VARCHAR)), '; '
                                               ORDER BY line_no, inventory_item_id) AS products FROM sale_items GROUP BY sale_id)
SELECT log_id, transaction_code, {d('sale_date')} AS sale_date, employee_name, {ts('time_stamp')} AS time_stamp,
       CAST(total_amount AS DOUBLE) AS total_amount, products,
       CAST(row_number() OVER (ORDER BY rpl.time_stamp DESC, log_id DESC) AS BIGINT) AS position
FROM rpl JOIN texts USING (log_id) WHERE rpl.sale_date = DATE '{LOG_DAY}'""", "sales", "sale_items"))
def logs_products_nested(t):
    """NE2: the day's product logs with their ``products`` arrays, printed as text."""
    n = D.logs_products_nested(t, LOG_DAY)
    item = lambda x: F.concat_ws("|", x["product_id"].cast("string"), x["item_name"], x["quantity"].cast("string"), x["selling_price"].cast("string"))
    n = n.withColumn("products", F.array_join(F.transform("products", item), "; "))
    return flat(positioned(n, ["log_id"], D.log_order("time_stamp"), ["time_stamp"]))


def _summary_cols() -> str:
    cols = []
    for svc in ("eload", "gcash"):
        for label, cond in (("", "TRUE"), ("_completed", "lower(status) = 'completed'"),
                            ("_failed", "lower(status) = 'failed'")):
            hit = f"service_type = '{svc}' AND {cond}"
            cols.append(f"CAST(count(*) FILTER (WHERE {hit}) AS BIGINT) AS {svc}{label}_count")
            cols.append(f"CAST(COALESCE(SUM(amount) FILTER (WHERE {hit}), 0) AS DOUBLE) AS {svc}{label}_total")
    return ",\n       ".join(cols)


@register("logs_summary", with_views(f"""
WITH {_LOGS_DIGITAL}, {_RPL.strip()}
SELECT (SELECT CAST(count(*) AS BIGINT) FROM rpl WHERE sale_date = DATE '{LOG_DAY}') AS product_count,
       (SELECT CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) FROM rpl WHERE sale_date = DATE '{LOG_DAY}') AS product_total,
       {_summary_cols()}
FROM day_logs""", "digital_service_requests", "sales", "sale_items"))
def logs_summary(t):
    return flat(D.logs_summary(t, LOG_DAY))


_CHART = f"""
cal AS (SELECT CAST(DATE '{M0}' + INTERVAL (i) DAY AS DATE) AS day FROM range({MLEN}) r(i)),
{_RPL.strip()},
prod AS (SELECT sale_date AS day, SUM(total_amount) AS products FROM rpl
         WHERE sale_date >= DATE '{M0}' AND sale_date < DATE '{M1}' GROUP BY sale_date),
dig AS (SELECT {local_day('completed_at')} AS day,
               SUM(CASE WHEN lower(service_type) = 'gcash' THEN amount END) AS gcash,
               SUM(CASE WHEN lower(service_type) = 'eload' THEN amount END) AS "load"
        FROM digital_service_requests
        WHERE status = 'Completed' AND completed_at IS NOT NULL
          AND {local_day('completed_at')} >= DATE '{M0}' AND {local_day('completed_at')} < DATE '{M1}'
        GROUP BY 1),
chart AS (SELECT cal.day, COALESCE(dig.gcash, 0) AS gcash, COALESCE(dig."load", 0) AS "load",
                 COALESCE(prod.products, 0) AS products
          FROM cal LEFT JOIN dig ON dig.day = cal.day LEFT JOIN prod ON prod.day = cal.day)"""


CHART_MONTH_SQL = with_views(f"""
WITH {_CHART}
SELECT CAST(dayofmonth(day) AS BIGINT) AS day_of_month, {d('day')} AS day, CAST(gcash AS DOUBLE) AS gcash,
       CAST("load" AS DOUBLE) AS "load", CAST(products AS DOUBLE) AS products
FROM chart""", "sales", "sale_items", "digital_service_requests")


@register("chart_month", CHART_MONTH_SQL)
def chart_month(t):
    return flat(D.chart_month(t, AS_OF))


_MONTH_TOTALS = """
mt AS (SELECT SUM(gcash) AS monthly_gcash, SUM("load") AS monthly_load, SUM(products) AS monthly_products,
              SUM(gcash) + SUM("load") + SUM(products) AS monthly_sales FROM chart)"""


@register("dashboard_month_totals", with_views(f"""
WITH {_CHART}, {_MONTH_TOTALS.strip()}
SELECT CAST(monthly_gcash AS DOUBLE) AS monthly_gcash, CAST(monthly_load AS DOUBLE) AS monthly_load,
       CAST(monthly_products AS DOUBLE) AS monthly_products, CAST(monthly_sales AS DOUBLE) AS monthly_sales
FROM mt""", "sales", "sale_items", "digital_service_requests"))
def dashboard_month_totals(t):
    return flat(D.month_totals(t, AS_OF))


_INV_STATUS = """
inv AS (SELECT count(*) AS total,
               count(*) FILTER (WHERE st = 'Low Stock') AS low_stock,
               count(*) FILTER (WHERE st = 'Out of Stock') AS out_of_stock
        FROM (SELECT CASE WHEN lower(trim(coalesce(status, ''))) IN ('low stock', 'low-stock') THEN 'Low Stock'
                          WHEN lower(trim(coalesce(status, ''))) IN ('out of stock', 'out-of-stock') THEN 'Out of Stock'
                          ELSE 'In Stock' END AS st FROM inventory_items))"""

def _sales_nums(as_of: str) -> str:
    week_from = shift_days(as_of, -6)
    return f"""
sm AS (SELECT COALESCE(SUM(total_amount) FILTER (WHERE sale_date = DATE '{as_of}'), 0) AS today_total,
              count(*) FILTER (WHERE sale_date = DATE '{as_of}') AS today_transactions,
              COALESCE(SUM(total_amount) FILTER (WHERE sale_date >= DATE '{week_from}'), 0) AS weekly_total,
              COALESCE(SUM(total_amount), 0) AS total_revenue,
              COALESCE(SUM(total_amount) FILTER (WHERE sale_date >= DATE '{week_from}' AND sale_date <= DATE '{as_of}'), 0) AS week_series_total
       FROM sales)"""


_SALES_NUMS = _sales_nums(AS_OF)


@register("dashboard_metrics", with_views(f"""
WITH {_CHART}, {_MONTH_TOTALS.strip()}, {_INV_STATUS.strip()}, {_SALES_NUMS.strip()},
per_item AS (SELECT inventory_item_id AS id, sum(total) AS revenue FROM sale_items GROUP BY 1),
cat AS (SELECT category, sum(revenue) AS revenue FROM per_item JOIN inventory_items USING (id) GROUP BY category)
SELECT CAST(inv.total AS BIGINT) AS total_products, CAST(inv.low_stock AS BIGINT) AS low_stock_items,
       CAST(inv.out_of_stock AS BIGINT) AS out_of_stock_items, CAST(sm.today_total AS DOUBLE) AS daily_sales,
       CAST(mt.monthly_sales AS DOUBLE) AS monthly_sales, CAST(mt.monthly_products AS DOUBLE) AS monthly_products,
       CAST(mt.monthly_load AS DOUBLE) AS monthly_load, CAST(mt.monthly_gcash AS DOUBLE) AS monthly_gcash,
       CAST(sm.total_revenue AS DOUBLE) AS total_revenue,
       CAST(sm.week_series_total AS DOUBLE) / 7.0 AS average_daily,
       (SELECT category FROM cat ORDER BY revenue DESC, category ASC LIMIT 1) AS best_category
FROM mt, inv, sm""", "sales", "sale_items", "digital_service_requests", "inventory_items"))
def dashboard_metrics(t):
    return flat(DB.dashboard_metrics(t, AS_OF))


@register("pending_counts", with_views("""
SELECT CAST(count(*) FILTER (WHERE status = 'Pending' AND service_type = 'eload') AS BIGINT) AS eload_pending,
       CAST(count(*) FILTER (WHERE status = 'Pending' AND service_type = 'gcash') AS BIGINT) AS gcash_pending,
       CAST(count(*) FILTER (WHERE status = 'Pending') AS BIGINT) AS total_pending
FROM digital_service_requests""", "digital_service_requests"))
def pending_counts(t):
    return flat(D.pending_counts(t))


@register("request_queue", with_views(f"""
SELECT {_REQ},
       CAST(row_number() OVER (ORDER BY CASE WHEN status = 'Pending' THEN 0 ELSE 1 END, requested_at DESC, id DESC)
            AS BIGINT) AS queue_pos
FROM digital_service_requests""", "digital_service_requests"))
def request_queue(t):
    return flat(D.request_queue(t))


@register("pending_top5", with_views(f"""
SELECT * FROM (
  SELECT {_REQ},
         CAST(row_number() OVER (PARTITION BY service_type ORDER BY requested_at DESC, id DESC) AS BIGINT) AS position
  FROM digital_service_requests WHERE status = 'Pending') WHERE position <= 5""", "digital_service_requests"))
def pending_top5(t):
    return flat(D.pending_top(t, 5))


@register("recent_requests", with_views(f"""
SELECT {_REQ} FROM digital_service_requests
WHERE status <> 'Pending'
  AND (CASE WHEN status = 'Completed' THEN completed_at ELSE failed_at END) IS NOT NULL
  AND {local_day("CASE WHEN status = 'Completed' THEN completed_at ELSE failed_at END")} = DATE '{AS_OF}'
ORDER BY requested_at ASC, id ASC LIMIT 10""", "digital_service_requests"))
def recent_requests(t):
    return flat(D.recent_resolved(t, AS_OF, 10))


@register("request_fingerprint", with_views("""
SELECT id, concat_ws(':', CAST(id AS VARCHAR), status, COALESCE(reference_no, ''),
                     COALESCE(strftime(completed_at, '%Y-%m-%d %H:%M:%S'), ''),
                     COALESCE(strftime(failed_at, '%Y-%m-%d %H:%M:%S'), ''), COALESCE(failed_reason, '')) AS fingerprint
FROM digital_service_requests""", "digital_service_requests"))
def request_fingerprint(t):
    return flat(D.request_fingerprints(t))


@register("board_fingerprint", with_views("""
WITH keys AS (SELECT md5(concat_ws(':', CAST(id AS VARCHAR), status, COALESCE(reference_no, ''),
                     COALESCE(strftime(completed_at, '%Y-%m-%d %H:%M:%S'), ''),
                     COALESCE(strftime(failed_at, '%Y-%m-%d %H:%M:%S'), ''), COALESCE(failed_reason, ''))) AS digest
              FROM digital_service_requests)
SELECT CAST(count(*) AS BIGINT) AS requests,
       CAST(CAST(sum(CAST('0x' || substr(digest, 1, 12) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS sum_1,
       CAST(CAST(sum(CAST('0x' || substr(digest, 13, 12) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS sum_2
FROM keys""", "digital_service_requests"))
def board_fingerprint(t):
    """AG14 whole-board key."""
    return flat(D.board_fingerprint(t))


def notifications_sql(as_of: str) -> str:
    """ST4 feed for ``as_of`` as SQL (without the canonical views)."""
    return f"""
WITH {_INV_STATUS.strip()}, {_sales_nums(as_of).strip()},
pend AS (SELECT count(*) FILTER (WHERE status = 'Pending' AND service_type = 'eload') AS e,
                count(*) FILTER (WHERE status = 'Pending' AND service_type = 'gcash') AS g,
                count(*) FILTER (WHERE status = 'Pending') AS tot FROM digital_service_requests)
SELECT CAST(1 AS BIGINT) AS position, 'primary' AS tone, 'Pending digital requests' AS title,
       concat_ws(' and ', CASE WHEN e > 0 THEN CAST(e AS VARCHAR) || ' eLoad' END,
                          CASE WHEN g > 0 THEN CAST(g AS VARCHAR) || ' GCash' END)
         || ' request' || CASE WHEN tot = 1 THEN '' ELSE 's' END || ' waiting to be completed.' AS message,
       '/eload' AS link
FROM pend WHERE tot > 0
UNION ALL
SELECT 2, 'warning', 'Low stock items',
       CAST(low_stock AS VARCHAR) || ' item' || CASE WHEN low_stock = 1 THEN '' ELSE 's' END || ' need restocking soon.',
       '/inventory?status=Low%20Stock'
FROM inv WHERE low_stock > 0
UNION ALL
SELECT 3, 'danger', 'Out of stock',
       CAST(out_of_stock AS VARCHAR) || ' item' || CASE WHEN out_of_stock = 1 THEN '' ELSE 's' END || ' are unavailable right now.',
       '/inventory?status=Out%20of%20Stock'
FROM inv WHERE out_of_stock > 0
UNION ALL
SELECT 4, 'success', 'Today''s sales',
       '₱' || format('{{:,.2f}}', CAST(today_total AS DOUBLE)) || ' across ' || CAST(today_transactions AS VARCHAR)
         || ' transaction' || CASE WHEN today_transactions = 1 THEN '' ELSE 's' END || '.',
       CAST(NULL AS VARCHAR)
FROM sm"""


@register("notifications", with_views(notifications_sql(AS_OF), "digital_service_requests", "inventory_items", "sales"))
def notifications(t):
    return flat(DB.notifications(t, AS_OF))


PREV_DAY = shift_days(AS_OF, -1)


@register("alerts_new", with_views(f"""
WITH cur AS ({notifications_sql(AS_OF)}),
prev AS ({notifications_sql(PREV_DAY)})
SELECT * FROM cur
WHERE NOT EXISTS (SELECT 1 FROM prev WHERE prev.title = cur.title AND prev.message = cur.message
                  AND prev.tone = cur.tone AND prev.link IS NOT DISTINCT FROM cur.link)""",
                                   "digital_service_requests", "inventory_items", "sales"))
def alerts_new(t):
    """ST5: today's alerts that were not already shown yesterday."""
    from tillpoint.streaming.alerts import new_alerts
    return flat(new_alerts(DB.notifications(t, AS_OF), DB.notifications(t, PREV_DAY)))


SEARCH_QUERY = " Staff 1 "


@register("log_search", with_views(f"""
WITH {_LOGS_DIGITAL}, {_RPL.strip()},
every AS (
  SELECT 'product' AS kind, transaction_code AS code, lower(transaction_code || ' ' || COALESCE(employee_name, '')) AS search_text
  FROM rpl WHERE sale_date = DATE '{LOG_DAY}'
  UNION ALL
  SELECT 'eload', request_code, lower(request_code || ' ' || COALESCE(number, '') || ' ' || COALESCE(requested_by, '') || ' ' || COALESCE(completed_by, ''))
  FROM day_logs WHERE service_type = 'eload'
  UNION ALL
  SELECT 'gcash', request_code, lower(request_code || ' ' || COALESCE(number, '') || ' ' || COALESCE(reference_no, '') || ' '
                                      || COALESCE(requested_by, '') || ' ' || COALESCE(completed_by, ''))
  FROM day_logs WHERE service_type = 'gcash')
SELECT * FROM every WHERE contains(search_text, '{SEARCH_QUERY.strip().lower()}')""",
                                   "digital_service_requests", "sales", "sale_items"))
def log_search(t):
    """FL6: search the day's logs."""
    return flat(D.log_search(t, LOG_DAY, SEARCH_QUERY))
