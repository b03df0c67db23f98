"""Registered checks of the scalar functions FN1-FN20.

Each applies a function family to columns of a whole canonical table
(plus spelling variants derived from those columns), so the work grows
with the data; results are grouped by distinct input where the input
repeats.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.functions import dates as FD
from tillpoint.functions import normalize as FN
from tillpoint.functions import text as FT
from tillpoint.plans.present import flat
from tillpoint.plans.registry import register
from tillpoint.plans.sqlviews import with_views


def _status_variants():
    s = F.col("status")
    return F.array(s, F.lower(s), F.regexp_replace(F.lower(s), " ", "-"),
                   F.concat(F.lit("  "), F.upper(s), F.lit(" ")), F.col("category"))


_SQL_STATUS_VARIANTS = ("[status, lower(status), replace(lower(status), ' ', '-'), "
                        "'  ' || upper(status) || ' ', category]")


def _sql_norm_status(x: str) -> str:
    return (f"CASE WHEN lower(trim(coalesce({x}, ''))) IN ('low stock', 'low-stock') THEN 'Low Stock' "
            f"WHEN lower(trim(coalesce({x}, ''))) IN ('out of stock', 'out-of-stock') THEN 'Out of Stock' "
            f"ELSE 'In Stock' END")


@register("fn_item_status", with_views(f"""
SELECT raw, {_sql_norm_status('raw')} AS normalized, CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest({_SQL_STATUS_VARIANTS}) AS raw FROM inventory_items) GROUP BY 1, 2""", "inventory_items"))
def fn_item_status(t):
    raw = t.inventory_items.select(F.explode(_status_variants()).alias("raw"))
    return flat(raw.groupBy("raw", FN.normalize_item_status(F.col("raw")).alias("normalized"))
                .agg(F.count(F.lit(1)).alias("n")))


@register("fn_legacy_status", with_views("""
SELECT CAST(stock_quantity AS BIGINT) AS stock_quantity, CAST(id % 15 AS BIGINT) AS reorder_level,
       CASE WHEN stock_quantity <= 0 THEN 'Out of Stock' WHEN stock_quantity <= id % 15 THEN 'Low Stock'
            ELSE 'In Stock' END AS status, CAST(count(*) AS BIGINT) AS n
FROM inventory_items GROUP BY 1, 2, 3""", "inventory_items"))
def fn_legacy_status(t):
    i = t.inventory_items.select("stock_quantity", (F.col("id") % 15).alias("reorder_level"))
    return flat(i.groupBy("stock_quantity", "reorder_level",
                          FN.derive_legacy_status(F.col("stock_quantity"), F.col("reorder_level")).alias("status"))
                .agg(F.count(F.lit(1)).alias("n")))


_FILTER_EXTRAS_SQL = "['Low/Out of Stock', ' low-out-of-stock ', 'low / out of stock', 'in-stock', 'Today', ' WEEK', 'month', 'all', '']"
_FILTER_EXTRAS = ["Low/Out of Stock", " low-out-of-stock ", "low / out of stock", "in-stock", "Today", " WEEK",
                  "month", "all", ""]


@register("fn_filters", with_views(f"""
WITH raw AS (SELECT unnest({_SQL_STATUS_VARIANTS} || {_FILTER_EXTRAS_SQL}) AS raw FROM inventory_items),
f AS (SELECT raw, lower(trim(coalesce(raw, 'all'))) AS x FROM raw)
SELECT raw,
       CASE WHEN x IN ('in stock', 'in-stock') THEN 'In Stock' WHEN x IN ('low stock', 'low-stock') THEN 'Low Stock'
            WHEN x IN ('out of stock', 'out-of-stock') THEN 'Out of Stock'
            WHEN x IN ('low/out of stock', 'low-out-of-stock', 'low / out of stock') THEN 'Low/Out of Stock'
            ELSE 'all' END AS inventory_filter,
       CASE WHEN x IN ('all', 'today', 'week', 'month') THEN x ELSE 'all' END AS sales_filter,
       CAST(count(*) AS BIGINT) AS n
FROM f GROUP BY 1, 2, 3""", "inventory_items"))
def fn_filters(t):
    arr = F.concat(_status_variants(), F.array(*[F.lit(x) for x in _FILTER_EXTRAS]))
    raw = t.inventory_items.select(F.explode(arr).alias("raw"))
    return flat(raw.groupBy("raw", FN.normalize_inventory_filter(F.col("raw")).alias("inventory_filter"),
                            FN.normalize_sales_filter(F.col("raw")).alias("sales_filter"))
                .agg(F.count(F.lit(1)).alias("n")))


@register("fn_role", with_views("""
SELECT raw, CASE WHEN lower(trim(coalesce(raw, ''))) = 'user' THEN 'User' ELSE 'Admin' END AS role,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest([role, lower(role), ' ' || upper(role) || ' ', full_name]) AS raw FROM users) GROUP BY 1, 2""",
                                "users"))
def fn_role(t):
    r = F.col("role")
    raw = t.users.select(F.explode(F.array(r, F.lower(r), F.concat(F.lit(" "), F.upper(r), F.lit(" ")),
                                           F.col("full_name"))).alias("raw"))
    return flat(raw.groupBy("raw", FN.normalize_role(F.col("raw")).alias("role")).agg(F.count(F.lit(1)).alias("n")))


@register("fn_service", with_views("""
SELECT raw, CASE WHEN lower(trim(coalesce(raw, ''))) = 'gcash' THEN 'gcash' ELSE 'eload' END AS service,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest([service_type, upper(service_type), ' ' || service_type, request_kind]) AS raw
      FROM digital_service_requests) GROUP BY 1, 2""", "digital_service_requests"))
def fn_service(t):
    s = F.col("service_type")
    raw = t.digital_service_requests.select(
        F.explode(F.array(s, F.upper(s), F.concat(F.lit(" "), s), F.col("request_kind"))).alias("raw"))
    return flat(raw.groupBy("raw", FN.normalize_service_type(F.col("raw")).alias("service"))
                .agg(F.count(F.lit(1)).alias("n")))


def _sql_code(prefix: str, k: str) -> str:
    return f"'{prefix}' || CASE WHEN {k} < 10000 THEN lpad(CAST({k} AS VARCHAR), 4, '0') ELSE CAST({k} AS VARCHAR) END"


@register("fn_codes", with_views(f"""
SELECT id, {_sql_code('S', 'id')} AS sale_code, {_sql_code('GC', 'id * 7')} AS gcash_code,
       {_sql_code('EL', 'id * 7')} AS eload_code
FROM sales""", "sales"))
def fn_codes(t):
    s = t.sales
    return flat(s.select("id", FN.sale_code(F.col("id")).alias("sale_code"),
                         FN.request_code(F.lit("GCash"), F.col("id") * 7).alias("gcash_code"),
                         FN.request_code(F.lit("eload"), F.col("id") * 7).alias("eload_code")))


@register("fn_normalize", with_views("""
SELECT id, trim('  ' || username || ' ') AS barcode_form, lower(trim(' ' || upper(username))) AS identity,
       CASE WHEN trim(CASE WHEN id % 4 = 0 THEN '   ' ELSE ' 10.0.' || CAST(id AS VARCHAR) || ' ' END) = '' THEN 'unknown'
            ELSE trim(CASE WHEN id % 4 = 0 THEN '   ' ELSE ' 10.0.' || CAST(id AS VARCHAR) || ' ' END) END AS rate_key
FROM users""", "users"))
def fn_normalize(t):
    u = t.users
    addr = F.when(F.col("id") % 4 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit(" 10.0."), F.col("id").cast("string"), F.lit(" ")))
    return flat(u.select("id",
                         FN.normalize_barcode(F.concat(F.lit("  "), F.col("username"), F.lit(" "))).alias("barcode_form"),
                         FN.normalize_identity(F.concat(F.lit(" "), F.upper(F.col("username")))).alias("identity"),
                         FN.rate_limit_key(addr).alias("rate_key")))


_RX_NUM = r"'(\d+(\.\d+)?)'"
_RX_WHOLE = r"'(\d+)'"


@register("fn_last_number", with_views(f"""
WITH raw AS (SELECT unnest([name, load_value]) AS raw FROM
               (SELECT name, '' AS load_value FROM inventory_items
                UNION ALL SELECT '', load_value FROM digital_service_requests))
SELECT raw,
       COALESCE(CAST(regexp_extract_all(raw, {_RX_NUM}, 1)[-1] AS DOUBLE), 0.0) AS last_number,
       COALESCE(CAST(regexp_extract_all(raw, {_RX_WHOLE}, 1)[-1] AS DOUBLE), 0.0) AS last_whole,
       CAST(count(*) AS BIGINT) AS n
FROM raw GROUP BY 1""", "inventory_items", "digital_service_requests"))
def fn_last_number(t):
    names = t.inventory_items.select(F.col("name").alias("raw"))
    loads = t.digital_service_requests.select(F.col("load_value").alias("raw"))
    blanks = t.inventory_items.select(F.lit("").alias("raw")).unionByName(
        t.digital_service_requests.select(F.lit("").alias("raw")))
    raw = names.unionByName(loads).unionByName(blanks)
    return flat(raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
                .select("raw", FT.last_number(F.col("raw")).alias("last_number"),
                        FT.last_number(F.col("raw"), whole_digits_only=True).alias("last_whole"), "n"))


_RX_VAR = r"'\(([^()]*)\)\s*$'"


def _sql_variant_ok(x: str) -> str:
    return (f"regexp_matches({x}, {_RX_VAR}) AND trim(regexp_extract({x}, {_RX_VAR}, 1)) <> '' "
            f"AND rtrim(regexp_replace({x}, {_RX_VAR}, '')) <> ''")


@register("product_variants", with_views(f"""
WITH raw AS (SELECT unnest([name, name || '  ', '(' || category || ')', category || ' ()',
                            category || ' (a) b']) AS raw FROM inventory_items)
SELECT raw,
       CASE WHEN {_sql_variant_ok('raw')} THEN rtrim(regexp_replace(raw, {_RX_VAR}, '')) ELSE raw END AS display_name,
       CASE WHEN {_sql_variant_ok('raw')} THEN trim(regexp_extract(raw, {_RX_VAR}, 1)) ELSE '' END AS display_variant,
       CAST(count(*) AS BIGINT) AS n
FROM raw GROUP BY 1""", "inventory_items"))
def product_variants(t):
    n, c = F.col("name"), F.col("category")
    raw = t.inventory_items.select(F.explode(F.array(
        n, F.concat(n, F.lit("  ")), F.concat(F.lit("("), c, F.lit(")")), F.concat(c, F.lit(" ()")),
        F.concat(c, F.lit(" (a) b")))).alias("raw"))
    g = raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    parts = FT.product_name_parts(F.col("raw"))
    return flat(g.select("raw", parts["name"].alias("display_name"), parts["variant"].alias("display_variant"), "n"))


@register("fn_mobile", with_views(r"""
WITH raw AS (SELECT id, unnest([mobile_number, substr(mobile_number, 1, 4) || '-' || substr(mobile_number, 5, 3) || '-' || substr(mobile_number, 8),
                                 mobile_number || '5', substr(mobile_number, 2), '']) AS raw
             FROM digital_service_requests),
d AS (SELECT id, raw, substr(regexp_replace(raw, '\D', '', 'g'), 1, 11) AS digits FROM raw)
SELECT raw,
       CASE WHEN length(digits) = 11 AND starts_with(digits, '09')
            THEN substr(digits, 1, 4) || ' ' || substr(digits, 5, 3) || ' ' || substr(digits, 8, 4) ELSE '' END AS formatted,
       concat_ws(' ', CASE WHEN length(digits) > 0 THEN substr(digits, 1, 4) END,
                      CASE WHEN length(digits) > 4 THEN substr(digits, 5, 3) END,
                      CASE WHEN length(digits) > 7 THEN substr(digits, 8, 4) END) AS partial,
       CAST(count(*) AS BIGINT) AS n
FROM d GROUP BY 1, 2, 3""", "digital_service_requests"))
def fn_mobile(t):
    m = F.col("mobile_number")
    dashed = F.concat(F.substring(m, 1, 4), F.lit("-"), F.substring(m, 5, 3), F.lit("-"), F.expr("substr(mobile_number, 8)"))
    raw = t.digital_service_requests.select(F.explode(F.array(
        m, dashed, F.concat(m, F.lit("5")), F.expr("substr(mobile_number, 2)"), F.lit(""))).alias("raw"))
    return flat(raw.groupBy("raw", FT.ph_mobile(F.col("raw")).alias("formatted"),
                            FT.ph_mobile_partial(F.col("raw")).alias("partial"))
                .agg(F.count(F.lit(1)).alias("n")))


@register("fn_local_day", with_views("""
SELECT id, strftime(CAST(requested_at + INTERVAL 8 HOUR AS DATE), '%Y-%m-%d') AS local_day,
       COALESCE(strftime(completed_at + INTERVAL 8 HOUR, '%b %-d, %Y, %-I:%M %p'), '-') AS completed_local
FROM digital_service_requests""", "digital_service_requests"))
def fn_local_day(t):
    r = t.digital_service_requests
    return flat(r.select("id", FD.local_day(F.col("requested_at")).alias("local_day"),
                         FD.local_timestamp_text(F.col("completed_at")).alias("completed_local")))


@register("fn_labels", with_views("""
SELECT id, strftime(sale_date, '%a') AS weekday, strftime(sale_date, '%b') AS month,
       strftime(sale_date, '%b %-d, %Y') AS long_date,
       '₱' || format('{:,.2f}', CAST(total_amount AS DOUBLE)) AS amount_text,
       CASE WHEN length(employee_name || ' shop') > 20 THEN substr(employee_name || ' shop', 1, 20) || '...'
            ELSE employee_name || ' shop' END AS short_name
FROM sales""", "sales"))
def fn_labels(t):
    s = t.sales
    return flat(s.select("id", FT.weekday_short(F.col("sale_date")).alias("weekday"),
                         FT.month_short(F.col("sale_date")).alias("month"),
                         FT.long_date(F.col("sale_date")).alias("long_date"),
                         FT.php_currency(F.col("total_amount")).alias("amount_text"),
                         FT.short_label(F.concat(F.col("employee_name"), F.lit(" shop"))).alias("short_name")))


def _agent_expr():
    """User-agent strings built from the events (one per event)."""
    m = F.col("user_id") % 6
    platform = (F.when(m == 0, F.lit("Linux; Android 14")).when(m == 1, F.lit("iPhone; CPU iPhone OS 17_0"))
                 .when(m == 2, F.lit("Windows NT 10.0; Win64")).when(m == 3, F.lit("Macintosh; Intel Mac OS X 14_0"))
                 .when(m == 4, F.lit("X11; Linux x86_64")).otherwise(F.lit("PlayStation")))
    b = F.col("event_id") % 5
    browser = (F.when(b == 0, F.lit("Chrome/120.0 Safari/537.36")).when(b == 1, F.lit("Firefox/121.0"))
                .when(b == 2, F.lit("Chrome/120.0 Safari/537.36 Edg/120.0")).when(b == 3, F.lit("Version/17.0 Safari/605.1"))
                .otherwise(F.lit("curl/8.0")))
    return F.concat(F.lit("Mozilla/5.0 ("), platform, F.lit(") "), browser)


_SQL_AGENT = """'Mozilla/5.0 (' || CASE user_id % 6 WHEN 0 THEN 'Linux; Android 14' WHEN 1 THEN 'iPhone; CPU iPhone OS 17_0'
  WHEN 2 THEN 'Windows NT 10.0; Win64' WHEN 3 THEN 'Macintosh; Intel Mac OS X 14_0' WHEN 4 THEN 'X11; Linux x86_64'
  ELSE 'PlayStation' END || ') ' || CASE event_id % 5 WHEN 0 THEN 'Chrome/120.0 Safari/537.36' WHEN 1 THEN 'Firefox/121.0'
  WHEN 2 THEN 'Chrome/120.0 Safari/537.36 Edg/120.0' WHEN 3 THEN 'Version/17.0 Safari/605.1' ELSE 'curl/8.0' END"""


@register("fn_user_agent", f"""
WITH ua AS (SELECT lower({_SQL_AGENT}) AS v, {_SQL_AGENT} AS agent FROM events)
SELECT agent,
       CASE WHEN contains(v, 'edg/') THEN 'Edge' WHEN contains(v, 'firefox/') THEN 'Firefox'
            WHEN contains(v, 'chrome/') OR contains(v, 'crios/') THEN 'Chrome' WHEN contains(v, 'safari/') THEN 'Safari'
            ELSE 'Browser' END || ' on ' ||
       CASE WHEN contains(v, 'android') THEN 'Android' WHEN contains(v, 'iphone') OR contains(v, 'ipad') THEN 'iOS'
            WHEN contains(v, 'windows') THEN 'Windows' WHEN contains(v, 'mac os') THEN 'macOS'
            WHEN contains(v, 'linux') THEN 'Linux' ELSE 'this device' END AS device_name,
       CAST(count(*) AS BIGINT) AS n
FROM ua GROUP BY 1, 2""")
def fn_user_agent(t):
    ua = t.raw("events").select(_agent_expr().alias("agent"))
    return flat(ua.groupBy("agent", FT.device_name_from_agent(F.col("agent")).alias("device_name"))
                .agg(F.count(F.lit(1)).alias("n")))


@register("fn_load_value", with_views("""
WITH e AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'promo' ELSE 'regular' END AS load_type,
                  'GO+' || CAST(CAST(floor(amount) AS BIGINT) AS VARCHAR) || ' ' || network AS promo_name,
                  CAST(amount AS DOUBLE) AS amt
           FROM digital_service_requests WHERE service_type = 'eload')
SELECT id,
       CASE WHEN load_type = 'promo' THEN promo_name
            WHEN amt <> 0 THEN 'Regular ' || CASE WHEN amt = floor(amt) THEN CAST(CAST(floor(amt) AS BIGINT) AS VARCHAR)
                                                  ELSE CAST(amt AS VARCHAR) END
            ELSE '' END AS load_value,
       CASE WHEN load_type = 'promo' THEN COALESCE(CAST(regexp_extract_all(promo_name, '(\\d+)', 1)[-1] AS DOUBLE), 0.0)
            ELSE amt END AS amount
FROM e""".replace("\\\\", "\\"), "digital_service_requests"))
def fn_load_value(t):
    r = t.digital_service_requests.filter(F.col("service_type") == "eload")
    load_type = F.when(F.col("id") % 2 == 0, F.lit("promo")).otherwise(F.lit("regular"))
    promo = F.concat(F.lit("GO+"), F.floor(F.col("amount")).cast("bigint").cast("string"), F.lit(" "), F.col("network"))
    lv = FT.load_value_and_amount(load_type, promo, F.lit(None).cast("double"), F.col("amount"))
    return flat(r.select("id", lv["load_value"].alias("load_value"), lv["amount"].alias("amount")))
