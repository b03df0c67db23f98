"""Digital service requests (eLoad / GCash): SC4, SC5, SU1, AG8, AG9,
AG12, AG14, SO4, SO5, SO7, FL8, NE2.

Requests carry UTC timestamps; their local day is UTC + 8 h. Day
predicates are written as ranges on the bare timestamp column
(``local_day_range``) so they can reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.functions.dates import (date_lit, local_day, local_day_is, local_day_range,
                                       month_length, month_start, next_month_start, shift_days)
from tillpoint.operators.sales import calendar, report_product_logs
from tillpoint.operators.windows import global_row_number

def _zero():
    return F.lit(0).cast("decimal(18,2)")


def _report_view(t, service: str) -> DataFrame:
    r = t.digital_service_requests.filter(F.col("service_type") == service)
    stamp = F.coalesce(F.col("completed_at"), F.col("requested_at"))
    common = [F.col("id").alias("request_id"), F.col("request_code").alias("transaction_code"),
              F.col("mobile_number").alias("number")]
    tail = [F.col("amount"),
            F.coalesce(F.col("completed_by_name"), F.col("requested_by_name"), F.lit("System")).alias("employee_name"),
            local_day(stamp).alias("sale_date"), stamp.alias("time_stamp"), "status",
            "requested_by_name", "requested_at", "completed_by_name", "completed_at", "failed_reason"]
    if service == "eload":
        middle = [F.col("network"),
                  F.coalesce(F.col("load_value"), F.col("request_kind"), F.lit("")).alias("item_name")]
    else:
        middle = [F.col("reference_no"), F.col("request_kind")]
    return r.select(*common, *middle, *tail)


def report_eload_logs(t) -> DataFrame:
    """SC4: eLoad requests as log rows (``''`` is not NULL: plain coalesce)."""
    return _report_view(t, "eload")


def report_gcash_logs(t) -> DataFrame:
    """SC5: GCash requests as log rows."""
    return _report_view(t, "gcash")


DIGITAL_LOG_COLUMNS = ("request_code", "service_type", "status", "number", "amount", "request_kind",
                       "network", "load_type", "load_value", "reference_no", "requested_by",
                       "requested_at", "completed_by", "completed_at")


def log_order(stamp: str):
    """SO9: logs newest first, the later id first at one time."""
    return [F.col(stamp).desc(), F.col("log_id").desc()]


def product_log_order():
    """SO9 for the flattened product logs: each log's lines in their order."""
    return [*log_order("time_stamp"), F.col("line_no").asc(), F.col("product_id").asc()]


def logs_digital(t, day: str) -> DataFrame:
    """SU1 / SO9: eLoad and GCash logs under one schema, requested on local ``day``,
    newest first."""
    e = report_eload_logs(t).select(
        F.col("request_id").alias("log_id"),
        F.col("transaction_code").alias("request_code"), F.lit("eload").alias("service_type"), "status",
        "number", "amount", F.lit("").alias("request_kind"), "network", F.lit("").alias("load_type"),
        F.col("item_name").alias("load_value"), F.lit("").alias("reference_no"),
        F.col("requested_by_name").alias("requested_by"), "requested_at",
        F.col("completed_by_name").alias("completed_by"), "completed_at")
    g = report_gcash_logs(t).select(
        F.col("request_id").alias("log_id"),
        F.col("transaction_code").alias("request_code"), F.lit("gcash").alias("service_type"), "status",
        "number", "amount", "request_kind", F.lit("").alias("network"), F.lit("").alias("load_type"),
        F.lit("").alias("load_value"), "reference_no",
        F.col("requested_by_name").alias("requested_by"), "requested_at",
        F.col("completed_by_name").alias("completed_by"), "completed_at")
    return e.unionByName(g).filter(local_day_is(F.col("requested_at"), day)).orderBy(*log_order("requested_at"))


def logs_products(t, day: str) -> DataFrame:
    """NE2 flattened: the day's product logs, one row per line, with the
    line amount recomputed as quantity x price."""
    logs = report_product_logs(t, F.col("sale_date") == date_lit(day))
    lines = t.sale_items.join(logs.select(F.col("log_id").alias("sale_id")), "sale_id", "left_semi")
    return (logs.join(lines, logs.log_id == lines.sale_id, "inner")
                .select("log_id", "transaction_code", "sale_date", "employee_name", "time_stamp",
                        "total_amount", F.col("inventory_item_id").alias("product_id"), "item_name",
                        "line_no", "quantity", F.col("price").alias("selling_price"),
                        (F.col("quantity") * F.col("price")).cast("decimal(18,2)").alias("amount"))
                .orderBy(*product_log_order()))


def logs_products_nested(t, day: str) -> DataFrame:
    """NE2: the day's product logs, newest first, each with its ``products`` array
    (bounded by the log's lines)."""
    line = F.struct("line_no", "product_id", "item_name", "quantity", "selling_price", "amount")
    head = ["log_id", "transaction_code", "sale_date", "employee_name", "time_stamp", "total_amount"]
    return (logs_products(t, day).groupBy(*head).agg(F.array_sort(F.collect_list(line)).alias("products"))
            .orderBy(*log_order("time_stamp")))


def logs_summary(t, day: str) -> DataFrame:
    """AG8: counts and amounts of the day's logs, one row.

    Pending requests count only in the totals. The product part is a scalar
    subquery over the product logs.
    """
    logs = logs_digital(t, day)
    st = F.lower(F.coalesce(F.col("status"), F.lit("")))
    prod = report_product_logs(t, F.col("sale_date") == date_lit(day))
    prod_count = prod.select(F.count(F.lit(1))).scalar()
    prod_total = prod.select(F.coalesce(F.sum("total_amount"), _zero())).scalar()
    aggs = [prod_count.alias("product_count"), prod_total.alias("product_total")]
    for svc in ("eload", "gcash"):
        is_svc = F.col("service_type") == svc
        for label, cond in (("", F.lit(True)), ("_completed", st == "completed"), ("_failed", st == "failed")):
            hit = is_svc & cond
            aggs.append(F.count_if(hit).alias(f"{svc}{label}_count"))
            aggs.append(F.coalesce(F.sum(F.when(hit, F.col("amount"))), _zero()).alias(f"{svc}{label}_total"))
    return logs.agg(*aggs)


def chart_month(t, as_of: str) -> DataFrame:
    """AG9 / FL8: every day of ``as_of``'s calendar month with GCash, Load and
    Products totals (zero filled). Digital amounts count once completed, on
    the local day of completion."""
    first, nxt, n = month_start(as_of), next_month_start(as_of), month_length(as_of)
    in_month = (F.col("sale_date") >= date_lit(first)) & (F.col("sale_date") < date_lit(nxt))
    prod = (report_product_logs(t, in_month)
            .groupBy(F.col("sale_date").alias("day")).agg(F.sum("total_amount").alias("products")))
    svc = F.lower(F.coalesce(F.col("service_type"), F.lit("")))
    dig = (t.digital_service_requests
           .filter((F.col("status") == P.COMPLETED) & F.col("completed_at").isNotNull()
                   & local_day_range(F.col("completed_at"), first, nxt))
           .groupBy(local_day(F.col("completed_at")).alias("day"))
           .agg(F.sum(F.when(svc == "gcash", F.col("amount"))).alias("gcash"),
                F.sum(F.when(svc == "eload", F.col("amount"))).alias("load")))
    cal = calendar(t.spark, first, n)
    return (cal.join(dig, "day", "left").join(prod, "day", "left")
               .select(F.dayofmonth("day").alias("day_of_month"), "day",
                       F.coalesce("gcash", _zero()).alias("gcash"),
                       F.coalesce("load", _zero()).alias("load"),
                       F.coalesce("products", _zero()).alias("products")))


def month_totals(t, as_of: str) -> DataFrame:
    """AG11: the month chart's column sums and their combined total."""
    c = chart_month(t, as_of)
    return c.agg(F.sum("gcash").alias("monthly_gcash"), F.sum("load").alias("monthly_load"),
                 F.sum("products").alias("monthly_products"),
                 (F.sum("gcash") + F.sum("load") + F.sum("products")).alias("monthly_sales"))


def pending_counts(t) -> DataFrame:
    """AG12: pending requests per service, one row."""
    r = t.digital_service_requests
    pending = F.col("status") == P.PENDING
    return r.agg(F.count_if(pending & (F.col("service_type") == "eload")).alias("eload_pending"),
                 F.count_if(pending & (F.col("service_type") == "gcash")).alias("gcash_pending"),
                 F.count_if(pending).alias("total_pending"))


def queue_order():
    return [F.when(F.col("status") == P.PENDING, 0).otherwise(1).asc(),
            F.col("requested_at").desc(), F.col("id").desc()]


def request_queue(t) -> DataFrame:
    """SO4: the whole board in queue order, with its position."""
    r = t.digital_service_requests
    # number the sort keys only; the wide rows join their position
    keys = global_row_number(r.select("id", "status", "requested_at"), queue_order(), "queue_pos").select("id", "queue_pos")
    return r.join(keys, "id")


def pending_top(t, k: int = 5) -> DataFrame:
    """SO5: the first ``k`` pending requests per service (newest first).

    ``row_number <= k`` per service plans as a WindowGroupLimit, which also
    cuts each map partition to ``k`` rows per service before the shuffle, so a
    service holding most requests does not land whole in one task.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("service_type").orderBy(F.col("requested_at").desc(), F.col("id").desc())
    return (t.digital_service_requests.filter(F.col("status") == P.PENDING)
            .withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k))


def recent_resolved(t, as_of: str, k: int = 10) -> DataFrame:
    """SO7: requests resolved on local ``as_of``; the reference reverses the
    newest-first list and keeps ten, i.e. the ten *earliest requested*."""
    # one range on each bare time column, so that the filter reaches the scan
    nxt = shift_days(as_of, 1)
    done = (F.col("status") == P.COMPLETED) & local_day_range(F.col("completed_at"), as_of, nxt)
    other = ~F.col("status").isin(P.COMPLETED, P.PENDING) & local_day_range(F.col("failed_at"), as_of, nxt)
    return (t.digital_service_requests.filter(done | other)
            .orderBy(F.col("requested_at").asc(), F.col("id").asc()).limit(k))


def request_fingerprints(t) -> DataFrame:
    """AG14: per-request change key ``id:status:ref:completed:failed:reason``."""
    return fingerprints_of(t.digital_service_requests)


def board_fingerprint(t) -> DataFrame:
    """AG14 whole-board key: the count and two order-free sums of 48 bits of each
    row key's MD5 (sums, so that equal rows do not cancel out)."""
    digest = F.md5("fingerprint")

    def part(start):
        return F.sum(F.conv(F.substring(digest, start, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return request_fingerprints(t).agg(F.count(F.lit(1)).alias("requests"), part(1).alias("sum_1"), part(13).alias("sum_2"))


def log_search(t, day: str, query: str) -> DataFrame:
    """FL6: the day's product, eLoad and GCash logs whose search text
    (lower-cased, per kind) contains the trimmed, lower-cased query."""
    needle = query.strip().lower()

    def text(*cols):
        return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))
    products = report_product_logs(t, F.col("sale_date") == date_lit(day)).select(
        F.lit("product").alias("kind"), F.col("transaction_code").alias("code"),
        text("transaction_code", "employee_name").alias("search_text"))
    logs = logs_digital(t, day)
    eload = logs.filter(F.col("service_type") == "eload").select(
        F.lit("eload").alias("kind"), F.col("request_code").alias("code"),
        text("request_code", "number", "requested_by", "completed_by").alias("search_text"))
    gcash = logs.filter(F.col("service_type") == "gcash").select(
        F.lit("gcash").alias("kind"), F.col("request_code").alias("code"),
        text("request_code", "number", "reference_no", "requested_by", "completed_by").alias("search_text"))
    every = products.unionByName(eload).unionByName(gcash)
    return every if not needle else every.filter(F.col("search_text").contains(needle))


def fingerprints_of(requests: DataFrame) -> DataFrame:
    """AG14 per-request keys for any requests table (see ``request_fingerprints``)."""
    def txt(c):
        return F.coalesce(F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    fp = F.concat_ws(":", F.col("id").cast("string"), F.col("status"),
                     F.coalesce(F.col("reference_no"), F.lit("")), txt("completed_at"), txt("failed_at"),
                     F.coalesce(F.col("failed_reason"), F.lit("")))
    return requests.select("id", fp.alias("fingerprint"))


def fingerprint_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """AG14 diff: requests added, removed or changed between two boards (a
    full outer join on id of the two fingerprint sets)."""
    b = fingerprints_of(before).withColumnRenamed("fingerprint", "before")
    a = fingerprints_of(after).withColumnRenamed("fingerprint", "after")
    change = (F.when(F.col("before").isNull(), F.lit("added"))
               .when(F.col("after").isNull(), F.lit("removed"))
               .when(F.col("before") != F.col("after"), F.lit("changed")))
    return b.join(a, "id", "full").withColumn("change", change).filter(F.col("change").isNotNull())
