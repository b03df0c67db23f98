"""Adapters: driver tables -> the shop's canonical tables (FIXTURES §3).

The driver's folder holds TPC-H-style tables; the shop's reports read
these views instead. Each function returns a lazy DataFrame; money is
DECIMAL(18,2) so every sum is exact and independent of row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.functions.normalize import derive_legacy_status, padded_code, sale_code
from tillpoint.operators.windows import next_within_key

MONEY = "decimal(18,2)"


def _shift():
    return F.expr(f"INTERVAL {P.REQUEST_SHIFT_DAYS} DAYS")
# -- fixed values: adapter choices ------------------------------------------
_GCASH_EVENTS = ("purchase", "signup")
_NETWORK_BY_USER_MOD6 = ("TM", "GLOBE", "SMART", "TNT", "SUN", "DITO")
_REORDER_LEVEL = 10
_STAFF_COUNT = 5


def sales(t) -> DataFrame:
    o = t.raw("orders")
    c = t.raw("customer")
    return (o.join(c, o.o_custkey == c.c_custkey, "inner")
             .select(o.o_orderkey.alias("id"),
                     sale_code(o.o_orderkey).alias("transaction_code"),
                     o.o_orderdate.cast("date").alias("sale_date"),
                     o.o_orderpriority.alias("payment_method"),
                     c.c_name.alias("employee_name"),
                     o.o_totalprice.cast(MONEY).alias("total_amount"),
                     o.o_orderdate.alias("created_at")))


def inventory_items(t) -> DataFrame:
    p = t.raw("part")
    s = t.raw("supplier")
    # one scalar subquery (a distributed count), evaluated in a projection
    # before the equi-join, not a cross join
    n_suppliers = s.select(F.count(F.lit(1))).scalar()
    qty = (F.col("p_size") - 1).cast("int")
    unit = F.col("p_retailprice").cast(MONEY)
    keyed = p.withColumn("_supp_key", F.col("p_partkey") % n_suppliers)
    return (keyed.join(s.select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("_supp_key"), "inner")
             .select(F.col("p_partkey").alias("id"),
                     F.concat(F.lit("480"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("barcode"),
                     F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")")).alias("name"),
                     F.col("p_type").alias("category"),
                     F.col("s_name").alias("supplier"),
                     derive_legacy_status(qty, F.lit(_REORDER_LEVEL)).alias("status"),
                     qty.alias("stock_quantity"),
                     unit.alias("unit_price"),
                     (unit + (F.col("p_partkey") % 20).cast(MONEY)).cast(MONEY).alias("selling_price"),
                     F.lit(_REORDER_LEVEL).alias("reorder_level")))


def sale_items(t) -> DataFrame:
    li = t.raw("lineitem")
    p = t.raw("part")
    qty = li.l_quantity.cast("int")
    price = p.p_retailprice.cast(MONEY)
    return (li.join(p, p.p_partkey == li.l_partkey, "inner")
              .select(li.l_orderkey.alias("sale_id"),
                      li.l_partkey.alias("inventory_item_id"),
                      F.concat(p.p_name, F.lit(" ("), p.p_brand, F.lit(")")).alias("item_name"),
                      li.l_linenumber.alias("line_no"),
                      qty.alias("quantity"),
                      price.alias("price"),
                      (qty * price).cast(MONEY).alias("total")))


def _is_gcash_event():
    return F.col("event_type").isin(*_GCASH_EVENTS)


def _network_of_user():
    m = F.col("user_id") % 6
    expr = F.when(m == 0, F.lit(_NETWORK_BY_USER_MOD6[0]))
    for i, name in enumerate(_NETWORK_BY_USER_MOD6[1:-1], start=1):
        expr = expr.when(m == i, F.lit(name))
    return expr.otherwise(F.lit(_NETWORK_BY_USER_MOD6[-1]))


def _mobile_of_user():
    return F.concat(F.lit("09"), F.lpad(F.col("user_id").cast("string"), 9, "0"))


def digital_service_requests(t) -> DataFrame:
    return requests_from_events(t.raw("events"))


def requests_from_events(e: DataFrame) -> DataFrame:
    """The request adapter over any events DataFrame, batch or streaming."""
    gcash = _is_gcash_event()
    tail = F.col("event_id") % 10
    done = tail < 8
    shifted = F.col("ts") - _shift()
    whole_value = F.floor(F.col("value")).cast("bigint").cast("string")
    return e.select(
        F.col("event_id").alias("id"),
        F.when(gcash, padded_code("GC", F.col("event_id"))).otherwise(padded_code("EL", F.col("event_id"))).alias("request_code"),
        F.when(gcash, F.lit("gcash")).otherwise(F.lit("eload")).alias("service_type"),
        F.when(tail == 9, F.lit(P.PENDING)).when(tail == 8, F.lit(P.FAILED)).otherwise(F.lit(P.COMPLETED)).alias("status"),
        _mobile_of_user().alias("mobile_number"),
        F.col("value").cast(MONEY).alias("amount"),
        F.when(~gcash, F.lit("")).when(F.col("event_id") % 2 == 0, F.lit("Cash In")).otherwise(F.lit("Cash Out")).alias("request_kind"),
        F.when(gcash, F.lit("")).otherwise(_network_of_user()).alias("network"),
        F.when(gcash, F.lit("")).otherwise(F.lit("regular")).alias("load_type"),
        F.when(gcash, F.lit("")).otherwise(F.concat(F.lit("Regular "), whole_value)).alias("load_value"),
        F.when(gcash & done, F.concat(F.lit("REF"), F.col("event_id").cast("string"))).otherwise(F.lit("")).alias("reference_no"),
        F.lit("").alias("notes"),
        F.concat(F.lit("Staff "), (F.col("user_id") % _STAFF_COUNT).cast("string")).alias("requested_by_name"),
        shifted.alias("requested_at"),
        F.when(done, F.concat(F.lit("Staff "), ((F.col("user_id") + 1) % _STAFF_COUNT).cast("string"))).otherwise(F.lit("")).alias("completed_by_name"),
        F.when(done, shifted + F.expr("INTERVAL 2 HOURS")).alias("completed_at"),
        F.when(tail == 8, F.lit("no signal")).otherwise(F.lit("")).alias("failed_reason"),
        F.when(tail == 8, F.concat(F.lit("Staff "), ((F.col("user_id") + 2) % _STAFF_COUNT).cast("string"))).otherwise(F.lit("")).alias("failed_by_name"),
        F.when(tail == 8, shifted + F.expr("INTERVAL 1 HOURS")).alias("failed_at"),
    )


def sale_digital_items(t) -> DataFrame:
    e = t.raw("events")
    o = t.raw("orders")
    # o_orderkey is the orders key, so the inner join keeps each event at most
    # once: a semi join says the same thing without carrying order columns.
    eload = e.filter(~_is_gcash_event())
    return (eload.join(o, eload.event_id == o.o_orderkey, "left_semi")
                 .select(F.col("event_id").alias("sale_id"),
                         F.lit("eload").alias("service_type"),
                         padded_code("EL", F.col("event_id")).alias("request_code"),
                         _network_of_user().alias("network"), F.lit("regular").alias("load_type"), F.lit("").alias("notes"),
                         F.concat(F.lit("Regular "), F.floor(F.col("value")).cast("bigint").cast("string")).alias("load_value"),
                         _mobile_of_user().alias("mobile_number"),
                         F.lit(1).alias("quantity"),
                         F.col("value").cast(MONEY).alias("price"),
                         F.col("value").cast(MONEY).alias("total")))


def users(t) -> DataFrame:
    c = t.raw("customer")
    return c.select(F.col("c_custkey").alias("id"),
                    F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("username"),
                    F.col("c_name").alias("full_name"),
                    F.when(F.col("c_custkey") % 10 == 0, F.lit("Admin")).otherwise(F.lit("User")).alias("role"),
                    F.when(F.col("c_custkey") % 7 == 0, F.lit(0)).otherwise(F.lit(1)).alias("is_active"))


def user_devices(t) -> DataFrame:
    signups = (t.raw("events").filter(F.col("event_type") == "signup")
               .select("event_id", "user_id", "ts"))
    with_next = next_within_key(signups, "user_id", "ts", "event_id", "revoked_at")
    return with_next.select(F.col("event_id").alias("id"), "user_id",
                            F.lit("Chrome on Android").alias("device_name"),
                            (F.col("event_id") % 2).cast("int").alias("pin_enabled"),
                            F.col("ts").alias("created_at"), F.col("ts").alias("last_used_at"),
                            (F.col("ts") + F.expr("INTERVAL 20 DAYS")).alias("expires_at"),
                            "revoked_at")


def auth_attempts(t) -> DataFrame:
    e = t.raw("events").filter(F.col("event_type").isin("error", "signup"))
    return e.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("key"),
                    "ts", (F.col("event_type") == "signup").alias("success"))


def suppliers(t) -> DataFrame:
    return t.raw("supplier").select(F.col("s_suppkey").alias("supplier_id"),
                                    F.col("s_name").alias("supplier_name"),
                                    F.lit("").alias("contact_no"), F.lit("").alias("address"))


def categories(t) -> DataFrame:
    """Distinct part types; the id is the smallest part key of the type
    (an aggregate, so no global numbering window is needed)."""
    return (t.raw("part").groupBy(F.col("p_type").alias("category_name"))
            .agg(F.min("p_partkey").alias("category_id"))
            .select("category_id", "category_name"))
