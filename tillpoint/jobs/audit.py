"""DM8: integrity audit.

Spark enforces no UNIQUE, FOREIGN KEY or partial-unique index, so the
reference's constraints become counts. Each table is read once and emits
``(rule, key, child, parent)`` rows for every rule that it takes part in; one
aggregation by (rule, key), combined on the map side, settles all rules:

* a uniqueness rule is broken by each key with more than one child row (rows
  without a key are one key),
* a reference is broken by each child row whose key has no parent row.

Sale totals are compared in a join of their own, with one row a sale.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.normalize import ascii_lower, js_trim

UNIQUE = ("duplicate_inventory_id", "duplicate_barcode", "duplicate_sale_id", "duplicate_transaction_code",
          "duplicate_request_id", "duplicate_request_code", "duplicate_category_name_nocase",
          "duplicate_supplier_name", "duplicate_username_nocase", "duplicate_network_name_nocase",
          "multiple_active_devices", "duplicate_promo_of_network")
REFERENCE = ("orphan_sale_item_sale", "orphan_sale_item_product", "orphan_digital_item_sale", "orphan_device_user",
             "unknown_inventory_category", "promo_price_not_positive")
TOTALS = "sale_total_not_lines"
_NUMBER = {rule: i for i, rule in enumerate(UNIQUE + REFERENCE)}


def _entry(rule: str, key: Column, child: int, parent: int, when: Column | None = None) -> Column:
    row = F.struct(F.lit(_NUMBER[rule]).alias("rule"), key.cast("string").alias("key"),
                   F.lit(child).alias("child"), F.lit(parent).alias("parent"))
    return row if when is None else F.when(when, row)


def unique(rule: str, key: Column, when: Column | None = None) -> Column:
    """A row whose key must be its own (among the rows that meet ``when``)."""
    return _entry(rule, key, 1, 0, when)


def refers(rule: str, key: Column) -> Column:
    """A row that needs a parent with this key, unless it has none."""
    return _entry(rule, key, 1, 0, key.isNotNull())


def referred(rule: str, key: Column) -> Column:
    """A row that is the parent of this key."""
    return _entry(rule, key, 0, 1)


def violations_by_key(parts: list[tuple[DataFrame, list[Column]]]) -> DataFrame:
    """``(rule number, n)`` of the rules that have entries: one aggregate over the
    entries of all tables, each read once however many rules it takes part in."""
    rows = [df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*")
            for df, entries in parts]
    keys = reduce(DataFrame.unionByName, rows).groupBy("rule", "key").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
    broken = F.when(F.col("rule") < len(UNIQUE), (F.col("c") > 1).cast("long")).otherwise(F.when(F.col("p") == 0, F.col("c")).otherwise(0))
    return keys.groupBy("rule").agg(F.sum(broken).alias("n"))


def mismatched_totals(sales: DataFrame, lines: DataFrame, digital: DataFrame) -> DataFrame:
    """Sales whose total is not the sum of their lines, as one count."""
    per_sale = (lines.select("sale_id", "total").unionByName(digital.select("sale_id", "total"))
                .groupBy("sale_id").agg(F.sum("total").alias("_lines_total")))
    return (sales.select("id", "total_amount").join(per_sale, F.col("id") == F.col("sale_id"), "left")
            .agg(F.count_if(F.col("total_amount") != F.coalesce(F.col("_lines_total"), F.lit(0))).alias("n")))


def integrity_audit(t, promos: DataFrame) -> DataFrame:
    """``(rule, violations)``, one row a rule, those that hold included."""
    c = F.col
    settled = violations_by_key([
        (t.inventory_items, [unique("duplicate_inventory_id", c("id")), unique("duplicate_barcode", js_trim(c("barcode"))),
                             referred("orphan_sale_item_product", c("id")), refers("unknown_inventory_category", c("category"))]),
        (t.sales, [unique("duplicate_sale_id", c("id")), unique("duplicate_transaction_code", c("transaction_code")),
                   referred("orphan_sale_item_sale", c("id")), referred("orphan_digital_item_sale", c("id"))]),
        (t.sale_items, [refers("orphan_sale_item_sale", c("sale_id")), refers("orphan_sale_item_product", c("inventory_item_id"))]),
        (t.sale_digital_items, [refers("orphan_digital_item_sale", c("sale_id"))]),
        (t.digital_service_requests, [unique("duplicate_request_id", c("id")), unique("duplicate_request_code", c("request_code"))]),
        (t.categories, [unique("duplicate_category_name_nocase", ascii_lower(c("category_name"))),
                        referred("unknown_inventory_category", c("category_name"))]),
        (t.suppliers, [unique("duplicate_supplier_name", c("supplier_name"))]),
        (t.users, [unique("duplicate_username_nocase", F.lower(c("username"))), referred("orphan_device_user", c("id"))]),
        (t.user_devices, [refers("orphan_device_user", c("user_id")),
                          unique("multiple_active_devices", c("user_id"), c("revoked_at").isNull())]),
        (promos, [unique("duplicate_promo_of_network", F.to_json(F.struct("network_id", "promo_name"))),
                  _entry("promo_price_not_positive", c("promo_name"), 1, 0, c("selling_price") <= 0)]),
        (promos.select("network_name").distinct(), [unique("duplicate_network_name_nocase", F.lower(c("network_name")))]),
    ])
    totals = mismatched_totals(t.sales, t.sale_items, t.sale_digital_items).select(F.lit(len(_NUMBER)).alias("rule"), "n")
    names = F.array(*[F.lit(r) for r in (*_NUMBER, TOTALS)])
    rules = settled.sparkSession.range(len(_NUMBER) + 1).select(F.col("id").cast("int").alias("rule"), names[F.col("id").cast("int")].alias("name"))
    return (rules.join(settled.unionByName(totals), "rule", "left")
            .select(F.col("name").alias("rule"), F.coalesce("n", F.lit(0)).cast("bigint").alias("violations")))
