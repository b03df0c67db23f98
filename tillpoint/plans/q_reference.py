"""Registered changes of reference data and schemas (DM7, DM9, DM10) with their oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.jobs import migrations as MG
from tillpoint.jobs import reference as RF
from tillpoint.plans.present import flat
from tillpoint.plans.registry import register
from tillpoint.plans.sqlviews import with_views
from tillpoint.sinks import versions as VR
from tillpoint.streaming.live_totals import scratch_path

#: What the tables lacked before the migrations (schema_migrate).
OLD = {"inventory_items": ("supplier", "status", "barcode"), "sales": ("employee_name",), "users": ("is_active",),
       "digital_service_requests": ("failed_reason", "failed_by_name", "failed_at"), "suppliers": ("contact_no", "address"),
       "user_devices": ("pin_enabled",)}


@register("schema_migrate", with_views("""
SELECT 'inventory_items' AS table_name, id, 'supplier' AS column_name, '' AS value FROM inventory_items
UNION ALL SELECT 'inventory_items', id, 'status', CASE WHEN stock_quantity <= 0 THEN 'Out of Stock'
                 WHEN stock_quantity <= reorder_level THEN 'Low Stock' ELSE 'In Stock' END FROM inventory_items
UNION ALL SELECT 'inventory_items', id, 'barcode', 'LEGACY-' || CAST(id AS VARCHAR) FROM inventory_items
UNION ALL SELECT 'sales', id, 'employee_name', 'System' FROM sales
UNION ALL SELECT 'users', id, 'is_active', '1' FROM users
UNION ALL SELECT 'digital_service_requests', id, c, CASE WHEN c <> 'failed_at' THEN '' END
          FROM digital_service_requests, (VALUES ('failed_reason'), ('failed_by_name'), ('failed_at')) v(c)
UNION ALL SELECT 'suppliers', supplier_id, c, '' FROM suppliers, (VALUES ('contact_no'), ('address')) v(c)
UNION ALL SELECT 'user_devices', id, 'pin_enabled', '0' FROM user_devices""",
                                       "inventory_items", "sales", "users", "digital_service_requests", "suppliers", "user_devices"))
def schema_migrate(t):
    """DM9: tables from before their later columns are stored, migrated as one commit
    and read back: one row for each value that a migration filled in. The second run
    finds the schema version and commits nothing."""
    store = VR.VersionedTables(t.spark, scratch_path(t.spark, "migrate"))
    store.commit(0, {name: getattr(t, name).drop(*columns) for name, columns in OLD.items()}, "load")
    version, _ = MG.migrate(store)
    if MG.migrate(store) != (version, []) or store.current() != version:
        raise AssertionError("a second run changed the tables")
    view = store.at(version)
    return flat(reduce(DataFrame.unionAll, [_filled(getattr(view, n), n, c) for n, c in OLD.items()]))


def _filled(df: DataFrame, table: str, columns) -> DataFrame:
    key = df.columns[0]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.lit(table).alias("table_name"), F.col(key).alias("id"), F.inline(pairs))


# a promo an item: its network is one of eight, names repeat across networks only
_PROMOS_SQL = """promos AS (SELECT p_partkey AS promo_id, p_size % 8 AS network_id, 'N' || CAST(p_size % 8 AS VARCHAR) AS network_name,
                  'Load ' || CAST(p_partkey AS VARCHAR) AS promo_name, CAST(p_retailprice AS DECIMAL(18,2)) AS selling_price FROM part)"""


def _promos(t) -> DataFrame:
    network = F.col("p_size") % 8
    return t.raw("part").select(
        network.alias("network_id"), F.concat(F.lit("N"), network.cast("string")).alias("network_name"), F.col("p_partkey").alias("promo_id"),
        F.concat(F.lit("Load "), F.col("p_partkey").cast("string")).alias("promo_name"), F.col("p_retailprice").cast("decimal(18,2)").alias("selling_price"))


@register("network_removed", f"""
WITH {_PROMOS_SQL}
SELECT promo_id, CAST(network_id AS BIGINT) AS network_id, promo_name, CAST(selling_price AS DOUBLE) AS selling_price FROM promos
WHERE network_id NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 2 = 0)""")
def network_removed(t):
    """DM7: networks that are removed (named many times over) take their promos along."""
    removed = t.raw("customer").where("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("network_id"))
    return flat(RF.remove_networks(removed, _promos(t)).select("promo_id", "network_id", "promo_name", "selling_price"))


@register("promo_changes", f"""
WITH {_PROMOS_SQL},
chg AS (SELECT o_orderkey AS change_id, o_custkey * 2 AS promo_id,
               CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE 'Load ' || CAST(o_custkey * 2 + o_orderkey % 30 AS VARCHAR) END AS name,
               CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE floor(o_totalprice / 100) END AS price FROM orders),
chk AS (SELECT c.*, p.network_id, CASE WHEN p.promo_id IS NULL THEN 'Promo not found.' WHEN c.name = '' THEN 'Promo name is required.'
               WHEN c.price <= 0 THEN 'Selling price must be greater than zero.'
               WHEN h.promo_id <> c.promo_id THEN '{RF.MSG_PROMO_EXISTS}' END AS e0
        FROM chg c LEFT JOIN promos p ON p.promo_id = c.promo_id
        LEFT JOIN promos h ON h.network_id = p.network_id AND h.promo_name = c.name),
taker AS (SELECT network_id, name, arg_min(promo_id, change_id) AS promo_id FROM chk WHERE e0 IS NULL GROUP BY 1, 2),
res AS (SELECT c.*, CASE WHEN e0 IS NOT NULL THEN e0 WHEN t.promo_id <> c.promo_id THEN '{RF.MSG_PROMO_EXISTS}' END AS error
        FROM chk c LEFT JOIN taker t ON t.network_id = c.network_id AND t.name = c.name AND c.e0 IS NULL),
last AS (SELECT promo_id, arg_max(name, change_id) AS name, arg_max(price, change_id) AS price FROM res WHERE error IS NULL GROUP BY 1)
SELECT 'promo' AS kind, p.promo_id AS id, coalesce(l.name, p.promo_name) AS promo_name,
       CAST(coalesce(l.price, p.selling_price) AS DOUBLE) AS selling_price, CAST(NULL AS VARCHAR) AS error
FROM promos p LEFT JOIN last l USING (promo_id)
UNION ALL SELECT 'reject', change_id, NULL, NULL, error FROM res WHERE error IS NOT NULL""")
def promo_changes(t):
    """DM10: a batch of promo changes (one an order): unknown, blank, free and taken
    ones are refused, the last accepted change of a promo stays."""
    changes = t.raw("orders").select(
        F.col("o_orderkey").alias("change_id"), (F.col("o_custkey") * 2).alias("promo_id"),
        F.when(F.col("o_orderpriority").startswith("5"), F.lit(" "))
         .otherwise(F.concat(F.lit(" Load "), (F.col("o_custkey") * 2 + F.col("o_orderkey") % 30).cast("string"))).alias("promo_name"),
        F.when(F.col("o_orderstatus") == "P", F.lit("0")).otherwise(F.floor(F.col("o_totalprice") / 100).cast("string")).alias("selling_price"))
    after, rejects = RF.update_promos(changes, _promos(t))
    kept = after.select(F.lit("promo").alias("kind"), F.col("promo_id").alias("id"), "promo_name", "selling_price")
    refused = rejects.select(F.lit("reject").alias("kind"), F.col("change_id").alias("id"), "error")
    return flat(kept.unionByName(refused, allowMissingColumns=True))


@register("promo_removed", f"""
WITH {_PROMOS_SQL}, gone AS (SELECT DISTINCT o_custkey * 3 AS promo_id FROM orders)
SELECT promo_id, CAST(NULL AS VARCHAR) AS error FROM promos WHERE promo_id NOT IN (SELECT promo_id FROM gone)
UNION ALL SELECT promo_id, 'Promo not found.' FROM gone WHERE promo_id NOT IN (SELECT promo_id FROM promos)""")
def promo_removed(t):
    """DM10: the promos that stay, and the removals that name none."""
    removed = t.raw("orders").select((F.col("o_custkey") * 3).alias("promo_id"))
    left, missing = RF.remove_promos(removed, _promos(t))
    return flat(left.select("promo_id").unionByName(missing, allowMissingColumns=True))


@register("settings_updated", """
SELECT CAST(1 AS BIGINT) AS id, coalesce(max_by(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END, CASE WHEN o_orderstatus = 'O' THEN o_orderkey END), 'Shop') AS store_name,
       CAST(coalesce(max_by(o_orderkey % 2, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey END), 1) AS BIGINT) AS low_stock_alert,
       CAST(0 AS BIGINT) AS weekly_sales_alert FROM orders""")
def settings_updated(t):
    """DM10: the settings row after a log of changes: each column keeps its latest value."""
    settings = t.raw("region").where("r_regionkey = 0").selectExpr("1 AS id", "'Shop' AS store_name", "1 AS low_stock_alert", "0 AS weekly_sales_alert")
    changes = t.raw("orders").selectExpr("o_orderkey AS ts", "CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS store_name",
                                         "CASE WHEN o_custkey % 3 = 0 THEN CAST(o_orderkey % 2 AS INT) END AS low_stock_alert")
    return flat(RF.update_settings(settings, changes))
