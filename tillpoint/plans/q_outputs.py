"""Registered catalogue, export, recommendation, cart and snapshot queries
(SC6, JN6, NE3, SK1-SK3, QY12, AG15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.functions.dates import shift_days
from tillpoint.operators import recommend as RC
from tillpoint.plans.present import flat, positioned
from tillpoint.plans.registry import register
from tillpoint.plans.sqlviews import with_views
from tillpoint.session import cut_lineage
from tillpoint.sinks import export as X
from tillpoint.sinks import snapshot as SN
from tillpoint.sinks import versions as VR
from tillpoint.sources import catalog as C
from tillpoint.streaming.live_totals import scratch_path

AS_OF = P.AS_OF
WEEK_FROM = shift_days(AS_OF, -6)

def _promos_sql() -> str:
    rows, pid = [], 0
    for nid, (net, promos) in enumerate(C.DEFAULT_NETWORKS.items(), start=1):
        for promo in promos:
            pid += 1
            rows.append(f"({nid}, '{net}', {pid}, '{promo}')")
    return ("promos AS (SELECT network_id, network_name, promo_id, promo_name, "
            "CAST(COALESCE(CAST(regexp_extract_all(promo_name, '(\\d+(\\.\\d+)?)', 1)[-1] AS DOUBLE), 0.0) "
            "AS DECIMAL(18,2)) AS selling_price "
            f"FROM (VALUES {', '.join(rows)}) v(network_id, network_name, promo_id, promo_name))")


_NETS_SQL = """nets AS (SELECT upper(trim(network)) AS network_name, count(*) AS requests
        FROM digital_service_requests WHERE service_type = 'eload' GROUP BY 1)"""


@register("eload_default_prices", with_views(f"""
WITH {_promos_sql()}, {_NETS_SQL}
SELECT CAST(p.network_id AS BIGINT) AS network_id, p.network_name, CAST(p.promo_id AS BIGINT) AS promo_id, p.promo_name,
       CAST(p.selling_price AS DOUBLE) AS selling_price,
       CAST(COALESCE(n.requests, 0) AS BIGINT) AS requests
FROM promos p LEFT JOIN nets n ON n.network_name = p.network_name""", "digital_service_requests"))
def eload_default_prices(t):
    """SC6: the seeded catalogue priced from promo names, with how many
    requests each network has in the data."""
    promos = C.default_promos(t.spark)
    nets = C.networks_in_use(t.digital_service_requests)
    return flat(promos.join(nets, "network_name", "left")
                .select("network_id", "network_name", "promo_id", "promo_name", "selling_price",
                        F.coalesce("requests", F.lit(0)).alias("requests")))


@register("eload_catalog", with_views(f"""
WITH {_promos_sql()}, {_NETS_SQL}
SELECT n.network_name, CAST(n.requests AS BIGINT) AS requests, CAST(p.promo_id AS BIGINT) AS promo_id, p.promo_name,
       CAST(p.selling_price AS DOUBLE) AS selling_price,
       CAST(row_number() OVER (ORDER BY lower(n.network_name), lower(p.promo_name), p.promo_id) AS BIGINT) AS position
FROM nets n LEFT JOIN promos p ON p.network_name = n.network_name""", "digital_service_requests"))
def eload_catalog(t):
    """JN6 flattened: networks in use with their promos (kept when none)."""
    return flat(positioned(C.catalog_flat(t.digital_service_requests, C.default_promos(t.spark)),
                           ["network_name", "promo_id"], C.catalog_order(), ["promo_name"]))


_PROMO_TEXT_SQL = f"""
WITH {_promos_sql()}, {_NETS_SQL},
texts AS (SELECT network_name, string_agg(CAST(promo_id AS VARCHAR) || ':' || promo_name || ':' || CAST(selling_price AS VARCHAR), '; '
                                          ORDER BY lower(promo_name), promo_id) AS promos FROM promos GROUP BY 1)"""


def _promo_text(promos):
    item = lambda p: F.concat_ws(":", p["promo_id"].cast("string"), p["name"], p["price"].cast("string"))
    return F.array_join(F.transform(promos, item), "; ")


@register("eload_catalog_nested", with_views(f"""{_PROMO_TEXT_SQL}
SELECT network_name, CAST(requests AS BIGINT) AS requests, coalesce(promos, '') AS promos FROM nets LEFT JOIN texts USING (network_name)""",
                                            "digital_service_requests"))
def eload_catalog_nested(t):
    """NE3: networks with their ``promos`` arrays, printed as text."""
    n = C.catalog_nested(t.digital_service_requests, C.default_promos(t.spark))
    return flat(n.withColumn("promos", _promo_text(F.col("promos"))))


@register("eload_catalog_map", with_views(f"""{_PROMO_TEXT_SQL}
SELECT string_agg(network_name || ' => ' || coalesce(promos, ''), ' | ' ORDER BY network_name) AS catalog
FROM nets LEFT JOIN texts USING (network_name)""", "digital_service_requests"))
def eload_catalog_map(t):
    """NE3 dictionary: one row, network -> promos, printed as text."""
    m = C.catalog_map(t.digital_service_requests, C.default_promos(t.spark))
    entries = F.array_sort(F.transform(F.map_entries("catalog"), lambda e: F.concat(e["key"], F.lit(" => "), _promo_text(e["value"]))))
    return m.select(F.array_join(entries, " | ").alias("catalog"))


def _csv(x: str) -> str:
    return (f"CASE WHEN regexp_matches(COALESCE({x}, ''), '[\",\\n]') "
            f"THEN '\"' || replace(COALESCE({x}, ''), '\"', '\"\"') || '\"' ELSE COALESCE({x}, '') END")


def _num(x: str) -> str:
    return (f"CASE WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) "
            f"ELSE rtrim(CAST(CAST({x} AS DECIMAL(38,2)) AS VARCHAR), '0') END")


_STATUS = """CASE WHEN lower(trim(coalesce(status, ''))) IN ('low stock', 'low-stock') THEN 'Low Stock'
     WHEN lower(trim(coalesce(status, ''))) IN ('out of stock', 'out-of-stock') THEN 'Out of Stock' ELSE 'In Stock' END"""


@register("inventory_export", with_views(f"""
SELECT id, concat_ws(',', {_csv('barcode')}, {_csv('name')}, {_csv('category')}, {_csv('supplier')},
                     CAST(stock_quantity AS VARCHAR), {_num('unit_price')}, {_num('selling_price')},
                     CAST(reorder_level AS VARCHAR), {_csv(_STATUS)}) AS line
FROM inventory_items""", "inventory_items"))
def inventory_export(t):
    """SK1 lines (the writer is ``sinks.export.export_inventory_csv``)."""
    return flat(X.inventory_lines(t).select("id", "line"))


@register("sales_export", with_views(f"""
WITH lines AS (
  SELECT sale_id, 0 AS kind, line_no, item_name, quantity FROM sale_items
  UNION ALL
  SELECT sale_id, 1, NULL, load_value, quantity FROM sale_digital_items),
items AS (SELECT sale_id, string_agg(item_name || ' x' || CAST(quantity AS VARCHAR), '; '
                                     ORDER BY kind, line_no, item_name, quantity) AS txt
          FROM lines GROUP BY sale_id)
SELECT s.id, concat_ws(',', {_csv('s.transaction_code')}, strftime(s.sale_date, '%Y-%m-%d'),
                       {_csv('s.payment_method')}, {_num('s.total_amount')}, {_csv('i.txt')}) AS line
FROM sales s LEFT JOIN items i ON i.sale_id = s.id""", "sales", "sale_items", "sale_digital_items"))
def sales_export(t):
    """SK2 lines (the writer is ``sinks.export.export_sales_csv``)."""
    return flat(X.sales_lines(t).select("id", "line"))


@register("snapshot_manifest", with_views(
    " UNION ALL ".join(f"SELECT '{n}' AS \"table\", CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS rows_now, CAST(1 AS BIGINT) AS ok FROM {n}"
                       for n in SN.SNAPSHOT_TABLES), *SN.SNAPSHOT_TABLES))
def snapshot_manifest(t):
    """SK3: write a snapshot of every table, then verify it from the files."""
    folder = scratch_path(t.spark, "snapshot")
    SN.write_snapshot(t, folder, AS_OF)
    return flat(SN.verify_snapshot(t.spark, folder).select("table", "rows", "rows_now", "ok"))


def _flip_byte(spark, name: str) -> None:
    """Change one byte in the middle of a (small) file."""
    content = bytearray(spark.read.format("binaryFile").load(name).first()["content"])
    content[len(content) // 2] ^= 1
    VR.Files(spark, name).write(name, bytes(content))


_KEPT = ("inventory_items", "sales", "categories", "suppliers")


@register("snapshot_damage", with_views(" UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", CAST({int(n == 'categories')} AS BIGINT) AS damaged, CAST(1 AS BIGINT) AS intact_before, CAST(1 AS BIGINT) AS refused FROM (SELECT 1)"
    for n in _KEPT)))
def snapshot_damage(t):
    """SK3: a dated snapshot whose file hashes agree; after one byte of the categories'
    file is flipped, exactly that table has a damaged file and restoring is refused."""
    folder = SN.dated_snapshot(t, scratch_path(t.spark, "snapshots"), AS_OF, _KEPT)
    before = cut_lineage(SN.verify_files(t.spark, folder).groupBy("table").agg(F.min(F.col("state") == "ok").alias("intact_before")))
    name = t.spark.read.format("binaryFile").load(f"{folder}/categories").select("path").orderBy(F.desc("path")).first()["path"]
    _flip_byte(t.spark, name)
    try:
        SN.restore(t.spark, folder, VR.VersionedTables(t.spark, scratch_path(t.spark, "versions")))
        refused = False
    except SN.DamagedSnapshot as found:
        refused = name.rsplit("/", 1)[-1] in str(found)
    after = SN.verify_files(t.spark, folder).groupBy("table").agg(F.count_if(F.col("state") == "damaged").alias("damaged"))
    return flat(after.join(before, "table").withColumn("refused", F.lit(refused)))


@register("snapshot_restore", with_views("""
SELECT id, barcode, name, category, supplier, CAST(stock_quantity AS BIGINT) AS stock_quantity,
       CAST(selling_price AS DOUBLE) AS selling_price FROM inventory_items""", "inventory_items"))
def snapshot_restore(t):
    """SK3: the inventory as restored from a dated snapshot after it was emptied."""
    root = scratch_path(t.spark, "versions")
    store = VR.commit_tables(t.spark, root, t, ("inventory_items", "categories"))
    folder = SN.dated_snapshot(store.at(), f"{root}/backup", AS_OF, ("inventory_items", "categories"))
    store.commit(1, {"inventory_items": store.at().inventory_items.limit(0)}, "reset")
    version = SN.restore(t.spark, folder, store)
    return flat(store.at(version).inventory_items.select("id", "barcode", "name", "category", "supplier", "stock_quantity", "selling_price"))


_BIG_SALES = """big AS (SELECT id, total_amount * 1000 + 0.05 AS total_amount FROM sales)"""


@register("export_large_amounts", with_views(f"""
WITH {_BIG_SALES}
SELECT id, {_num('total_amount')} AS amount FROM big""", "sales"))
def export_large_amounts(t):
    """SK2: amounts above ten million are printed in plain digits."""
    from tillpoint.functions.text import js_number_text
    return t.sales.select("id", js_number_text(F.col("total_amount") * 1000 + F.lit("0.05").cast("decimal(4,2)")).alias("amount"))


_STATUS_ID = _STATUS.replace("status", "ii.status")


@register("reco_lists", with_views(f"""
WITH avail AS (SELECT id, name FROM inventory_items WHERE {_STATUS} <> 'Out of Stock'),
scored AS (SELECT si.inventory_item_id AS id, si.quantity, s.sale_date, s.id AS sale_id,
                  strftime(s.sale_date, '%Y%m%d') || lpad(CAST(s.id AS VARCHAR), 20, '0') AS k
           FROM sale_items si JOIN sales s ON s.id = si.sale_id
           WHERE si.inventory_item_id IN (SELECT id FROM avail)),
agg AS (SELECT id,
               SUM(quantity) FILTER (WHERE sale_date = DATE '{AS_OF}') AS today_score,
               max(k) FILTER (WHERE sale_date = DATE '{AS_OF}') AS today_k,
               SUM(quantity) FILTER (WHERE sale_date >= DATE '{WEEK_FROM}') AS week_score,
               max(k) FILTER (WHERE sale_date >= DATE '{WEEK_FROM}') AS week_k,
               SUM(quantity * 3 + greatest(1, 14 - greatest(0, DATE '{AS_OF}' - sale_date))) AS smart_score,
               max(k) AS smart_k
        FROM scored GROUP BY id),
lists AS (
  SELECT 'today' AS list, id, today_score AS score, today_k AS k FROM agg WHERE today_score IS NOT NULL
  UNION ALL SELECT 'week', id, week_score, week_k FROM agg WHERE week_score IS NOT NULL
  UNION ALL SELECT 'smart', id, smart_score, smart_k FROM agg WHERE smart_score IS NOT NULL),
ranked AS (SELECT list, l.id, a.name, CAST(score AS BIGINT) AS score,
                  CAST(row_number() OVER (PARTITION BY list ORDER BY score DESC, k DESC, l.id ASC) AS BIGINT) AS position
           FROM lists l JOIN avail a ON a.id = l.id)
SELECT * FROM ranked
WHERE position <= CASE WHEN list = 'smart' THEN 8 ELSE 6 END
UNION ALL
SELECT 'smart', id, name, CAST(NULL AS BIGINT),
       CAST(row_number() OVER (ORDER BY name, id) AS BIGINT)
FROM avail WHERE (SELECT count(*) FROM agg WHERE smart_score IS NOT NULL) = 0
QUALIFY row_number() OVER (ORDER BY name, id) <= 8""", "inventory_items", "sale_items", "sales"))
def reco_lists(t):
    """QY12: today / week / smart recommendation lists."""
    return flat(RC.recommendations(t, AS_OF))


@register("cart_totals", with_views("""
WITH lines AS (
  SELECT sale_id, quantity, price FROM sale_items
  UNION ALL SELECT sale_id, quantity, price FROM sale_digital_items)
SELECT sale_id AS cart_id, CAST(SUM(quantity * price) AS DOUBLE) AS amount, CAST(count(*) AS BIGINT) AS lines,
       CAST(SUM(quantity) AS BIGINT) AS units
FROM lines GROUP BY sale_id""", "sale_items", "sale_digital_items"))
def cart_totals(t):
    """AG15: totals per cart payload."""
    return flat(RC.cart_totals(t))
