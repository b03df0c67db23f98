"""Registered inventory queries (QY1, QY11, FL1-FL4, AG1, SO1, SO2, SO6, JN8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.operators import inventory as I
from tillpoint.plans.present import flat, positioned
from tillpoint.plans.registry import register
from tillpoint.plans.sqlviews import with_views

# -- fixed values: parameters of the registered inventory queries ------------
SEARCH_TERM = "brand#1"
POS_TERM = "bolt"
POS_CATEGORY = "SMALL"
LOOKUP_BARCODE = " 4800000000042 "

_RX = r"'\(([^()]*)\)\s*$'"
_STATUS = """CASE WHEN lower(trim(coalesce(status, ''))) IN ('low stock', 'low-stock') THEN 'Low Stock'
            WHEN lower(trim(coalesce(status, ''))) IN ('out of stock', 'out-of-stock') THEN 'Out of Stock'
            ELSE 'In Stock' END"""
_BASE = f"""id, barcode, name, category, supplier, {_STATUS} AS status,
       CAST(stock_quantity AS BIGINT) AS stock_quantity, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(selling_price AS DOUBLE) AS selling_price, CAST(reorder_level AS BIGINT) AS reorder_level,
       CAST(selling_price - unit_price AS DOUBLE) AS profit"""
_DISPLAY_OK = (f"regexp_matches(name, {_RX}) AND trim(regexp_extract(name, {_RX}, 1)) <> '' "
               f"AND rtrim(regexp_replace(name, {_RX}, '')) <> ''")
_DISPLAY = (f"CASE WHEN {_DISPLAY_OK} THEN rtrim(regexp_replace(name, {_RX}, '')) ELSE name END AS display_name, "
            f"CASE WHEN {_DISPLAY_OK} THEN trim(regexp_extract(name, {_RX}, 1)) ELSE '' END AS display_variant")
_SEARCH = (f"(name ILIKE '%{SEARCH_TERM}%' OR category ILIKE '%{SEARCH_TERM}%' "
           f"OR supplier ILIKE '%{SEARCH_TERM}%' OR barcode ILIKE '%{SEARCH_TERM}%')")


@register("scan_inventory", with_views(f"SELECT {_BASE} FROM inventory_items", "inventory_items"))
def scan_inventory(t):
    return flat(I.with_derived(t.inventory_items.select(*I.ITEM_COLUMNS)))


@register("inventory_list", with_views(f"""
WITH base AS (SELECT {_BASE} FROM inventory_items WHERE {_SEARCH})
SELECT *, {_DISPLAY}, CAST(row_number() OVER (ORDER BY name, id) AS BIGINT) AS position FROM base""", "inventory_items"))
def inventory_list(t):
    """QY1 / SO1: the searched list with each item's place."""
    return flat(positioned(I.list_inventory(t, SEARCH_TERM, "all", "Admin"), ["id"], I.name_order(), ["name"]))


@register("inventory_masked", with_views(f"""
WITH base AS (SELECT {_BASE} FROM inventory_items WHERE {_SEARCH})
SELECT * EXCLUDE (unit_price, profit), {_DISPLAY} FROM base""", "inventory_items"))
def inventory_masked(t):
    return flat(I.list_inventory(t, SEARCH_TERM, "all", "User"))


@register("inventory_low_or_out", with_views(f"""
WITH base AS (SELECT {_BASE} FROM inventory_items)
SELECT *, {_DISPLAY} FROM base WHERE status IN ('Low Stock', 'Out of Stock')""", "inventory_items"))
def inventory_low_or_out(t):
    return flat(I.list_inventory(t, "", P.LOW_OR_OUT, "Admin"))


@register("inventory_summary", with_views(f"""
WITH base AS (SELECT {_STATUS} AS status FROM inventory_items)
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE status = 'In Stock') AS BIGINT) AS in_stock,
       CAST(count(*) FILTER (WHERE status = 'Low Stock') AS BIGINT) AS low_stock,
       CAST(count(*) FILTER (WHERE status = 'Out of Stock') AS BIGINT) AS out_of_stock
FROM base""", "inventory_items"))
def inventory_summary(t):
    return flat(I.inventory_summary(t))


@register("inventory_print", with_views(f"""
WITH base AS (SELECT {_BASE} FROM inventory_items)
SELECT * REPLACE (CASE WHEN coalesce(supplier, '') = '' THEN 'N/A' ELSE supplier END AS supplier), {_DISPLAY},
       CAST(row_number() OVER (ORDER BY name, id) AS BIGINT) AS position
FROM base""", "inventory_items"))
def inventory_print(t):
    """QY11 / SO1: the printed list with each item's place."""
    return flat(positioned(I.print_list(t), ["id"], I.name_order(), ["name"]))


@register("barcode_lookup", with_views(
    f"SELECT {_BASE} FROM inventory_items WHERE trim(barcode) = '{LOOKUP_BARCODE.strip()}'", "inventory_items"))
def barcode_lookup(t):
    return flat(I.barcode_lookup(t, LOOKUP_BARCODE))


@register("pos_search", with_views(f"""
WITH base AS (SELECT {_BASE} FROM inventory_items)
SELECT * FROM base
WHERE status <> 'Out of Stock' AND contains(lower(name || ' ' || category), '{POS_TERM}')
  AND category = '{POS_CATEGORY}'""", "inventory_items"))
def pos_search(t):
    return flat(I.pos_search(t, POS_TERM, POS_CATEGORY))


@register("low_stock_top4", with_views(f"""
WITH base AS (SELECT {_BASE} FROM inventory_items)
SELECT * FROM base WHERE status <> 'In Stock' ORDER BY name, id LIMIT 4""", "inventory_items"))
def low_stock_top4(t):
    return flat(I.low_stock_first(t, 4))


# the shop's items and a second, never sold stock of some of them
_STOCK_SQL = """
stock AS (SELECT * FROM inventory_items
          UNION ALL SELECT * REPLACE (id + 10000000 AS id, category || ' (new)' AS category) FROM inventory_items WHERE stock_quantity = 3),
cats AS (SELECT * FROM categories
         UNION ALL SELECT * REPLACE (category_id + 10000000 AS category_id, category_name || ' (new)' AS category_name) FROM categories)"""


def _stock(t):
    i = t.inventory_items
    new = i.where("stock_quantity = 3").withColumns({"id": F.col("id") + 10_000_000, "category": F.concat("category", F.lit(" (new)"))})
    c = t.categories
    more = c.withColumns({"category_id": F.col("category_id") + 10_000_000, "category_name": F.concat("category_name", F.lit(" (new)"))})
    return i.unionByName(new), c.unionByName(more)


@register("deletable_items", with_views(f"""
WITH {_STOCK_SQL.strip()}
SELECT id, barcode, name, category, supplier, status, CAST(stock_quantity AS BIGINT) AS stock_quantity,
       CAST(unit_price AS DOUBLE) AS unit_price, CAST(selling_price AS DOUBLE) AS selling_price,
       CAST(reorder_level AS BIGINT) AS reorder_level
FROM stock WHERE id NOT IN (SELECT inventory_item_id FROM sale_items)""", "inventory_items", "sale_items", "categories"))
def deletable_items(t):
    """JN8: the items that no sale line names."""
    return flat(I.deletable_items(_stock(t)[0], t.sale_items))


@register("deletable_categories", with_views(f"""
WITH {_STOCK_SQL.strip()}
SELECT category_id, category_name FROM cats WHERE category_name NOT IN (SELECT category FROM stock)""",
                                             "categories", "inventory_items"))
def deletable_categories(t):
    """JN8: the categories that no item uses."""
    items, categories = _stock(t)
    return flat(I.deletable_categories(categories, items))


@register("suppliers_list", with_views(
    "SELECT supplier_id, supplier_name, contact_no, address, "
    "CAST(row_number() OVER (ORDER BY lower(supplier_name), supplier_id) AS BIGINT) AS position FROM suppliers", "suppliers"))
def suppliers_list(t):
    """SO2 with each supplier's place."""
    return flat(positioned(I.suppliers_list(t), ["supplier_id"], I.nocase_order("supplier_name", "supplier_id"), ["supplier_name"]))


@register("categories_list", with_views(
    "SELECT category_id, category_name, "
    "CAST(row_number() OVER (ORDER BY lower(category_name), category_id) AS BIGINT) AS position FROM categories", "categories"))
def categories_list(t):
    """SO2 with each category's place."""
    return flat(positioned(I.categories_list(t), ["category_id"], I.nocase_order("category_name", "category_id"), ["category_name"]))
