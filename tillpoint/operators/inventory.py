"""Inventory reports: FL1-FL4, FN15, FN19, FN10 decoration, AG1, SO1, SO6,
JN8, and the composed list / print views (QY1, QY11)."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.functions.normalize import ascii_lower, normalize_item_status
from tillpoint.functions.text import product_name_parts

ITEM_COLUMNS = ("id", "barcode", "name", "category", "supplier", "status", "stock_quantity",
                "unit_price", "selling_price", "reorder_level")


def like_contains(term: str) -> str:
    """FL1 pattern: ``%term%`` with the term's ``%`` / ``_`` kept as wildcards
    (as in the reference) and ``\\`` made literal (Spark's escape char)."""
    return "%" + term.strip().replace("\\", "\\\\") + "%"


def with_derived(items: DataFrame) -> DataFrame:
    """Normalised status (FN1) and profit (FN15)."""
    return (items.withColumn("status", normalize_item_status(F.col("status")))
                 .withColumn("profit", F.col("selling_price") - F.col("unit_price")))


def search(items: DataFrame, term: str) -> DataFrame:
    """FL1: case-insensitive contains over name, category, supplier, barcode."""
    if not term.strip():
        return items
    # LIKE folds A-Z only, so both sides are folded that way
    pattern = like_contains(term).translate(str.maketrans(ascii_uppercase, ascii_lowercase))
    hit = F.lit(False)
    for c in ("name", "category", "supplier", "barcode"):
        hit = hit | F.coalesce(ascii_lower(F.col(c)).like(pattern), F.lit(False))
    return items.filter(hit)


def status_filter(items: DataFrame, status: str) -> DataFrame:
    """FL2: applied after normalising; ``Low/Out of Stock`` takes both."""
    if status == "all":
        return items
    if status == P.LOW_OR_OUT:
        return items.filter(F.col("status").isin(P.LOW_STOCK, P.OUT_OF_STOCK))
    return items.filter(F.col("status") == status)


def decorate(items: DataFrame) -> DataFrame:
    """FN10: display name and variant from the item name."""
    parts = product_name_parts(F.col("name"))
    return items.withColumn("display_name", parts["name"]).withColumn("display_variant", parts["variant"])


def mask_for_role(items: DataFrame, role: str) -> DataFrame:
    """FN19: non-admins do not see cost or profit."""
    return items if role == "Admin" else items.drop("unit_price", "profit")


def list_inventory(t, term: str = "", status: str = "all", role: str = "Admin") -> DataFrame:
    """QY1 items: search, normalise, filter, mask and decorate."""
    items = with_derived(search(t.inventory_items.select(*ITEM_COLUMNS), term))
    return decorate(mask_for_role(status_filter(items, status), role)).orderBy(*name_order())


def name_order():
    """SO1: ``ORDER BY name``, the id breaks ties."""
    return [F.col("name"), F.col("id")]


def inventory_summary(t) -> DataFrame:
    """AG1: counts by normalised status, one row."""
    s = normalize_item_status(F.col("status"))
    return t.inventory_items.agg(F.count(F.lit(1)).alias("total"),
                                 F.count_if(s == P.IN_STOCK).alias("in_stock"),
                                 F.count_if(s == P.LOW_STOCK).alias("low_stock"),
                                 F.count_if(s == P.OUT_OF_STOCK).alias("out_of_stock"))


def print_list(t, term: str = "", status: str = "all") -> DataFrame:
    """QY11: the list for printing, a blank supplier shown as ``N/A``."""
    items = list_inventory(t, term, status, "Admin")
    sup = F.coalesce(F.col("supplier"), F.lit(""))
    return items.withColumn("supplier", F.when(sup == "", F.lit("N/A")).otherwise(sup))


def barcode_lookup(t, barcode: str) -> DataFrame:
    """FL3: exact match of the stored barcode with the trimmed one; blank finds
    nothing. The column stays bare, so the filter reaches the scan."""
    code = barcode.strip()
    items = t.inventory_items.select(*ITEM_COLUMNS)
    if not code:
        return with_derived(items.limit(0))
    return with_derived(items.filter(F.col("barcode") == F.lit(code)))


def pos_search(t, term: str, category: str = "all") -> DataFrame:
    """FL4: sellable items whose ``name category`` contains the term."""
    items = with_derived(t.inventory_items.select(*ITEM_COLUMNS)).filter(F.col("status") != P.OUT_OF_STOCK)
    needle = term.strip().lower()
    if needle:
        items = items.filter(F.lower(F.concat_ws(" ", "name", "category")).contains(needle))
    if category != "all":
        items = items.filter(F.col("category") == category)
    return items


def low_stock_first(t, k: int = 4) -> DataFrame:
    """SO6: the first ``k`` items that are not in stock, by name then id."""
    items = with_derived(t.inventory_items.select(*ITEM_COLUMNS))
    return items.filter(F.col("status") != P.IN_STOCK).orderBy("name", "id").limit(k)


def deletable_items(items: DataFrame, sale_items: DataFrame) -> DataFrame:
    """JN8: items with no sale line (an anti join), so they may be deleted."""
    # distinct first: a hot item is one row by the time it is shuffled
    used = sale_items.select(F.col("inventory_item_id").alias("id")).distinct()
    return items.select(*ITEM_COLUMNS).join(used, "id", "left_anti")


def deletable_categories(categories: DataFrame, items: DataFrame) -> DataFrame:
    """JN8: categories no item uses (exact name match)."""
    used = items.select(F.col("category").alias("category_name")).distinct()
    return categories.join(used, "category_name", "left_anti")


def nocase_order(name_col: str, id_col: str):
    """SO2: ``COLLATE NOCASE`` folds ASCII letters only, then the id."""
    return [ascii_lower(F.col(name_col)), F.col(id_col)]


def suppliers_list(t) -> DataFrame:
    return t.suppliers.orderBy(*nocase_order("supplier_name", "supplier_id"))


def categories_list(t) -> DataFrame:
    return t.categories.orderBy(*nocase_order("category_name", "category_id"))
