"""SK1 / SK2: CSV exports of inventory and sales.

Each CSV line is built as a column (the reference's quoting rule: quote a
field only when it holds ``"``, ``,`` or a newline, doubling inner quotes;
NULL becomes empty), then written as text with a distributed sort, so
the part files concatenated in name order are the export.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.normalize import normalize_item_status
from tillpoint.functions.text import js_number_text
from tillpoint.operators.sales import sale_lines_all

# -- fixed values: export headers ------------------------------------------
INVENTORY_HEADER = ["Barcode", "Name", "Category", "Supplier", "Stock Quantity", "Unit Price",
                    "Selling Price", "Reorder Level", "Status"]
SALES_HEADER = ["Transaction Code", "Date", "Payment Method", "Total Amount", "Items"]


def csv_field(c: Column) -> Column:
    v = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(v.rlike('[",\n]'), quoted).otherwise(v)


def csv_line(*cols: Column) -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in cols])


def inventory_lines(t) -> DataFrame:
    """SK1 rows: ``line`` in name order (binary collation) with a tie-break."""
    i = t.inventory_items
    line = csv_line(F.col("barcode"), F.col("name"), F.col("category"), F.col("supplier"),
                    F.col("stock_quantity"), js_number_text(F.col("unit_price")),
                    js_number_text(F.col("selling_price")), F.col("reorder_level"),
                    normalize_item_status(F.col("status")))
    return i.select("name", "id", line.alias("line"))


def sales_lines(t) -> DataFrame:
    """SK2 rows: one per sale, newest first, items as ``name xQty; ...`` with
    product lines before digital lines."""
    lines = sale_lines_all(t)
    item = F.struct("line_kind", "line_no", "item_name", "quantity")
    per_sale = lines.groupBy("sale_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    text = F.array_join(F.transform("items", lambda x: F.concat(x["item_name"], F.lit(" x"),
                                                                x["quantity"].cast("string"))), "; ")
    s = t.sales
    joined = s.join(per_sale, s.id == per_sale.sale_id, "left")
    line = csv_line(F.col("transaction_code"), F.date_format("sale_date", "yyyy-MM-dd"),
                    F.col("payment_method"), js_number_text(F.col("total_amount")),
                    F.coalesce(text, F.lit("")))
    return joined.select("sale_date", "id", line.alias("line"))


def _write(keyed: DataFrame, header: list[str], path: str) -> None:
    """``keyed`` has sort keys ``k1, k2`` and ``line``; the header sorts first."""
    spark = keyed.sparkSession
    head = spark.createDataFrame([(",".join(header),)], "line string").select(
        F.lit(0).alias("_part"), F.lit(None).cast(keyed.schema["k1"].dataType).alias("k1"),
        F.lit(None).cast(keyed.schema["k2"].dataType).alias("k2"), "line")
    body = keyed.select(F.lit(1).alias("_part"), "k1", "k2", "line")
    ordered = head.unionByName(body).orderBy("_part", "k1", "k2")
    ordered.select("line").write.mode("overwrite").text(path)


def export_inventory_csv(t, path: str) -> None:
    """SK1: write the inventory export (header + one line per item)."""
    lines = inventory_lines(t)
    _write(lines.select(F.col("name").alias("k1"), F.col("id").alias("k2"), "line"),
           INVENTORY_HEADER, path)


def export_sales_csv(t, path: str) -> None:
    """SK2: write the sales export, newest sale first."""
    lines = sales_lines(t)
    _write(lines.select((-F.datediff(F.col("sale_date"), F.lit("1970-01-01"))).alias("k1"),
                        (-F.col("id")).alias("k2"), "line"),
           SALES_HEADER, path)
