"""Job inputs derived from the canonical tables.

The data-change jobs take payloads (CSV rows, carts, commands, renames).
For the registered queries these are built from *every* row of the
tables, with data-driven changes (a stock level, a price sign, a line
number decides which rows get which defect), so the work grows with the
data. Each builder has a SQL twin used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _file_of_item():
    """One import file per category, as a shop importing several CSVs."""
    return F.concat(F.lit("import-"), F.lower(F.col("category")), F.lit(".csv"))


_FILE_SQL = "'import-' || lower(category) || '.csv'"


def import_rows(t, clean: bool) -> DataFrame:
    """CSV-shaped rows (strings) from the inventory, one per item, in id order."""
    i = t.inventory_items
    q = F.col("stock_quantity")
    s = F.col("id").cast("string")
    prev_code = F.concat(F.lit("480"), F.lpad((F.col("id") - 1).cast("string"), 10, "0"))
    if clean:
        barcode = F.when(q == 17, F.concat(F.lit("NEW"), s)).otherwise(F.col("barcode"))
        name, category, stock = F.col("name"), F.col("category"), q.cast("string")
        unit = (F.when((q == 43) & F.col("supplier").endswith("7"), F.lit("0xFFFFFFFFFFFFFFFFFF"))
                 .when(q < 10, (F.col("unit_price") + 1).cast("string")).otherwise(F.col("unit_price").cast("string")))
        stock = F.when(q == 44, F.lit("3000000000")).otherwise(stock)
    else:
        barcode = (F.when(q == 13, F.lit("")).when(q == 17, F.concat(F.lit("NEW"), s))
                    .when(q == 19, prev_code).otherwise(F.col("barcode")))
        name = F.when(q == 23, F.lit("")).otherwise(F.col("name"))
        category = F.when(q == 29, F.lower(F.col("category"))).otherwise(F.col("category"))
        stock = F.when(q == 31, F.lit("2.5")).otherwise(q.cast("string"))
        unit = (F.when(q == 37, F.lit("-1")).when(q == 41, F.lit("1d")).when(q == 43, F.lit(""))
                 .when(q == 47, F.lit("Infinity"))
                 .when(q < 10, (F.col("unit_price") + 1).cast("string")).otherwise(F.col("unit_price").cast("string")))
    reorder = F.when(q == 11, F.lit("1e1")).otherwise(F.lit("10"))
    status = F.when(q == 5, F.lit("low-stock")).otherwise(F.col("status"))
    if not clean:
        status = F.when(q == 7, F.lit("Discontinued")).otherwise(status)
    rows = i.select(_file_of_item().alias("file"), (F.col("id") + 2).cast("int").alias("row_number"),
                    barcode.alias("barcode"), name.alias("name"), category.alias("category"),
                    F.col("supplier"), stock.alias("stock_quantity"), unit.alias("unit_price"),
                    F.col("selling_price").cast("string").alias("selling_price"), reorder.alias("reorder_level"),
                    status.alias("status"), F.lit(None).cast("string").alias("error"))
    if clean:  # the same barcodes once more, in a file that is imported later
        again = rows.where(F.col("stock_quantity").isin("19", "17")).withColumns(
            {"file": F.concat(F.lit("later-"), "file"), "name": F.concat("name", F.lit(" (again)"))})
        fresh = rows.where(F.col("barcode").startswith("NEW")).withColumns(
            {"file": F.concat(F.lit("more-"), "file"), "name": F.concat("name", F.lit(" (more)"))})
        rows = rows.unionByName(again).unionByName(fresh)
    return rows


def import_rows_sql(clean: bool) -> str:
    prev = "'480' || lpad(CAST(id - 1 AS VARCHAR), 10, '0')"
    if clean:
        barcode = "CASE WHEN stock_quantity = 17 THEN 'NEW' || CAST(id AS VARCHAR) ELSE barcode END"
        name, category, stock = "name", "category", "CAST(stock_quantity AS VARCHAR)"
        unit = ("CASE WHEN stock_quantity = 43 AND ends_with(supplier, '7') THEN '0xFFFFFFFFFFFFFFFFFF' "
                "WHEN stock_quantity < 10 THEN CAST(unit_price + 1 AS VARCHAR) ELSE CAST(unit_price AS VARCHAR) END")
        stock = "CASE WHEN stock_quantity = 44 THEN '3000000000' ELSE CAST(stock_quantity AS VARCHAR) END"
        status = "CASE WHEN stock_quantity = 5 THEN 'low-stock' ELSE status END"
    else:
        barcode = (f"CASE WHEN stock_quantity = 13 THEN '' WHEN stock_quantity = 17 THEN 'NEW' || CAST(id AS VARCHAR) "
                   f"WHEN stock_quantity = 19 THEN {prev} ELSE barcode END")
        name = "CASE WHEN stock_quantity = 23 THEN '' ELSE name END"
        category = "CASE WHEN stock_quantity = 29 THEN lower(category) ELSE category END"
        stock = "CASE WHEN stock_quantity = 31 THEN '2.5' ELSE CAST(stock_quantity AS VARCHAR) END"
        unit = ("CASE WHEN stock_quantity = 37 THEN '-1' WHEN stock_quantity = 41 THEN '1d' "
                "WHEN stock_quantity = 43 THEN '' WHEN stock_quantity = 47 THEN 'Infinity' "
                "WHEN stock_quantity < 10 THEN CAST(unit_price + 1 AS VARCHAR) ELSE CAST(unit_price AS VARCHAR) END")
        status = ("CASE WHEN stock_quantity = 7 THEN 'Discontinued' WHEN stock_quantity = 5 THEN 'low-stock' "
                  "ELSE status END")
    more = """
         UNION ALL SELECT * REPLACE ('later-' || file AS file, name || ' (again)' AS name) FROM rows0 WHERE stock_quantity IN ('19', '17')
         UNION ALL SELECT * REPLACE ('more-' || file AS file, name || ' (more)' AS name) FROM rows0 WHERE starts_with(barcode, 'NEW')"""
    return f"""
rows0 AS (SELECT {_FILE_SQL} AS file, CAST(id + 2 AS INTEGER) AS row_number, {barcode} AS barcode, {name} AS name,
                {category} AS category, supplier, {stock} AS stock_quantity, {unit} AS unit_price,
                CAST(selling_price AS VARCHAR) AS selling_price,
                CASE WHEN stock_quantity = 11 THEN '1e1' ELSE '10' END AS reorder_level, {status} AS status
         FROM inventory_items),
rows AS (SELECT * FROM rows0{more if clean else ""})"""


def carts(t) -> DataFrame:
    """One cart per order: its lines (line 7 with quantity 0, returned line 6
    pointing at an unknown item) and its eLoad event as a digital line."""
    o = t.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    li = t.raw("lineitem")
    p = t.raw("part").select("p_partkey", "p_retailprice")
    lines = (li.join(p, p.p_partkey == li.l_partkey, "inner")
             .select(F.col("l_orderkey").alias("cart_id"), F.col("l_linenumber"),
                     F.struct(F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 6),
                                     F.col("l_partkey") + 1_000_000).otherwise(F.col("l_partkey")).alias("inventory_item_id"),
                              F.when(F.col("l_linenumber") == 7, F.lit(0.0)).when(F.col("l_linenumber") == 2, F.col("l_quantity") + 0.5)
                              .otherwise(F.col("l_quantity")).alias("quantity"),
                              F.col("p_retailprice").alias("price")).alias("item")))
    items = lines.groupBy("cart_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "item"))), lambda x: x["item"]).alias("items"))
    ev = (t.raw("events").filter(~F.col("event_type").isin("purchase", "signup"))
          .select(F.col("event_id").alias("cart_id"),
                  F.struct(F.concat(F.lit("09"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("mobile_number"),
                           F.lit("GLOBE").alias("network"), F.lit("regular").alias("load_type"),
                           F.concat(F.lit("Regular "), F.floor("value").cast("bigint").cast("string")).alias("load_value"),
                           F.lit("").alias("notes"), F.lit(None).cast("double").alias("quantity"),
                           F.col("value").alias("price")).alias("d")))
    dig = ev.groupBy("cart_id").agg(F.collect_list("d").alias("digital_items"))
    item_type = items.schema["items"].dataType
    dig_type = dig.schema["digital_items"].dataType
    return (o.join(items, o.o_orderkey == items.cart_id, "left").drop("cart_id")
             .join(dig, o.o_orderkey == dig.cart_id, "left").drop("cart_id")
             .select(F.col("o_orderkey").alias("cart_id"), F.col("o_orderdate").cast("date").alias("sale_date"),
                     F.col("o_orderpriority").alias("payment_method"),
                     F.concat(F.lit("Staff "), (F.col("o_custkey") % 5).cast("string")).alias("employee_name"),
                     F.coalesce("items", F.array().cast(item_type)).alias("items"),
                     F.coalesce("digital_items", F.array().cast(dig_type)).alias("digital_items")))


CART_LINES_SQL = """
plines AS (SELECT l_orderkey AS cart_id, l_linenumber AS pos_key,
                  CASE WHEN l_returnflag = 'R' AND l_linenumber = 6 THEN l_partkey + 1000000 ELSE l_partkey END AS inventory_item_id,
                  CASE WHEN l_linenumber = 7 THEN 0.0 WHEN l_linenumber = 2 THEN l_quantity + 0.5 ELSE l_quantity END AS quantity, p_retailprice AS price
           FROM lineitem JOIN part ON p_partkey = l_partkey),
dlines AS (SELECT event_id AS cart_id, '09' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS mobile_number,
                  'GLOBE' AS network, 'Regular ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS load_value,
                  1.0 AS quantity, value AS price
           FROM events WHERE event_type NOT IN ('purchase', 'signup') AND value > 0)"""


def transition_commands(t) -> DataFrame:
    """Two commands per request: complete 3 h after the request (no
    reference given), fail 4 h after (a reason only above 100)."""
    r = t.digital_service_requests
    complete = r.select((F.col("id") * 2).alias("command_id"), F.col("id").alias("request_id"),
                        F.lit("complete").alias("action"), (F.col("requested_at") + F.expr("INTERVAL 3 HOURS")).alias("ts"),
                        F.lit("").alias("reference_no"), F.lit("").alias("reason"), F.lit("Staff 9").alias("by_name"))
    fail = r.select((F.col("id") * 2 + 1).alias("command_id"), F.col("id").alias("request_id"),
                    F.lit("fail").alias("action"), (F.col("requested_at") + F.expr("INTERVAL 4 HOURS")).alias("ts"),
                    F.lit("").alias("reference_no"),
                    F.when(F.col("amount") > 100, F.lit("no signal")).otherwise(F.lit("")).alias("reason"),
                    F.lit("Staff 9").alias("by_name"))
    return complete.unionByName(fail)


TRANSITION_COMMANDS_SQL = """
cmds AS (SELECT id * 2 AS command_id, id AS request_id, 'complete' AS action, requested_at + INTERVAL 3 HOUR AS ts,
                '' AS reference_no, '' AS reason FROM digital_service_requests
         UNION ALL
         SELECT id * 2 + 1, id, 'fail', requested_at + INTERVAL 4 HOUR, '',
                CASE WHEN amount > 100 THEN 'no signal' ELSE '' END FROM digital_service_requests)"""


def backfill_items(t) -> DataFrame:
    """Inventory ids with barcodes made blank, repeated or LEGACY-shaped by stock
    level; runs of such items form chains of references to the item before."""
    q = F.col("stock_quantity")
    code = (F.when(q == 0, F.lit("")).when(q.isin(1, 2, 3), F.concat(F.lit("480-"), F.col("category")))
             .when(q == 7, F.concat(F.lit("LEGACY-"), (F.col("id") + 1).cast("string")))
             .when(q == 9, F.concat(F.lit(" "), F.col("barcode"), F.lit(" ")))
             .when(q.isin(4, 5, 6, 8, 10, 11, 12, 13, 14, 15, 16), F.concat(F.lit("LEGACY-"), (F.col("id") - 1).cast("string")))
             .otherwise(F.col("barcode")))
    return t.inventory_items.select("id", code.alias("barcode"))


BACKFILL_ITEMS_SQL = """
items AS (SELECT id, CASE WHEN stock_quantity = 0 THEN '' WHEN stock_quantity IN (1, 2, 3) THEN '480-' || category
                          WHEN stock_quantity = 7 THEN 'LEGACY-' || CAST(id + 1 AS VARCHAR)
                          WHEN stock_quantity = 9 THEN ' ' || barcode || ' '
                          WHEN stock_quantity IN (4, 5, 6, 8, 10, 11, 12, 13, 14, 15, 16) THEN 'LEGACY-' || CAST(id - 1 AS VARCHAR)
                          ELSE barcode END AS barcode
          FROM inventory_items)"""


CSV_CHUNK = 500  # items of one import file


def import_files(t) -> DataFrame:
    """``file_key, ord, sub, line``: CSV text of many import files, a few hundred
    items each. The files take turns in header order (and CRLF line ends, and an
    unknown first column); stock levels decide which names hold commas, quotes and
    newlines, which items are followed by a blank row and which rows are too wide."""
    from tillpoint.sinks.export import csv_line

    i = t.inventory_items
    chunk = F.floor(F.col("id") / CSV_CHUNK).cast("bigint")
    key = F.concat(F.regexp_replace(F.lower("category"), "[^a-z0-9]", "_"), F.lit("-"), chunk.cast("string"))
    q = F.col("stock_quantity")
    name = F.when(q % 7 == 0, F.concat("name", F.lit(', "big"\nbox'))).otherwise(F.col("name"))
    values = [F.col("barcode"), name, F.col("category"), F.col("supplier"), q, F.col("unit_price"),
              F.col("selling_price"), F.col("reorder_level"), F.col("status")]
    kind = chunk % 3
    plain = csv_line(*values)
    noted = F.concat(F.lit("n,"), plain)
    more = F.when(q == 11, F.lit(",x,y")).otherwise(F.lit(""))
    body = F.when(kind == 1, F.concat(csv_line(*values[::-1]), more, F.lit("\r"))).otherwise(
        F.concat(F.when(kind == 2, noted).otherwise(plain), more))
    rows = i.select(key.alias("file_key"), F.col("id").alias("ord"), F.lit(0).alias("sub"), body.alias("line"))
    blanks = i.where(q == 5).select(key.alias("file_key"), F.col("id").alias("ord"), F.lit(1).alias("sub"), F.lit(" , ").alias("line"))
    names = ["Barcode", "Name", "Category", "Supplier", "Stock Quantity", "Unit Price", "Selling Price", "Reorder Level", " STATUS "]
    head = F.when(kind == 1, F.lit(",".join(names[::-1]) + "\r")).when(kind == 2, F.lit("Notes," + ",".join(names))).otherwise(F.lit(",".join(names)))
    heads = i.select(key.alias("file_key"), F.lit(-1).cast("bigint").alias("ord"), F.lit(0).alias("sub"), head.alias("line")).distinct()
    return heads.unionByName(rows).unionByName(blanks)


IMPORT_FILES_SQL = f"""
keyed AS (SELECT *, regexp_replace(lower(category), '[^a-z0-9]', '_', 'g') || '-' || CAST(id // {CSV_CHUNK} AS VARCHAR) AS file_key
          FROM inventory_items),
placed AS (SELECT *, 1 + row_number() OVER (PARTITION BY file_key ORDER BY id)
                  + coalesce(sum(CASE WHEN stock_quantity = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY file_key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS row_number
           FROM keyed)"""
