"""Registered data-change jobs (DM1-DM11, SC2) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.jobs import audit as AU
from tillpoint.jobs import imports as IM
from tillpoint.jobs import reference as RF
from tillpoint.jobs import requests as RQ
from tillpoint.jobs import sales_ingest as SI
from tillpoint.plans import inputs as IN
from tillpoint.plans.present import flat
from tillpoint.plans.registry import register
from tillpoint.plans.sqlviews import with_views
from tillpoint.sinks import versions as VR
from tillpoint.sources import catalog as C
from tillpoint.sources.csv_import import read_inventory_csv
from tillpoint.streaming.live_totals import scratch_path

_NORM = """CASE WHEN lower(trim(coalesce({x}, ''))) IN ('low stock', 'low-stock') THEN 'Low Stock'
     WHEN lower(trim(coalesce({x}, ''))) IN ('out of stock', 'out-of-stock') THEN 'Out of Stock' ELSE 'In Stock' END"""


def _jsnum(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    return (f"CASE WHEN {t} = '' THEN 0.0 "
            f"WHEN regexp_matches({t}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST({t} AS DOUBLE) "
            f"WHEN regexp_matches({t}, '^0[xX]F+$') THEN pow(16.0, length({t}) - 2) - 1 "
            f"WHEN regexp_matches({t}, '^[+-]?Infinity$') THEN CASE WHEN starts_with({t}, '-') THEN '-inf'::DOUBLE "
            f"ELSE 'inf'::DOUBLE END END")


def _preview_ctes(clean: bool) -> str:
    return f"""{IN.import_rows_sql(clean).strip()},
inv_bc AS (SELECT trim(barcode) AS bc, id AS bc_id FROM inventory_items),
by_name AS (SELECT lower(name) AS nm, min(id) AS m_id, arg_min(barcode, id) AS m_barcode FROM inventory_items GROUP BY 1),
base AS (SELECT file, row_number, trim(barcode) AS raw_barcode, trim(name) AS name, trim(category) AS category,
                trim(supplier) AS supplier, stock_quantity AS stock_text, unit_price AS unit_text,
                selling_price AS sell_text, reorder_level AS reorder_text, trim(status) AS status_raw FROM rows),
matched AS (SELECT b.*, CASE WHEN raw_barcode <> '' THEN i.bc_id ELSE n.m_id END AS existing_id,
                   trim(CASE WHEN raw_barcode <> '' THEN raw_barcode ELSE COALESCE(n.m_barcode, '') END) AS barcode
            FROM base b LEFT JOIN inv_bc i ON b.raw_barcode <> '' AND b.raw_barcode = i.bc
                        LEFT JOIN by_name n ON b.raw_barcode = '' AND lower(b.name) = n.nm),
nums AS (SELECT m.*, {_jsnum('unit_text')} AS unit_price, {_jsnum('sell_text')} AS selling_price,
                {_jsnum('stock_text')} AS stock_num, {_jsnum('reorder_text')} AS reorder_num FROM matched m),
chk AS (SELECT n.*, o.id AS owner_id, c.category_name AS cat
        FROM nums n LEFT JOIN inv_bc o0 ON o0.bc = n.barcode LEFT JOIN (SELECT id FROM inventory_items) o ON o.id = o0.bc_id
        LEFT JOIN (SELECT DISTINCT category_name FROM categories) c ON c.category_name = n.category),
err AS (SELECT *, CASE
          WHEN barcode = '' THEN 'Barcode is required.'
          WHEN owner_id IS NOT NULL AND owner_id <> COALESCE(existing_id, 0) THEN 'Barcode already exists.'
          WHEN name = '' THEN 'Product name is required.'
          WHEN category = '' THEN 'Category is required.'
          WHEN cat IS NULL THEN 'Choose a valid category from Settings.'
          WHEN NOT (COALESCE(isfinite(unit_price), false) AND unit_price >= 0 AND unit_price < 1e16
                    AND COALESCE(isfinite(selling_price), false) AND selling_price >= 0 AND selling_price < 1e16)
            THEN 'Unit Price and Selling Price must be valid non-negative numbers.'
          WHEN NOT (COALESCE(isfinite(stock_num), false) AND stock_num = floor(stock_num) AND stock_num >= 0
                    AND COALESCE(isfinite(reorder_num), false) AND reorder_num = floor(reorder_num) AND reorder_num >= 0)
            THEN 'Stock Quantity and Reorder Level must be non-negative whole numbers.'
          WHEN status_raw <> '' AND lower(status_raw) NOT IN ('in stock', 'low stock', 'low-stock', 'out of stock', 'out-of-stock')
            THEN 'Status must be In Stock, Low Stock, or Out of Stock.'
        END AS error0 FROM chk),
firsts AS (SELECT file, barcode, min(row_number) AS first_row FROM err WHERE error0 IS NULL GROUP BY 1, 2),
preview AS (SELECT e.*, CASE WHEN e.error0 IS NULL AND e.row_number <> f.first_row THEN 'Barcode is duplicated in this CSV.'
                             ELSE e.error0 END AS msg
            FROM err e LEFT JOIN firsts f ON f.file = e.file AND f.barcode = e.barcode)"""


def _preview_df(t, clean: bool):
    return IM.preview_import(IN.import_rows(t, clean), t.inventory_items, t.categories)


def _valid_only(df):
    ok = F.col("error").isNull()
    return df.select(*[F.when(ok, F.col(c)).alias(c) if c in ("status", "stock_quantity", "unit_price",
                                                              "selling_price", "reorder_level") else F.col(c)
                       for c in df.columns])


@register("import_preview", with_views(f"""
WITH {_preview_ctes(False)}
SELECT file, CAST(row_number AS BIGINT) AS row_number, barcode, name, category, supplier,
       CASE WHEN msg IS NULL THEN {_NORM.format(x='status_raw')} END AS status,
       CASE WHEN msg IS NULL THEN CAST(stock_num AS BIGINT) END AS stock_quantity,
       CASE WHEN msg IS NULL THEN unit_price END AS unit_price,
       CASE WHEN msg IS NULL THEN selling_price END AS selling_price,
       CASE WHEN msg IS NULL THEN CAST(reorder_num AS BIGINT) END AS reorder_level,
       existing_id,
       CASE WHEN msg IS NOT NULL THEN 'Row ' || CAST(row_number AS VARCHAR) || ': ' || msg END AS error
FROM preview""", "inventory_items", "categories"))
def import_preview(t):
    """DM1 over an import made from every inventory row."""
    return flat(_valid_only(_preview_df(t, clean=False)))


@register("import_preview_summary", with_views(f"""
WITH {_preview_ctes(False)}
SELECT file, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE msg IS NULL AND existing_id IS NULL) AS BIGINT) AS new_products,
       CAST(count(*) FILTER (WHERE msg IS NULL AND existing_id IS NOT NULL) AS BIGINT) AS existing_products,
       CAST(count(*) FILTER (WHERE msg IS NOT NULL) AS BIGINT) AS errors
FROM preview GROUP BY file""", "inventory_items", "categories"))
def import_preview_summary(t):
    """AG13 over the DM1 preview."""
    return flat(IM.preview_summary(_preview_df(t, clean=False)))


@register("import_errors_top12", with_views(f"""
WITH {_preview_ctes(False)}
SELECT file, CAST(row_number AS BIGINT) AS row_number, 'Row ' || CAST(row_number AS VARCHAR) || ': ' || msg AS error,
       CAST(greatest(count(*) OVER () - 12, 0) AS BIGINT) AS more
FROM preview WHERE msg IS NOT NULL ORDER BY file, row_number LIMIT 12""", "inventory_items", "categories"))
def import_errors_top12(t):
    """SO12: the first 12 preview errors and how many more there are."""
    return flat(IM.first_errors(_preview_df(t, clean=False), 12))


# files one after another: a file with an error changes nothing; a barcode that an
# earlier file (or the inventory) has is an existing product
_APPLY = """
fit AS (SELECT file FROM preview GROUP BY file HAVING count(msg) = 0),
ok AS (SELECT p.*, (SELECT min(i.id) FROM inventory_items i WHERE trim(i.barcode) = p.barcode) AS stored,
              row_number() OVER (PARTITION BY p.barcode ORDER BY p.file, p.row_number) AS turn,
              row_number() OVER (PARTITION BY p.barcode ORDER BY p.file DESC, p.row_number DESC) AS turn_back
       FROM preview p WHERE p.file IN (SELECT file FROM fit))"""


@register("import_apply_skip", with_views(f"""
WITH {_preview_ctes(True)},{_APPLY}
SELECT f.file, CAST(count(ok.barcode) FILTER (WHERE stored IS NULL AND turn = 1) AS BIGINT) AS created,
       CAST(0 AS BIGINT) AS updated,
       CAST(count(ok.barcode) FILTER (WHERE stored IS NOT NULL OR turn > 1) AS BIGINT) AS skipped
FROM (SELECT DISTINCT file FROM preview) f LEFT JOIN ok ON ok.file = f.file GROUP BY f.file""", "inventory_items", "categories"))
def import_apply_skip(t):
    """DM2 in skip mode: created / updated / skipped of each file."""
    _, summary = IM.apply_import(_preview_df(t, clean=True), t.inventory_items, "skip")
    return flat(summary)


_IMPORT_UPDATE_SQL = with_views(f"""
WITH {_preview_ctes(True)},{_APPLY},
typed AS (SELECT stored, turn, turn_back, file, row_number, barcode, name, category, supplier, {_NORM.format(x='status_raw')} AS status,
                 CAST(stock_num AS BIGINT) AS stock_quantity, CAST(unit_price AS DECIMAL(18,2)) AS unit_price,
                 CAST(selling_price AS DECIMAL(18,2)) AS selling_price, CAST(reorder_num AS BIGINT) AS reorder_level
          FROM ok),
last AS (SELECT * FROM typed WHERE turn_back = 1),
numbered AS (SELECT barcode, (SELECT max(id) FROM inventory_items) + row_number() OVER (ORDER BY file, row_number) AS id
             FROM typed WHERE stored IS NULL AND turn = 1),
changed AS (SELECT coalesce(last.stored, n.id) AS id, last.barcode, name, category, supplier, status, stock_quantity, unit_price,
                   selling_price, reorder_level
            FROM last LEFT JOIN numbered n ON n.barcode = last.barcode),
allrows AS (SELECT id, barcode, name, category, supplier, status, CAST(stock_quantity AS BIGINT) AS stock_quantity, unit_price,
                   selling_price, CAST(reorder_level AS BIGINT) AS reorder_level
            FROM inventory_items WHERE id NOT IN (SELECT id FROM changed)
            UNION ALL SELECT * FROM changed)
SELECT id, barcode, name, category, supplier, status, stock_quantity, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(selling_price AS DOUBLE) AS selling_price, reorder_level
FROM allrows""", "inventory_items", "categories")


@register("import_apply_update", _IMPORT_UPDATE_SQL)
def import_apply_update(t):
    """DM2 in update mode: the inventory after the import."""
    new_inventory, _ = IM.apply_import(_preview_df(t, clean=True), t.inventory_items, "update")
    return flat(new_inventory)


@register("import_commit", _IMPORT_UPDATE_SQL)
def import_commit(t):
    """DM2 committed: the import is published as a new version of the stored tables,
    a commit on the version before it is refused, and the new version is read back."""
    store = VR.commit_tables(t.spark, scratch_path(t.spark, "versions"), t, ("inventory_items", "categories"))
    pinned = store.at()
    version, _ = IM.commit_import(store, IN.import_rows(t, clean=True), "update")
    try:  # a job that still has the version before it is refused
        store.commit(pinned.version, {"inventory_items": pinned.inventory_items.limit(0)})
    except VR.CommitConflict:
        return flat(store.at(version).inventory_items)
    raise AssertionError("a commit on an old version was let through")


@register("csv_import_parse", with_views(f"""
WITH {IN.IMPORT_FILES_SQL.strip()}
SELECT file_key, CAST(row_number AS BIGINT) AS row_number,
       {", ".join(f"CASE WHEN stock_quantity <> 11 THEN {v} END AS {c}" for c, v in (
           ("barcode", "barcode"), ("name", "CASE WHEN stock_quantity % 7 = 0 THEN name || ', \"big\"' || chr(10) || 'box' ELSE name END"),
           ("category", "category"), ("supplier", "coalesce(supplier, '')"), ("stock_quantity", "CAST(stock_quantity AS VARCHAR)"),
           ("unit_price", "CAST(unit_price AS VARCHAR)"), ("selling_price", "CAST(selling_price AS VARCHAR)"),
           ("reorder_level", "CAST(reorder_level AS VARCHAR)"), ("status", "status")))},
       CASE WHEN stock_quantity = 11 THEN 'Row ' || CAST(row_number AS VARCHAR) || ': contains more values than the header row.' END AS error
FROM placed""", "inventory_items"))
def csv_import_parse(t):
    """SC2: write the inventory as many CSV files in three header orders, with
    quoted commas and newlines, blank and over-wide rows, and read them back."""
    folder = scratch_path(t.spark, "csv-import")
    (IN.import_files(t).repartition("file_key").sortWithinPartitions("file_key", "ord", "sub")
     .select("file_key", "line").write.mode("overwrite").partitionBy("file_key").text(folder))
    rows = read_inventory_csv(t.spark, folder)
    return flat(rows.withColumn("file_key", F.regexp_extract("file", "file_key=([^/]+)/", 1)).drop("file"))


def _item_edits(t):
    """Two edits of every item: prices doubled (items with stock 7 or 9 ask for the
    barcode of the next item, those with stock 8 all for one new barcode), then the
    price tripled; and an edit of an unknown item each."""
    i = t.inventory_items
    q = F.col("stock_quantity")
    nxt = F.concat(F.lit("480"), F.lpad((F.col("id") + 1).cast("string"), 10, "0"))
    code = F.when(q.isin(7, 9), nxt).when(q == 8, F.lit("SHARED")).otherwise(F.col("barcode"))
    common = [F.col(c) for c in ("name", "category", "supplier")] + [
        q.cast("string").alias("stock_text"), F.col("selling_price").cast("string").alias("selling_price_text"),
        F.col("reorder_level").cast("string").alias("reorder_text"), F.col("status").alias("status_text")]

    def edit(k, item, barcode, factor):
        return i.select((F.col("id") * 3 + k).alias("edit_id"), item.alias("id"), barcode.alias("barcode"), *common,
                        (F.col("unit_price") * factor).cast("string").alias("unit_price_text"))
    first = edit(0, F.col("id"), code, 2)
    second = edit(1, F.col("id"), F.when(q == 8, F.lit("SHARED")).otherwise(F.col("barcode")), 3).where(q % 2 == 0)
    unknown = edit(2, F.col("id") + 10_000_000, F.col("barcode"), 2).where(q == 3)
    return first.unionByName(second).unionByName(unknown)


_EDITS_SQL = """
e AS (SELECT id * 3 AS edit_id, id, CASE WHEN stock_quantity IN (7, 9) THEN '480' || lpad(CAST(id + 1 AS VARCHAR), 10, '0')
                                         WHEN stock_quantity = 8 THEN 'SHARED' ELSE barcode END AS barcode, unit_price * 2 AS price
      FROM inventory_items
      UNION ALL
      SELECT id * 3 + 1, id, CASE WHEN stock_quantity = 8 THEN 'SHARED' ELSE barcode END, unit_price * 3
      FROM inventory_items WHERE stock_quantity % 2 = 0),
owned AS (SELECT e.*, o.id AS owner FROM e LEFT JOIN inventory_items o ON trim(o.barcode) = trim(e.barcode)),
taker AS (SELECT trim(barcode) AS code, arg_min(id, edit_id) AS item FROM owned WHERE owner IS NULL OR owner = id GROUP BY 1),
res AS (SELECT w.edit_id, w.id, w.barcode, w.price,
               CASE WHEN w.owner <> w.id THEN 'Barcode already exists.'
                    WHEN t.item <> w.id THEN 'Barcode already exists.' END AS error
        FROM owned w LEFT JOIN taker t ON t.code = trim(w.barcode)),
last AS (SELECT id, arg_max(trim(barcode), edit_id) AS barcode, arg_max(price, edit_id) AS price FROM res WHERE error IS NULL GROUP BY id)"""


@register("item_edits", with_views(f"""
WITH {_EDITS_SQL.strip()}
SELECT i.id, coalesce(l.barcode, i.barcode) AS barcode, CAST(coalesce(l.price, i.unit_price) AS DOUBLE) AS unit_price
FROM inventory_items i LEFT JOIN last l ON l.id = i.id""", "inventory_items"))
def item_edits(t):
    """DM11: the inventory after the admin's edits; ids and barcodes stay unique."""
    inv, _ = IM.apply_item_edits(_item_edits(t), t.inventory_items, t.categories, "Admin")
    return flat(inv.select("id", "barcode", "unit_price"))


@register("item_edit_rejects", with_views(f"""
WITH {_EDITS_SQL.strip()}
SELECT edit_id, id, error FROM res WHERE error IS NOT NULL
UNION ALL SELECT id * 3 + 2, id + 10000000, 'Item not found.' FROM inventory_items WHERE stock_quantity = 3""", "inventory_items"))
def item_edit_rejects(t):
    """DM11: the refused edits."""
    _, rejects = IM.apply_item_edits(_item_edits(t), t.inventory_items, t.categories, "Admin")
    return flat(rejects)


@register("item_edits_by_user", with_views("""
SELECT id, barcode, 'In Stock' AS status, CAST(unit_price AS DOUBLE) AS unit_price FROM inventory_items""", "inventory_items"))
def item_edits_by_user(t):
    """DM11: a user may set the status only, and an unknown one becomes In Stock."""
    edits = _item_edits(t).withColumn("status_text", F.lit("Sold out"))
    inv, _ = IM.apply_item_edits(edits, t.inventory_items, t.categories, "User")
    return flat(inv.select("id", "barcode", "status", "unit_price"))


def _ingest(t):
    return SI.ingest_sales(IN.carts(t), t.inventory_items, t.sales, t.digital_service_requests)


_INGEST_CTES = f"""{IN.CART_LINES_SQL.strip()},
pl AS (SELECT *, row_number() OVER (PARTITION BY cart_id ORDER BY pos_key, inventory_item_id, quantity, price) - 1 AS pos
       FROM plines),
plk AS (SELECT * FROM pl WHERE inventory_item_id IS NOT NULL AND inventory_item_id <> 0 AND quantity > 0),
chk AS (SELECT plk.*, ii.id AS inv_id, ii.name AS inv_name, {_NORM.format(x='ii.status')} AS inv_status
        FROM plk LEFT JOIN inventory_items ii ON ii.id = plk.inventory_item_id),
bad AS (SELECT cart_id, arg_min(CASE WHEN inv_id IS NULL THEN 'One of the sale items does not exist.'
                                     ELSE inv_name || ' is marked out of stock.' END, pos) AS error
        FROM chk WHERE inv_id IS NULL OR inv_status = 'Out of Stock' GROUP BY cart_id),
nl AS (SELECT cart_id, count(*) AS n FROM (SELECT cart_id FROM plk UNION ALL SELECT cart_id FROM dlines) GROUP BY cart_id),
verdict AS (SELECT o.o_orderkey AS cart_id, 'Staff ' || CAST(o.o_custkey % 5 AS VARCHAR) AS employee_name,
                   CASE WHEN nl.n IS NULL THEN 'Add at least one item to the sale.' ELSE bad.error END AS error
            FROM orders o LEFT JOIN nl ON nl.cart_id = o.o_orderkey LEFT JOIN bad ON bad.cart_id = o.o_orderkey),
acc AS (SELECT cart_id, employee_name,
               (SELECT max(id) FROM sales) + row_number() OVER (ORDER BY cart_id) AS sale_id
        FROM verdict WHERE error IS NULL)"""


@register("sale_ingest_lines", with_views(f"""
WITH {_INGEST_CTES}
SELECT acc.sale_id, chk.inventory_item_id, chk.inv_name AS item_name, CAST(chk.pos AS BIGINT) AS line_no,
       CAST(CAST(chk.quantity AS DECIMAL(18,3)) AS DOUBLE) AS quantity,
       CAST(CAST(chk.price AS DECIMAL(18,2)) AS DOUBLE) AS price,
       CAST(CAST(chk.quantity * chk.price AS DECIMAL(18,2)) AS DOUBLE) AS total
FROM chk JOIN acc ON acc.cart_id = chk.cart_id""", "inventory_items", "sales"))
def sale_ingest_lines(t):
    """DM3: product lines of the accepted sales."""
    return flat(_ingest(t).sale_items)


@register("sale_ingest_rejects", with_views(f"""
WITH {_INGEST_CTES}
SELECT cart_id, error FROM verdict WHERE error IS NOT NULL""", "inventory_items", "sales"))
def sale_ingest_rejects(t):
    """DM3: rejected carts with the reference's message."""
    return flat(_ingest(t).rejects)


_SALE_TABLES = ("sales", "sale_items", "sale_digital_items", "digital_service_requests")


@register("sale_commit_versions", with_views(f"""
WITH {_INGEST_CTES},
added AS (
  SELECT 'sales' AS "table", count(*) AS n FROM acc
  UNION ALL SELECT 'sale_items', count(*) FROM chk JOIN acc ON acc.cart_id = chk.cart_id
  UNION ALL SELECT 'sale_digital_items', count(*) FROM dlines dl JOIN acc ON acc.cart_id = dl.cart_id
  UNION ALL SELECT 'digital_service_requests', count(*) FROM dlines dl JOIN acc ON acc.cart_id = dl.cart_id),
base AS ({" UNION ALL ".join(f"SELECT '{n}' AS t, count(*) AS n FROM {n}" for n in (*_SALE_TABLES, "inventory_items"))})
SELECT CAST(v.version AS BIGINT) AS version, b.t AS "table", CAST(b.n + CASE WHEN v.version = 2 THEN coalesce(a.n, 0) ELSE 0 END AS BIGINT) AS rows,
       CAST(v.version = 1 OR a.n IS NOT NULL AS BIGINT) AS changed
FROM base b CROSS JOIN (VALUES (1), (2)) v(version) LEFT JOIN added a ON a."table" = b.t""",
                                           "inventory_items", *_SALE_TABLES))
def sale_commit_versions(t):
    """DM3 committed: the four tables that a batch of carts changes appear in one
    version; rows of every table and version, counted from what the reader sees."""
    store = VR.commit_tables(t.spark, scratch_path(t.spark, "versions"), t, (*_SALE_TABLES, "inventory_items"))
    SI.commit_sales(store, IN.carts(t))
    seen = None
    for version in store.versions():
        view = store.at(version)
        for name in (*_SALE_TABLES, "inventory_items"):
            n = getattr(view, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(version).cast("long").alias("version"), F.lit(name).alias("table"), "rows")
            seen = n if seen is None else seen.unionByName(n)
    return flat(seen.join(store.history().select("version", "table", "changed"), ["version", "table"]))


@register("sale_ingest_requests", with_views(f"""
WITH {_INGEST_CTES},
d AS (SELECT acc.sale_id, acc.employee_name, dl.* FROM dlines dl JOIN acc ON acc.cart_id = dl.cart_id),
n AS (SELECT d.*, (SELECT max(id) FROM digital_service_requests) + row_number() OVER (ORDER BY sale_id) AS rid FROM d)
SELECT rid AS id, 'EL' || CASE WHEN rid < 10000 THEN lpad(CAST(rid AS VARCHAR), 4, '0') ELSE CAST(rid AS VARCHAR) END AS request_code,
       'eload' AS service_type, 'Pending' AS status, mobile_number, CAST(CAST(quantity * price AS DECIMAL(18,2)) AS DOUBLE) AS amount,
       '' AS request_kind, network, 'regular' AS load_type, load_value, '' AS reference_no, '' AS notes,
       employee_name AS requested_by_name, sale_id
FROM n""", "inventory_items", "sales", "digital_service_requests"))
def sale_ingest_requests(t):
    """DM3: the Pending eLoad requests opened by the accepted sales."""
    return flat(_ingest(t).requests)


@register("sale_ingest_sales", with_views(f"""
WITH {_INGEST_CTES},
tot AS (SELECT cart_id, SUM(CAST(quantity * price AS DECIMAL(38,2))) AS total FROM (
          SELECT cart_id, quantity, price FROM plk
          UNION ALL SELECT cart_id, quantity, price FROM dlines) GROUP BY cart_id)
SELECT acc.sale_id AS id,
       'S' || CASE WHEN acc.sale_id < 10000 THEN lpad(CAST(acc.sale_id AS VARCHAR), 4, '0') ELSE CAST(acc.sale_id AS VARCHAR) END AS transaction_code,
       strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d') AS sale_date, o.o_orderpriority AS payment_method,
       acc.employee_name, CAST(CAST(COALESCE(tot.total, 0) AS DECIMAL(18,2)) AS DOUBLE) AS total_amount, acc.cart_id
FROM acc JOIN orders o ON o.o_orderkey = acc.cart_id LEFT JOIN tot ON tot.cart_id = acc.cart_id""",
                                          "inventory_items", "sales"))
def sale_ingest_sales(t):
    """DM3: the accepted sales with codes and totals."""
    return flat(_ingest(t).sales)


@register("request_transition", with_views(f"""
WITH {IN.TRANSITION_COMMANDS_SQL.strip()},
c AS (SELECT cmds.*, r.status AS s_status, r.service_type AS s_service,
             CASE WHEN trim(cmds.reference_no) <> '' THEN trim(cmds.reference_no) ELSE trim(COALESCE(r.reference_no, '')) END AS eff_ref
      FROM cmds LEFT JOIN digital_service_requests r ON r.id = cmds.request_id),
m AS (SELECT *, CASE WHEN s_status IS NULL THEN 'Request not found.'
                     WHEN action = 'complete' THEN CASE WHEN s_status = 'Completed' THEN 'This request is already completed.'
                                                        WHEN s_status = 'Failed' THEN 'This request was marked as failed.'
                                                        WHEN lower(s_service) = 'gcash' AND eff_ref = '' THEN 'GCash completion requires a reference number.' END
                     ELSE CASE WHEN s_status = 'Completed' THEN 'Completed requests cannot be marked as failed.'
                               WHEN s_status = 'Failed' THEN 'This request is already marked as failed.'
                               WHEN trim(reason) = '' THEN 'Failure reason is required.' END END AS msg0
      FROM c),
w AS (SELECT request_id, command_id AS w_cmd, ts AS w_ts, action AS w_action FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts, command_id) AS rn FROM m WHERE msg0 IS NULL)
      WHERE rn = 1)
SELECT m.command_id, m.request_id,
       CASE WHEN m.command_id = w.w_cmd THEN 'applied'
            WHEN w.w_cmd IS NOT NULL AND (m.ts > w.w_ts OR (m.ts = w.w_ts AND m.command_id > w.w_cmd)) THEN
              CASE WHEN m.action = 'complete' THEN CASE WHEN w.w_action = 'complete' THEN 'This request is already completed.'
                                                        ELSE 'This request was marked as failed.' END
                   ELSE CASE WHEN w.w_action = 'complete' THEN 'Completed requests cannot be marked as failed.'
                             ELSE 'This request is already marked as failed.' END END
            ELSE m.msg0 END AS outcome
FROM m LEFT JOIN w ON w.request_id = m.request_id""", "digital_service_requests"))
def request_transition(t):
    """DM5: two commands per request, outcome per command."""
    _, outcomes = RQ.apply_transitions(t.digital_service_requests, IN.transition_commands(t))
    return flat(outcomes)


@register("request_transition_table", with_views(f"""
WITH {IN.TRANSITION_COMMANDS_SQL.strip()},
judged AS (SELECT cmds.*, CASE WHEN r.status <> 'Pending' THEN false
                               WHEN action = 'complete' THEN r.service_type <> 'gcash' OR trim(r.reference_no) <> ''
                               ELSE trim(cmds.reason) <> '' END AS ok
           FROM cmds JOIN digital_service_requests r ON r.id = cmds.request_id),
won AS (SELECT request_id, arg_min(action, command_id) AS action, arg_min(ts, command_id) AS at, arg_min(reason, command_id) AS why
        FROM judged WHERE ok GROUP BY request_id)
SELECT r.id, CASE WHEN w.action = 'complete' THEN 'Completed' WHEN w.action = 'fail' THEN 'Failed' ELSE r.status END AS status,
       r.reference_no, CASE WHEN w.action = 'complete' THEN 'Staff 9' ELSE r.completed_by_name END AS completed_by_name,
       strftime(CASE WHEN w.action = 'complete' THEN w.at ELSE r.completed_at END, '%Y-%m-%d %H:%M:%S.%f') AS completed_at,
       CASE WHEN w.action = 'fail' THEN w.why ELSE r.failed_reason END AS failed_reason,
       CASE WHEN w.action = 'fail' THEN 'Staff 9' ELSE r.failed_by_name END AS failed_by_name,
       strftime(CASE WHEN w.action = 'fail' THEN w.at ELSE r.failed_at END, '%Y-%m-%d %H:%M:%S.%f') AS failed_at
FROM digital_service_requests r LEFT JOIN won w ON w.request_id = r.id""", "digital_service_requests"))
def request_transition_table(t):
    """DM5: the requests after the commands; rows no command changed keep all."""
    after, _ = RQ.apply_transitions(t.digital_service_requests, IN.transition_commands(t))
    return flat(after.select("id", "status", "reference_no", "completed_by_name", "completed_at", "failed_reason",
                             "failed_by_name", "failed_at"))


@register("request_create", with_views("""
WITH given AS (
  SELECT id AS input_id, service_type, regexp_replace(mobile_number, '[^0-9]', '', 'g') AS digits, status,
         CASE WHEN status = 'Failed' THEN NULL WHEN id % 7 = 0 THEN 'Infinity'::DOUBLE ELSE CAST(amount AS DOUBLE) END AS amount,
         request_kind, reference_no, network, load_type, CASE WHEN status = 'Pending' THEN '' ELSE load_value END AS load_value, requested_by_name
  FROM digital_service_requests),
judged AS (SELECT *, CASE WHEN NOT (length(digits) = 11 AND starts_with(digits, '09')) THEN 'Enter a valid 11-digit mobile number starting with 09.'
                          WHEN service_type = 'gcash' AND amount <= 0 THEN 'Enter a valid GCash amount.'
                          WHEN service_type = 'eload' AND network = '' THEN 'Choose a network for the eload request.'
                          WHEN service_type = 'eload' AND load_value = '' THEN 'Choose a load option for the eload request.'
                          WHEN service_type = 'eload' AND amount <= 0 THEN 'Enter a valid eload amount.'
                          WHEN amount IS NULL OR isinf(amount) THEN 'Amount must be greater than zero.' END AS error FROM given),
made AS (SELECT *, (SELECT max(id) FROM digital_service_requests) + row_number() OVER (ORDER BY input_id) AS id FROM judged WHERE error IS NULL)
SELECT input_id, id, CASE WHEN service_type = 'gcash' THEN 'GC' ELSE 'EL' END || CASE WHEN id < 10000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE CAST(id AS VARCHAR) END AS request_code,
       service_type, 'Pending' AS status, substr(digits, 1, 4) || ' ' || substr(digits, 5, 3) || ' ' || substr(digits, 8, 4) AS mobile_number,
       amount, request_kind, network, load_type, load_value, CASE WHEN service_type = 'gcash' THEN reference_no ELSE '' END AS reference_no,
       requested_by_name, CAST(NULL AS VARCHAR) AS error FROM made
UNION ALL
SELECT input_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM judged WHERE error IS NOT NULL""",
                                    "digital_service_requests"))
def request_create(t):
    """DM4: re-enter every request as a new one (numbers typed with dashes,
    amounts as text, some of them no number or Infinity): the new rows and the
    refusals."""
    r = t.digital_service_requests
    amount = (F.when(F.col("status") == P.FAILED, F.lit("abc")).when(F.col("id") % 7 == 0, F.lit("Infinity"))
               .otherwise(F.col("amount").cast("string")))
    inputs = r.select(F.col("id").alias("input_id"), "service_type",
                      F.concat(F.substring("mobile_number", 1, 4), F.lit("-"), F.expr("substr(mobile_number, 5)")).alias("mobile_number"),
                      amount.alias("amount"), F.col("request_kind").alias("cash_flow"), F.col("reference_no").alias("reference_number"),
                      F.lower("network").alias("network"), "load_type",
                      F.when(F.col("status") == P.PENDING, F.lit("")).otherwise(F.col("load_value")).alias("load_value"),
                      F.lit("").alias("notes"), F.col("requested_by_name"))
    new, rejects = RQ.create_requests(inputs, r)
    new = new.select("input_id", "id", "request_code", "service_type", "status", "mobile_number", "amount", "request_kind",
                     "network", "load_type", "load_value", "reference_no", "requested_by_name").withColumn("error", F.lit(None).cast("string"))
    return flat(new.unionByName(rejects, allowMissingColumns=True))


_RENAMES_SQL = """
s_in AS (SELECT supplier_id, supplier_id * 3 AS rename_id, upper(supplier_name) || ' TRADING' AS new_name FROM suppliers
         UNION ALL SELECT supplier_id, supplier_id * 3 + 1, 'One Name' FROM suppliers WHERE supplier_id % 4 = 0
         UNION ALL SELECT a.supplier_id, a.supplier_id * 3 + 2, b.supplier_name FROM suppliers a JOIN suppliers b ON b.supplier_id = a.supplier_id + 1),
s_chk AS (SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM suppliers o WHERE o.supplier_name = s.new_name AND o.supplier_id <> s.supplier_id) THEN 'taken' END AS e0 FROM s_in s),
s_first AS (SELECT new_name, arg_min(supplier_id, rename_id) AS taker FROM s_chk WHERE e0 IS NULL GROUP BY 1),
s_res AS (SELECT c.*, CASE WHEN e0 IS NOT NULL OR f.taker <> c.supplier_id THEN 'UNIQUE constraint failed: suppliers.supplier_name' END AS error
          FROM s_chk c LEFT JOIN s_first f ON f.new_name = c.new_name),
s_new AS (SELECT supplier_id, arg_max(new_name, rename_id) AS new_name FROM s_res WHERE error IS NULL GROUP BY 1)"""


def _supplier_renames(t):
    """Three renames a supplier: to a name of its own, some to one shared name, and
    to the next supplier's name (refused)."""
    s = t.suppliers
    sid = F.col("supplier_id")
    own = s.select(sid, (sid * 3).alias("rename_id"), F.concat(F.upper("supplier_name"), F.lit(" TRADING")).alias("new_name"))
    shared = s.where(sid % 4 == 0).select(sid, (sid * 3 + 1).alias("rename_id"), F.lit("One Name").alias("new_name"))
    nxt = s.select((sid - 1).alias("_prev"), F.col("supplier_name").alias("new_name"))
    taken = s.join(nxt, sid == F.col("_prev")).select(sid, (sid * 3 + 2).alias("rename_id"), "new_name")
    return own.unionByName(shared).unionByName(taken)


@register("rename_cascade", with_views(f"""
WITH {_RENAMES_SQL.strip()},
smap AS (SELECT supplier_name AS old, new_name AS new FROM s_new JOIN suppliers USING (supplier_id)),
cmap AS (SELECT category_name AS old, lower(category_name) || ' goods' AS new FROM categories)
SELECT i.id, COALESCE(s.new, i.supplier) AS supplier, COALESCE(c.new, i.category) AS category
FROM inventory_items i LEFT JOIN smap s ON s.old = i.supplier LEFT JOIN cmap c ON c.old = i.category""",
                                       "inventory_items", "suppliers", "categories"))
def rename_cascade(t):
    """DM6: rename suppliers and every category; the inventory follows, one row
    an item."""
    c_ren = t.categories.select("category_id", F.concat(F.lower("category_name"), F.lit(" goods")).alias("new_name"))
    _, inv, _ = RF.rename_suppliers(_supplier_renames(t), t.suppliers, t.inventory_items)
    _, inv, _ = RF.rename_categories(c_ren, t.categories, inv)
    return flat(inv.select("id", "supplier", "category"))


@register("rename_suppliers_table", with_views(f"""
WITH {_RENAMES_SQL.strip()}
SELECT supplier_id, coalesce(n.new_name, supplier_name) AS supplier_name, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS BIGINT) AS rename_id
FROM suppliers LEFT JOIN s_new n USING (supplier_id)
UNION ALL SELECT supplier_id, NULL, error, rename_id FROM s_res WHERE error IS NOT NULL""", "suppliers"))
def rename_suppliers_table(t):
    """DM6: the suppliers afterwards (names unique) and the refused renames."""
    table, _, rejects = RF.rename_suppliers(_supplier_renames(t), t.suppliers, t.inventory_items)
    return flat(table.select("supplier_id", "supplier_name").unionByName(rejects, allowMissingColumns=True))


@register("supplier_removed", with_views("""
WITH gone AS (SELECT s_name AS name FROM supplier WHERE s_acctbal < 0)
SELECT i.id, CASE WHEN i.supplier IN (SELECT name FROM gone) THEN '' ELSE i.supplier END AS supplier
FROM inventory_items i""", "inventory_items"))
def supplier_removed(t):
    """DM7: remove the suppliers with a negative balance; their items keep a
    blank supplier."""
    removed = t.raw("supplier").filter(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("supplier_id"))
    _, inv = RF.remove_suppliers(removed, t.suppliers, t.inventory_items)
    return flat(inv.select("id", "supplier"))


@register("users_upsert", with_views(f"""
WITH changes AS (
  SELECT 'user' || CAST(c_custkey AS VARCHAR) AS username, trim(c_name || ' ') AS full_name,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'User' ELSE 'Admin' END AS role, CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END AS is_active, 1 AS ts FROM customer
  UNION ALL
  SELECT 'clerk' || CAST(c_custkey AS VARCHAR), c_name, 'Admin', 1, 2 FROM customer WHERE c_nationkey = 3
  UNION ALL
  SELECT 'user' || CAST(c_custkey AS VARCHAR), c_name || ' Jr', 'Admin', 1, 2 FROM customer WHERE c_nationkey = 4),
last AS (SELECT username, arg_max(full_name, ts) AS full_name, arg_max(role, ts) AS role, arg_max(is_active, ts) AS is_active FROM changes GROUP BY 1),
numbered AS (SELECT l.*, coalesce(u.id, (SELECT max(id) FROM users) + row_number() OVER (PARTITION BY u.id IS NULL ORDER BY l.username)) AS id
             FROM last l LEFT JOIN users u ON u.username = l.username),
gone AS (SELECT d.user_id, count(*) AS n FROM user_devices d JOIN numbered n ON n.id = d.user_id
         WHERE n.is_active = 0 AND d.revoked_at IS NULL GROUP BY 1)
SELECT n.id, n.username, n.full_name, n.role, CAST(n.is_active AS BIGINT) AS is_active, CAST(coalesce(g.n, 0) AS BIGINT) AS revoked_now
FROM numbered n LEFT JOIN gone g ON g.user_id = n.id""", "users", "user_devices"))
def users_upsert(t):
    """DM10: replay every customer as a user change (negative balances become
    inactive), later changes of some, and new users; with the devices each
    deactivation revokes."""
    c = t.raw("customer")
    name = F.concat(F.lit(" User"), F.col("c_custkey").cast("string"))
    base = c.select(name.alias("username"), F.concat(F.col("c_name"), F.lit(" ")).alias("full_name"),
                    F.when(F.col("c_mktsegment") == "BUILDING", F.lit("user")).otherwise(F.lit("admin")).alias("role"),
                    F.when(F.col("c_acctbal") < 0, F.lit(0)).otherwise(F.lit(1)).alias("is_active"), F.lit(1).alias("ts"))
    fresh = c.where("c_nationkey = 3").select(F.concat(F.lit("Clerk"), F.col("c_custkey").cast("string")).alias("username"),
                                              F.col("c_name").alias("full_name"), F.lit("x").alias("role"), F.lit(1).alias("is_active"), F.lit(2).alias("ts"))
    later = c.where("c_nationkey = 4").select(name.alias("username"), F.concat("c_name", F.lit(" Jr")).alias("full_name"), F.lit("Admin").alias("role"),
                                              F.lit(1).alias("is_active"), F.lit(2).alias("ts"))
    users, devices, _ = RF.upsert_users(base.unionByName(fresh).unionByName(later), t.users, t.user_devices, P.DEVICE_NOW)
    before = t.user_devices.where("revoked_at is null").select("id")
    revoked = (devices.where("revoked_at is not null").join(before, "id", "left_semi").groupBy("user_id")
               .agg(F.count(F.lit(1)).alias("n")))
    return flat(users.join(revoked, users.id == revoked.user_id, "left")
                .select("id", "username", "full_name", "role", "is_active", F.coalesce("n", F.lit(0)).alias("revoked_now")))


@register("integrity_audit", with_views(f"""
WITH promos AS (SELECT network_name, promo_name, CAST(COALESCE(CAST(regexp_extract_all(promo_name, '(\\d+(\\.\\d+)?)', 1)[-1] AS DOUBLE), 0.0) AS DECIMAL(18,2)) AS selling_price
                FROM (VALUES {", ".join(f"('{n}', '{p}')" for n, ps in C.DEFAULT_NETWORKS.items() for p in ps)}) v(network_name, promo_name)),
lines AS (SELECT sale_id, total FROM sale_items UNION ALL SELECT sale_id, total FROM sale_digital_items),
per_sale AS (SELECT sale_id, SUM(total) AS t FROM lines GROUP BY sale_id)
SELECT 'duplicate_inventory_id' AS rule, CAST((SELECT count(*) FROM (SELECT id FROM inventory_items GROUP BY 1 HAVING count(*) > 1)) AS BIGINT) AS violations
UNION ALL SELECT 'duplicate_sale_id', (SELECT count(*) FROM (SELECT id FROM sales GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'duplicate_request_id', (SELECT count(*) FROM (SELECT id FROM digital_service_requests GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'duplicate_barcode', (SELECT count(*) FROM (SELECT trim(barcode) FROM inventory_items GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'duplicate_transaction_code', (SELECT count(*) FROM (SELECT transaction_code FROM sales GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'duplicate_request_code', (SELECT count(*) FROM (SELECT request_code FROM digital_service_requests GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'duplicate_category_name_nocase', (SELECT count(*) FROM (SELECT lower(category_name) FROM categories GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'duplicate_supplier_name', (SELECT count(*) FROM (SELECT supplier_name FROM suppliers GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'duplicate_username_nocase', (SELECT count(*) FROM (SELECT lower(username) FROM users GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'duplicate_network_name_nocase', (SELECT count(*) FROM (SELECT lower(network_name) FROM (SELECT DISTINCT network_name FROM promos) GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'orphan_sale_item_sale', (SELECT count(*) FROM sale_items si WHERE si.sale_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sales s WHERE s.id = si.sale_id))
UNION ALL SELECT 'orphan_sale_item_product', (SELECT count(*) FROM sale_items si WHERE si.inventory_item_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM inventory_items i WHERE i.id = si.inventory_item_id))
UNION ALL SELECT 'orphan_digital_item_sale', (SELECT count(*) FROM sale_digital_items d WHERE d.sale_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sales s WHERE s.id = d.sale_id))
UNION ALL SELECT 'orphan_device_user', (SELECT count(*) FROM user_devices d WHERE d.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = d.user_id))
UNION ALL SELECT 'unknown_inventory_category', (SELECT count(*) FROM inventory_items i WHERE i.category IS NOT NULL AND NOT EXISTS (SELECT 1 FROM categories c WHERE c.category_name = i.category))
UNION ALL SELECT 'sale_total_not_lines', (SELECT count(*) FROM sales s LEFT JOIN per_sale p ON p.sale_id = s.id WHERE s.total_amount <> COALESCE(p.t, 0))
UNION ALL SELECT 'multiple_active_devices', (SELECT count(*) FROM (SELECT user_id FROM user_devices WHERE revoked_at IS NULL GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'duplicate_promo_of_network', (SELECT count(*) FROM (SELECT network_name, promo_name FROM promos GROUP BY 1, 2 HAVING count(*) > 1))
UNION ALL SELECT 'promo_price_not_positive', (SELECT count(*) FROM promos WHERE selling_price <= 0)""",
                                        "inventory_items", "sales", "sale_items", "sale_digital_items",
                                        "digital_service_requests", "categories", "suppliers", "users", "user_devices"))
def integrity_audit(t):
    """DM8: constraint checks as counts."""
    return flat(AU.integrity_audit(t, C.default_promos(t.spark)))


@register("barcode_backfill", with_views(f"""
WITH RECURSIVE {IN.BACKFILL_ITEMS_SQL.strip()},
walk_items AS (SELECT id, trim(barcode) AS code, row_number() OVER (ORDER BY id) AS p FROM items),
walk(p, id, code, final, used) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', '', CAST([] AS VARCHAR[])
  UNION ALL
  SELECT n.p, n.id, n.code, n.final, list_append(n.used, n.final)
  FROM (SELECT i.p, i.id, i.code, w.used,
               CASE WHEN i.code <> '' AND NOT list_contains(w.used, i.code) THEN i.code
                    WHEN NOT list_contains(w.used, 'LEGACY-' || CAST(i.id AS VARCHAR)) THEN 'LEGACY-' || CAST(i.id AS VARCHAR)
                    ELSE 'LEGACY-' || CAST(i.id AS VARCHAR) || '-' || CAST(i.p AS VARCHAR) END AS final
        FROM walk w JOIN walk_items i ON i.p = w.p + 1) n)
SELECT id, code AS old_barcode, final AS barcode FROM walk WHERE p > 0""", "inventory_items"))
def barcode_backfill(t):
    """DM9 / WN3: unique barcodes for items with blank or repeated ones."""
    return flat(IM.barcode_backfill(IN.backfill_items(t)))


@register("schema_backfill", with_views("""
SELECT id, 'LEGACY-' || CAST(id AS VARCHAR) AS barcode, name, category, '' AS supplier,
       CASE WHEN stock_quantity <= 0 THEN 'Out of Stock' WHEN stock_quantity <= reorder_level THEN 'Low Stock'
            ELSE 'In Stock' END AS status,
       CAST(stock_quantity AS BIGINT) AS stock_quantity, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(selling_price AS DOUBLE) AS selling_price, CAST(reorder_level AS BIGINT) AS reorder_level
FROM inventory_items""", "inventory_items"))
def schema_backfill(t):
    """DM9: an inventory table from before the supplier, status and barcode
    columns existed, brought up to the canonical schema."""
    from tillpoint.jobs.schema import backfill_schema
    old = t.inventory_items.drop("supplier", "status", "barcode")
    return flat(backfill_schema(old, "inventory_items"))


@register("schema_backfill_requests", with_views("""
SELECT id, request_code, status, notes, '' AS failed_reason, '' AS failed_by_name, CAST(NULL AS VARCHAR) AS failed_at,
       mobile_number AS caller
FROM digital_service_requests""", "digital_service_requests"))
def schema_backfill_requests(t):
    """DM9: a requests table from before the failure columns existed; a column the
    schema does not know stays."""
    from tillpoint.jobs.schema import backfill_schema
    old = (t.digital_service_requests.withColumn("caller", F.col("mobile_number"))
           .drop("failed_reason", "failed_by_name", "failed_at"))
    out = backfill_schema(old, "digital_service_requests")
    return flat(out.select("id", "request_code", "status", "notes", "failed_reason", "failed_by_name", "failed_at", "caller"))


def _network_table(spark):
    """The seeded networks (6 rows) from the fixed catalogue."""
    return C.default_promos(spark).select("network_id", "network_name").distinct()


_REF_INPUTS_SQL = """
cat_in AS (SELECT p_partkey AS input_id,
                  trim(CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN upper(p_type) ELSE ' ' END) AS name
           FROM part),
net_in AS (SELECT c_custkey AS input_id,
                  upper(trim(CASE WHEN c_nationkey = 0 THEN ' globe ' WHEN c_nationkey = 1 THEN '' ELSE lower(c_mktsegment) END)) AS name
           FROM customer),
sup_in AS (SELECT s_suppkey AS input_id, trim(CASE WHEN s_acctbal < 0 THEN '  ' WHEN s_nationkey < 5 THEN s_name
                                                   WHEN s_nationkey < 15 THEN 'Supply ' || CAST(s_nationkey AS VARCHAR) ELSE s_name || ' supply ' END) AS name
           FROM supplier),
pro_in AS (SELECT o_orderkey AS input_id, o_custkey % 8 AS network_id, trim(o_orderpriority) AS name,
                  CASE WHEN o_orderstatus = 'P' THEN '0' ELSE CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) END AS price
           FROM orders)"""


def _unique_sql(kind: str, inp: str, taken: str, required: str, exists: str, max_id: str) -> str:
    return f"""
{kind}_chk AS (SELECT input_id, name, CASE WHEN name = '' THEN '{required}' END AS e0 FROM {inp}),
{kind}_first AS (SELECT lower(name) AS k, min(input_id) AS first_id FROM {kind}_chk WHERE e0 IS NULL GROUP BY 1),
{kind}_res AS (SELECT c.input_id, CASE WHEN e0 IS NOT NULL THEN e0
                                      WHEN lower(c.name) IN ({taken}) OR c.input_id <> f.first_id THEN '{exists}' END AS error
               FROM {kind}_chk c LEFT JOIN {kind}_first f ON f.k = lower(c.name)),
{kind}_out AS (SELECT '{kind}' AS kind, input_id, error,
                      CASE WHEN error IS NULL THEN ({max_id}) + row_number() OVER (PARTITION BY error IS NULL ORDER BY input_id) END AS new_id
               FROM {kind}_res)"""


_NETS_SQL = ", ".join(f"({i}, '{n}')" for i, n in enumerate(C.DEFAULT_NETWORKS, start=1))


@register("reference_create", with_views(f"""
WITH {_REF_INPUTS_SQL.strip()},
nets AS (SELECT * FROM (VALUES {_NETS_SQL}) v(network_id, network_name)),
{_unique_sql('category', 'cat_in', 'SELECT lower(category_name) FROM categories', 'Category name is required.',
             'Category name already exists.', 'SELECT max(category_id) FROM categories').strip()},
{_unique_sql('network', 'net_in', 'SELECT lower(network_name) FROM nets', 'Network name is required.',
             'Network already exists.', 'SELECT max(network_id) FROM nets').strip()},
sup_chk AS (SELECT input_id, name, CASE WHEN name = '' THEN 'Supplier name is required.' END AS e0 FROM sup_in),
sup_res AS (SELECT input_id, CASE WHEN e0 IS NOT NULL THEN e0
                                  WHEN name IN (SELECT supplier_name FROM suppliers)
                                       OR input_id <> min(input_id) OVER (PARTITION BY name, e0 IS NULL) THEN 'UNIQUE constraint failed: suppliers.supplier_name' END AS error
            FROM sup_chk),
supplier_out AS (SELECT 'supplier' AS kind, input_id, error,
                        CASE WHEN error IS NULL THEN (SELECT max(supplier_id) FROM suppliers)
                             + row_number() OVER (PARTITION BY error IS NULL ORDER BY input_id) END AS new_id FROM sup_res),
pro_chk AS (SELECT p.input_id, p.network_id, p.name,
                   CASE WHEN n.network_id IS NULL THEN 'Network not found.' WHEN p.name = '' THEN 'Promo name is required.'
                        WHEN NOT (COALESCE(TRY_CAST(p.price AS DOUBLE), 0) > 0) THEN 'Selling price must be greater than zero.' END AS e0
            FROM pro_in p LEFT JOIN nets n ON n.network_id = p.network_id),
pro_res AS (SELECT input_id, CASE WHEN e0 IS NOT NULL THEN e0
                                  WHEN input_id <> min(input_id) OVER (PARTITION BY network_id, name, e0 IS NULL)
                                  THEN 'UNIQUE constraint failed: eload_promos.network_id, eload_promos.promo_name' END AS error
            FROM pro_chk),
promo_out AS (SELECT 'promo' AS kind, input_id, error,
                     CASE WHEN error IS NULL THEN 24 + row_number() OVER (PARTITION BY error IS NULL ORDER BY input_id) END AS new_id
              FROM pro_res)
SELECT kind, input_id, error, CAST(new_id AS BIGINT) AS new_id FROM category_out
UNION ALL SELECT kind, input_id, error, CAST(new_id AS BIGINT) FROM network_out
UNION ALL SELECT kind, input_id, error, CAST(new_id AS BIGINT) FROM supplier_out
UNION ALL SELECT kind, input_id, error, CAST(new_id AS BIGINT) FROM promo_out""", "categories", "suppliers"))
def reference_create(t):
    """DM10: create suppliers, categories, eLoad networks and promos from
    inputs derived from whole tables (blank, duplicate, unknown-network and
    zero-price inputs included); one row per input with its new id or error."""
    part, cust, supp, orders = t.raw("part"), t.raw("customer"), t.raw("supplier"), t.raw("orders")
    cat_in = part.select(F.col("p_partkey").alias("input_id"),
                         F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))
                          .when(F.col("p_size") % 3 == 1, F.upper("p_type")).otherwise(F.lit(" ")).alias("category_name"))
    net_in = cust.select(F.col("c_custkey").alias("input_id"),
                         F.when(F.col("c_nationkey") == 0, F.lit(" globe ")).when(F.col("c_nationkey") == 1, F.lit(""))
                          .otherwise(F.lower("c_mktsegment")).alias("network_name"))
    sup_in = supp.select(F.col("s_suppkey").alias("input_id"),
                         F.when(F.col("s_acctbal") < 0, F.lit("  ")).when(F.col("s_nationkey") < 5, F.col("s_name"))
                          .when(F.col("s_nationkey") < 15, F.concat(F.lit("Supply "), F.col("s_nationkey").cast("string")))
                          .otherwise(F.concat(F.col("s_name"), F.lit(" supply "))).alias("supplier_name"),
                         F.lit("").alias("contact_no"), F.lit("").alias("address"))
    pro_in = orders.select(F.col("o_orderkey").alias("input_id"), (F.col("o_custkey") % 8).alias("network_id"),
                           F.col("o_orderpriority").alias("promo_name"),
                           F.when(F.col("o_orderstatus") == "P", F.lit("0"))
                            .otherwise(F.floor(F.col("o_totalprice") / 1000).cast("bigint").cast("string")).alias("selling_price"))
    return flat(_reference_outcomes(t, cat_in, net_in, sup_in, pro_in))


def _reference_outcomes(t, cat_in, net_in, sup_in, pro_in):
    """New rows carry their input id and new id; rejects carry the message."""
    promos = C.default_promos(t.spark).select("network_id", "network_name", "promo_id", "promo_name", "selling_price")
    networks = _network_table(t.spark)
    parts = []
    for kind, fn, inp, old, args in (
            ("category", RF.create_categories, cat_in, t.categories, ()),
            ("network", RF.create_networks, net_in, networks, ()),
            ("supplier", RF.create_suppliers, sup_in, t.suppliers, ()),
            ("promo", RF.create_promos, pro_in, promos, (networks,))):
        _, rej, made = fn(inp, old, *args)
        parts.append(made.select(F.lit(kind).alias("kind"), "input_id", F.lit(None).cast("string").alias("error"),
                                 "new_id"))
        parts.append(rej.select(F.lit(kind).alias("kind"), "input_id", "error",
                                F.lit(None).cast("bigint").alias("new_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("request_board_diff", with_views(f"""
WITH {IN.TRANSITION_COMMANDS_SQL.strip()}
SELECT DISTINCT r.id, 'changed' AS change FROM digital_service_requests r JOIN cmds ON cmds.request_id = r.id
WHERE r.status = 'Pending' AND (CASE WHEN action = 'complete' THEN r.service_type <> 'gcash' OR trim(r.reference_no) <> '' ELSE trim(reason) <> '' END)""",
                                         "digital_service_requests"))
def request_board_diff(t):
    """AG14: what changed on the request board after the DM5 commands."""
    from tillpoint.operators.digital import fingerprint_diff
    after, _ = RQ.apply_transitions(t.digital_service_requests, IN.transition_commands(t))
    return flat(fingerprint_diff(t.digital_service_requests, after).select("id", "change"))
