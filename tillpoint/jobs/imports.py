"""DM1 / DM2 / DM9 / DM11: product import preview and apply, item edits,
and the barcode backfill.

Row-by-row lookups of the reference become joins: the match by barcode
is an equi-join on the (unique) barcode; the match by name for a blank
barcode joins a per-name aggregate (lowest id wins); the category check
is a join on the category names. The first failing rule per row is an
ordered ``when`` chain. "First valid row per barcode wins" is a grouped
minimum joined back, not a per-barcode window. Uniqueness rules (barcodes
of a batch, edits of one item) are keyed minimums and maximums as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.normalize import ascii_lower, js_trim, normalize_item_status, text_or_empty
from tillpoint.operators.windows import global_row_number

# -- fixed values: validation messages ----------------------------------------
MSG_BARCODE_REQUIRED = "Barcode is required."
MSG_BARCODE_TAKEN = "Barcode already exists."
MSG_NAME_REQUIRED = "Product name is required."
MSG_CATEGORY_REQUIRED = "Category is required."
MSG_CATEGORY_UNKNOWN = "Choose a valid category from Settings."
MSG_PRICES = "Unit Price and Selling Price must be valid non-negative numbers."
MSG_WHOLE = "Stock Quantity and Reorder Level must be non-negative whole numbers."
MSG_STATUS = "Status must be In Stock, Low Stock, or Out of Stock."
MSG_DUPLICATE = "Barcode is duplicated in this CSV."
STATUS_WORDS = ("in stock", "low stock", "low-stock", "out of stock", "out-of-stock")

# -- fixed values: number syntax accepted by the reference's Number() ---------
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITY = r"^[+-]?Infinity$"
_HEX, _BIN, _OCT = r"^0[xX][0-9a-fA-F]+$", r"^0[bB][01]+$", r"^0[oO][0-7]+$"

PRODUCT_COLUMNS = ("barcode", "name", "category", "supplier", "status", "stock_quantity",
                   "unit_price", "selling_price", "reorder_level")


def js_number(c) -> Column:
    """Text -> DOUBLE the way ``Number(text)`` reads it; NULL for NaN.

    Blank is 0; plain decimals and exponents; ``Infinity``; 0x / 0b / 0o
    integers. Spark's own cast would also take ``1d``, ``1f`` or ``NaN``,
    so the text is checked against these forms first.
    """
    t = js_trim(text_or_empty(c))
    inf = F.lit(float("inf"))

    def radix(base):  # digit by digit in DOUBLE: no length overflows
        digits = F.filter(F.split(F.lower(F.substr(t, F.lit(3))), ""), lambda d: d != "")
        return F.aggregate(digits, F.lit(0.0), lambda v, d: v * base + F.instr(F.lit("0123456789abcdef"), d) - 1)
    return (F.when(t == "", F.lit(0.0))
             .when(t.rlike(_DECIMAL), t.try_cast("double"))
             .when(t.rlike(_INFINITY), F.when(t.startswith("-"), -inf).otherwise(inf))
             .when(t.rlike(_HEX), radix(16)).when(t.rlike(_BIN), radix(2)).when(t.rlike(_OCT), radix(8))
             .otherwise(F.lit(None).cast("double")))


# what the stored columns hold: whole numbers of 64 bits, money of 16 digits
WHOLE_LIMIT, MONEY_LIMIT = float(1 << 63), 1e16


def _finite(v: Column) -> Column:
    return v.isNotNull() & (v != float("inf")) & (v != float("-inf"))


def stored_codes(inventory: DataFrame) -> DataFrame:
    """``_code, _id, _max``: the first and last item of each stored barcode (stored
    barcodes should be unique, but nothing in Spark enforces it)."""
    return (inventory.groupBy(js_trim(F.col("barcode")).alias("_code"))
            .agg(F.min("id").alias("_id"), F.max("id").alias("_max")))


def validate_products(rows: DataFrame, inventory: DataFrame, categories: DataFrame, existing_id) -> DataFrame:
    """The shared DM1 / DM11 rule chain. ``existing_id`` is a Column, or a function
    of the Column with the stored owner of the row's barcode. Adds typed product
    columns, ``existing_id`` and ``error``; one join finds both the row's own item
    and a barcode that another item owns."""
    cats = categories.select(F.col("category_name").alias("_cat")).distinct()
    r = (rows.join(stored_codes(inventory), F.col("barcode") == F.col("_code"), "left")
             .join(cats, F.col("category") == F.col("_cat"), "left"))
    r = r.withColumn("existing_id", existing_id(F.col("_id")) if callable(existing_id) else existing_id)
    unit, sell = js_number(F.col("unit_price_text")), js_number(F.col("selling_price_text"))
    stock, reorder = js_number(F.col("stock_text")), js_number(F.col("reorder_text"))
    # a number too large to store is a row error like any other
    whole = lambda v: F.coalesce(_finite(v) & (v >= 0) & (v < WHOLE_LIMIT) & (v % 1 == 0), F.lit(False))
    price = lambda v: F.coalesce(_finite(v) & (v >= 0) & (v < MONEY_LIMIT), F.lit(False))
    status_raw = js_trim(text_or_empty(F.col("status_text")))
    own = F.coalesce(F.col("existing_id"), F.lit(0))
    error = (F.when(F.col("barcode") == "", F.lit(MSG_BARCODE_REQUIRED))
              .when((F.col("_id") != own) | (F.col("_max") != own), F.lit(MSG_BARCODE_TAKEN))
              .when(F.col("name") == "", F.lit(MSG_NAME_REQUIRED))
              .when(F.col("category") == "", F.lit(MSG_CATEGORY_REQUIRED))
              .when(F.col("_cat").isNull(), F.lit(MSG_CATEGORY_UNKNOWN))
              .when(~(price(unit) & price(sell)), F.lit(MSG_PRICES))
              .when(~(whole(stock) & whole(reorder)), F.lit(MSG_WHOLE))
              .when((status_raw != "") & ~F.lower(status_raw).isin(*STATUS_WORDS), F.lit(MSG_STATUS)))
    return (r.withColumn("error", error)
             .withColumn("unit_price", unit).withColumn("selling_price", sell)
             .withColumn("stock_quantity", F.when(whole(stock), stock.try_cast("bigint")))
             .withColumn("reorder_level", F.when(whole(reorder), reorder.try_cast("bigint")))
             .withColumn("status", normalize_item_status(status_raw))
             .drop("_code", "_id", "_max", "_cat"))


def preview_import(rows: DataFrame, inventory: DataFrame, categories: DataFrame) -> DataFrame:
    """DM1: one output row per parsed CSV row.

    ``rows`` is SC2's output. A file with any parse error is not validated
    (its rows carry only the parse errors), as in the reference. The checked rows
    are written once; the duplicate rule reads back only their keys.
    """
    from tillpoint.session import cut_lineage

    bad = rows.where("error is not null").select("file").distinct().withColumn("_bad", F.lit(True))
    trimmed = {c: js_trim(text_or_empty(F.col(c))) for c in ("barcode", "name", "category", "supplier")}
    base = rows.join(bad, "file", "left").where("_bad is null or error is not null").select(
        "file", "row_number", F.col("error").alias("_parse"), trimmed["barcode"].alias("raw_barcode"),
        *[trimmed[c].alias(c) for c in ("name", "category", "supplier")],
        F.col("stock_quantity").alias("stock_text"), F.col("unit_price").alias("unit_price_text"),
        F.col("selling_price").alias("selling_price_text"), F.col("reorder_level").alias("reorder_text"),
        F.col("status").alias("status_text"))
    by_name = (inventory.groupBy(ascii_lower(F.col("name")).alias("_nm"))
               .agg(F.min_by(F.struct("id", "barcode"), F.col("id")).alias("_m")))
    named = base.join(by_name, (F.col("raw_barcode") == "") & (ascii_lower(F.col("name")) == F.col("_nm")), "left")
    named = named.withColumn("barcode", js_trim(F.when(F.col("raw_barcode") != "", F.col("raw_barcode"))
                                                .otherwise(text_or_empty(F.col("_m.barcode")))))
    checked = validate_products(named, inventory, categories,
                                lambda owner: F.when(F.col("raw_barcode") != "", owner).otherwise(F.col("_m.id")))
    checked = cut_lineage(checked.select("file", "row_number", "_parse", *PRODUCT_COLUMNS, "existing_id", "error"))
    firsts = (checked.where("_parse is null and error is null").groupBy("file", "barcode")
              .agg(F.min("row_number").alias("_first")))
    checked = checked.join(firsts, ["file", "barcode"], "left")
    error = F.when(F.col("error").isNull() & (F.col("row_number") != F.col("_first")), F.lit(MSG_DUPLICATE)).otherwise(F.col("error"))
    parsed = F.col("_parse").isNull()
    return checked.select(
        "file", "row_number", *[F.when(parsed, F.col(c)).alias(c) for c in (*PRODUCT_COLUMNS, "existing_id")],
        F.when(~parsed, F.col("_parse"))
         .when(error.isNotNull(), F.concat(F.lit("Row "), F.col("row_number").cast("string"), F.lit(": "), error)).alias("error"))


def first_errors(preview: DataFrame, k: int = 12) -> DataFrame:
    """SO12: the first ``k`` errors in file and row order, each with the number of
    errors that are not shown ("and N more")."""
    errors = preview.filter(F.col("error").isNotNull())
    total = errors.select(F.count(F.lit(1))).scalar()
    return (errors.orderBy("file", F.col("row_number").asc_nulls_first()).limit(k).select("file", "row_number", "error")
            .withColumn("more", F.greatest(total - k, F.lit(0).cast("bigint"))))


def preview_summary(preview: DataFrame) -> DataFrame:
    """AG13: per file total rows, new, existing and error counts."""
    valid = F.col("error").isNull()
    return preview.groupBy("file").agg(
        F.count_if(F.col("row_number").isNotNull()).alias("total"),
        F.count_if(valid & F.col("existing_id").isNull()).alias("new_products"),
        F.count_if(valid & F.col("existing_id").isNotNull()).alias("existing_products"),
        F.count_if(~valid).alias("errors"))


def apply_import(preview: DataFrame, inventory: DataFrame, mode: str = "skip") -> tuple[DataFrame, DataFrame]:
    """DM2: apply the previews of a batch of files, one file after another in
    name order, each all or nothing. Returns ``(new_inventory, summary)`` with
    one row a file: ``file, created, updated, skipped``.

    A file with any error, or without a product, changes nothing (its counts are
    zero); the other files are applied. A barcode in two files is a new product
    of the first and an existing one for the second, so with ``update`` the last
    file's values stay. New products get ids after the current maximum in file /
    row order.
    """
    from tillpoint.session import cut_lineage

    # the preview feeds the gate, the classes, the numbering and the counts:
    # write it once instead of recomputing its joins each time
    preview = cut_lineage(preview)
    files = preview.groupBy("file").agg(F.max(F.col("error").isNotNull()).alias("bad"))
    fit = files.where(~F.col("bad")).select("file")
    codes = stored_codes(inventory).drop("_max")
    place = F.struct("file", "row_number")
    # one keyed pass: whether a product is stored, and the first and last place of
    # its barcode in the batch
    products = preview.join(fit, "file", "left_semi").join(codes, F.col("barcode") == F.col("_code"), "left").drop("_code")
    values = F.struct(*PRODUCT_COLUMNS)
    per_code = products.groupBy("barcode").agg(F.min("_id").alias("_id"), F.min(place).alias("_first"),
                                               F.min_by(values, place).alias("_old"), F.max_by(values, place).alias("_new"))
    outcome = products.join(per_code.select(F.col("barcode").alias("_code"), "_first"), F.col("barcode") == F.col("_code"))
    created = F.col("_id").isNull() & (place == F.col("_first"))
    counts = outcome.groupBy("file").agg(F.count_if(created).alias("created"), F.count_if(~created).alias("again"))
    n = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    summary = files.join(counts, "file", "left").select(
        "file", n(F.col("created")).alias("created"),
        (n(F.col("again")) if mode == "update" else F.lit(0).cast("bigint")).alias("updated"),
        (n(F.col("again")) if mode != "update" else F.lit(0).cast("bigint")).alias("skipped"))

    kept_values = "_new" if mode == "update" else "_old"
    inv = inventory.select("id", *PRODUCT_COLUMNS)
    if mode == "update":
        upd = _stored(per_code.where(F.col("_id").isNotNull()).select(F.col("_id").alias("id"), "_new.*"))
        inv = inv.join(upd.select("id"), "id", "left_anti").unionByName(upd)
    max_id = inventory.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = global_row_number(per_code.where(F.col("_id").isNull()), [F.col("_first")], "_n")
    new_rows = _stored(numbered.select((max_id + F.col("_n")).alias("id"), f"{kept_values}.*"))
    return inv.unionByName(new_rows), summary


def commit_import(store, rows: DataFrame, mode: str = "skip") -> tuple[int, DataFrame]:
    """DM1 + DM2 on a :class:`~tillpoint.sinks.versions.VersionedTables`: preview the
    files against the current version, apply them and publish the new inventory. An
    import that met another commit is previewed again. Returns ``(version, summary)``."""
    def job(view):
        preview = preview_import(rows, view.inventory_items, view.categories)
        inventory, summary = apply_import(preview, view.inventory_items, mode)
        return {"inventory_items": inventory}, summary

    return store.update(job, name=f"import ({mode})")


def _stored(rows: DataFrame) -> DataFrame:
    """Validated product rows in the stored types."""
    money = "decimal(18,2)"
    return rows.select("id", "barcode", "name", "category", "supplier", "status", "stock_quantity",
                       F.col("unit_price").cast(money).alias("unit_price"),
                       F.col("selling_price").cast(money).alias("selling_price"), "reorder_level")


def apply_item_edits(edits: DataFrame, inventory: DataFrame, categories: DataFrame,
                     role: str) -> tuple[DataFrame, DataFrame]:
    """DM11: edits ``edit_id, id, barcode, name, category, supplier, stock_text,
    unit_price_text, selling_price_text, reorder_text, status_text``; ``edit_id``
    is their order.

    Admins run every DM1 rule with the item's own id as "existing" (so the
    barcode-owned-by-another rule can fire). Of several valid edits of one item the
    last stays; of several items that take one new barcode the first edit takes it
    and the others are refused. Other roles change the status only, normalised, so
    an unknown status silently becomes In Stock. Returns ``(new_inventory,
    rejects(edit_id, id, error))``; an unknown id is a reject.
    """
    known = edits.join(inventory.select(F.col("id").alias("_known")), F.col("id") == F.col("_known"), "left")
    missing = known.filter(F.col("_known").isNull()).select("edit_id", "id", F.lit("Item not found.").alias("error"))
    ok = known.filter(F.col("_known").isNotNull()).drop("_known")
    base = inventory.select("id", *PRODUCT_COLUMNS)
    if role == "Admin":
        prepared = ok.select("edit_id", "id", js_trim(text_or_empty(F.col("barcode"))).alias("barcode"),
                             js_trim(text_or_empty(F.col("name"))).alias("name"),
                             js_trim(text_or_empty(F.col("category"))).alias("category"),
                             js_trim(text_or_empty(F.col("supplier"))).alias("supplier"),
                             "stock_text", "unit_price_text", "selling_price_text", "reorder_text", "status_text")
        checked = validate_products(prepared, inventory, categories, F.col("id"))
        # the first edit that takes a barcode holds it against other items
        takers = (checked.where("error is null").groupBy("barcode").agg(F.min_by("id", "edit_id").alias("_taker"))
                  .withColumnRenamed("barcode", "_code"))
        checked = (checked.join(takers, F.col("barcode") == F.col("_code"), "left")
                   .withColumn("error", F.when(F.col("error").isNull() & (F.col("_taker") != F.col("id")), F.lit(MSG_BARCODE_TAKEN))
                               .otherwise(F.col("error"))).drop("_code", "_taker"))
        rejects = checked.filter(F.col("error").isNotNull()).select("edit_id", "id", "error")
        last = checked.where("error is null").groupBy("id").agg(F.max_by(F.struct(*PRODUCT_COLUMNS), "edit_id").alias("v"))
        changed = _stored(last.select("id", "v.*"))
        return base.join(changed.select("id"), "id", "left_anti").unionByName(changed), rejects.unionByName(missing)
    last = ok.groupBy(F.col("id").alias("_id")).agg(F.max_by(normalize_item_status(F.col("status_text")), F.col("edit_id")).alias("_status"))
    changed = base.join(last, base.id == last._id, "left").withColumn("status", F.coalesce("_status", "status"))
    return changed.select(base.columns), missing


def barcode_backfill(items: DataFrame) -> DataFrame:
    """DM9 / WN3: give every item a unique barcode, as a walk by id would.

    An item keeps its trimmed barcode unless it is blank or in use by an earlier
    item; then it gets ``LEGACY-<id>``, or ``LEGACY-<id>-<k>`` (k: its position)
    when an earlier item uses that. Only two things can put a code in use early:

    * the code's first holder; that is a grouped minimum;
    * an earlier item j that lost its own code and got ``LEGACY-j``. So an item
      whose code reads ``LEGACY-j`` keeps it exactly if item j kept its own. These
      references form chains to ever smaller ids, which are followed by pointer
      jumping (each round halves a chain), however long they are.

    (If ``LEGACY-<id>-<k>`` is in use as well, the walk would never end; here such
    an item gets a further ``-<id>``.)
    """
    from tillpoint.session import cut_lineage

    base = items.select("id", js_trim(text_or_empty(F.col("barcode"))).alias("code"))
    rows = cut_lineage(global_row_number(base, [F.col("id")], "pos"))
    firsts = rows.where("code != ''").groupBy("code").agg(F.min("id").alias("first"))
    rows = rows.join(firsts, "code", "left").withColumn("holds", F.coalesce(F.col("first") == F.col("id"), F.lit(False))).drop("first")
    legacy = F.concat(F.lit("LEGACY-"), F.col("id").cast("string"))
    holders = rows.where("holds").select(F.col("code").alias("_code"), F.col("id").alias("_holder"))

    def in_use(frame: DataFrame, code, flag: str) -> DataFrame:
        """``flag``: an earlier item holds ``code`` as its own."""
        return (frame.join(holders, code == F.col("_code"), "left")
                .withColumn(flag, F.coalesce(F.col("_holder") < F.col("id"), F.lit(False))).drop("_code", "_holder"))

    rows = in_use(rows.withColumn("legacy", legacy), F.col("legacy"), "clash")
    long_form = F.concat("legacy", F.lit("-"), F.col("pos").cast("string"))
    rows = rows.withColumn("given", F.when(F.col("clash"), long_form).otherwise(F.col("legacy")))
    rows = cut_lineage(in_use(rows, F.col("given"), "clash2"))
    # holders whose code is what an earlier item j would be given
    givers = rows.select(F.col("given").alias("_given"), F.col("id").alias("ptr"), F.col("holds").alias("ptr_holds"))
    refs = (rows.where("holds").select("id", "code").join(givers, F.col("code") == F.col("_given"))
            .where(F.col("ptr") < F.col("id")).select("id", "ptr", "ptr_holds"))
    refs = cut_lineage(refs)
    while True:
        nxt = refs.select(F.col("id").alias("_id"), F.col("ptr").alias("_ptr"), F.col("ptr_holds").alias("_holds"))
        jumped = refs.join(nxt, refs.ptr == nxt._id, "left")
        if jumped.where("_id is not null").isEmpty():
            break
        refs = cut_lineage(jumped.select("id", F.coalesce("_ptr", "ptr").alias("ptr"), F.coalesce("_holds", "ptr_holds").alias("ptr_holds")))
    lost = refs.where(~F.col("ptr_holds")).select("id").withColumn("lost", F.lit(True))
    out = rows.join(lost, "id", "left").withColumn("keeps", F.col("holds") & F.col("lost").isNull())
    final = (F.when(F.col("keeps"), F.col("code"))
              .when(F.col("clash2"), F.concat("given", F.lit("-"), F.col("id").cast("string"))).otherwise(F.col("given")))
    return out.select("id", F.col("code").alias("old_barcode"), final.alias("barcode"))
