"""DM3: batch sale ingest.

Input: one row per cart payload ``cart_id, sale_date, payment_method,
employee_name, items array<struct<inventory_item_id, quantity, price>>,
digital_items array<struct<mobile_number, network, load_type, load_value,
notes, quantity, price>>``.

* product lines without an id or with quantity <= 0 are dropped; total =
  quantity x price;
* digital lines: trimmed, quantity = max(1, q or 1), total = quantity x
  price, kept only with number, network, load value and price > 0;
* an empty cart is rejected;
* an unknown or out-of-stock product rejects the whole sale, with the
  message of the first such line;
* accepted sales get ids after the current maximum (cart order), code
  ``S%04d``, total = every kept line, item names from the inventory; each
  digital line opens a Pending eLoad request (``EL%04d``).

Everything is joins and grouped aggregates over exploded lines; the
"whole sale fails" rule is a per-cart ``min_by`` of the first bad line.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.functions.normalize import at_least_one, js_trim, name_or_system, normalize_item_status, padded_code, text_or_empty
from tillpoint.operators.windows import global_row_number
from tillpoint.session import cut_stored
from tillpoint.sinks.versions import Added

# -- fixed values: messages -------------------------------------------------
MSG_EMPTY = "Add at least one item to the sale."
MSG_UNKNOWN = "One of the sale items does not exist."
MSG_OUT_OF_STOCK = " is marked out of stock."
MONEY = "decimal(18,2)"
QUANTITY = "decimal(18,3)"  # a quantity keeps its fraction, as its total does


def _product_lines(carts: DataFrame) -> DataFrame:
    lines = carts.select("cart_id", F.posexplode("items").alias("pos", "it"))
    q = F.col("it.quantity").cast("double")
    price = F.col("it.price").cast("double")
    iid = F.col("it.inventory_item_id")
    return (lines.filter(iid.isNotNull() & (iid != 0) & q.isNotNull() & (q > 0))
            .select("cart_id", "pos", iid.alias("inventory_item_id"), q.alias("quantity"), price.alias("price"),
                    (q * price).alias("total")))


def _digital_lines(carts: DataFrame) -> DataFrame:
    lines = carts.select("cart_id", F.posexplode("digital_items").alias("pos", "it"))

    def txt(c):
        return js_trim(text_or_empty(F.col(f"it.{c}")))
    q = at_least_one(F.col("it.quantity"))
    price = F.col("it.price").cast("double")
    out = lines.select("cart_id", "pos", txt("mobile_number").alias("mobile_number"), txt("network").alias("network"),
                       txt("load_type").alias("load_type"), txt("load_value").alias("load_value"),
                       txt("notes").alias("notes"), q.alias("quantity"), price.alias("price"),
                       (q * price).alias("total"))
    return out.filter((F.col("mobile_number") != "") & (F.col("network") != "") & (F.col("load_value") != "")
                      & F.col("price").isNotNull() & (F.col("price") > 0))


class IngestResult:
    """The ingest's outputs, each built when it is asked for: ``sales``,
    ``sale_items``, ``sale_digital_items``, ``requests`` and ``rejects``. What
    several outputs need (the carts, their lines, the two numberings) is written
    once and kept for the others; rejects need no numbering, and sales no requests."""

    def __init__(self, carts: DataFrame, inventory: DataFrame, sales: DataFrame, requests: DataFrame):
        self._given, self._inventory, self._sales, self._requests = carts, inventory, sales, requests

    @cached_property
    def _carts(self) -> DataFrame:
        return cut_stored(self._given, "carts")

    @cached_property
    def _lines(self) -> DataFrame:
        inv = self._inventory.select(F.col("id").alias("inventory_item_id"), F.col("name").alias("inv_name"),
                                     normalize_item_status(F.col("status")).alias("inv_status"))
        return cut_stored(_product_lines(self._carts).join(inv, "inventory_item_id", "left"), "cart-lines")

    @cached_property
    def _digital_given(self) -> DataFrame:
        return cut_stored(_digital_lines(self._carts), "cart-digital")

    @cached_property
    def _verdict(self) -> DataFrame:
        bad = (F.when(F.col("inv_name").isNull() & F.col("inv_status").isNull(), F.lit(MSG_UNKNOWN))
                .when(F.col("inv_status") == P.OUT_OF_STOCK, F.concat(F.col("inv_name"), F.lit(MSG_OUT_OF_STOCK))))
        # one pass over the lines: a cart's first bad line, and that it has lines
        product = self._lines.groupBy("cart_id").agg(F.min_by(bad, F.when(bad.isNotNull(), F.col("pos"))).alias("error"))
        digital = self._digital_given.select("cart_id").distinct().withColumn("_digital", F.lit(True))
        found = product.withColumn("_product", F.lit(True))
        v = self._carts.select("cart_id").join(found, "cart_id", "left").join(digital, "cart_id", "left")
        empty = F.col("_product").isNull() & F.col("_digital").isNull()
        return v.select("cart_id", F.when(empty, F.lit(MSG_EMPTY)).otherwise(F.col("error")).alias("error"))

    @property
    def rejects(self) -> DataFrame:
        return self._verdict.filter(F.col("error").isNotNull())

    @cached_property
    def _accepted(self) -> DataFrame:
        """``cart_id, sale_id``: ids after the current maximum, in cart order."""
        top = self._sales.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
        ok = self._verdict.filter(F.col("error").isNull()).select("cart_id")
        return global_row_number(ok, [F.col("cart_id")], "_n").select("cart_id", (top + F.col("_n")).alias("sale_id"))

    @cached_property
    def _digital(self) -> DataFrame:
        """The accepted carts' digital lines with their sale and request ids."""
        top = self._requests.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
        lines = (self._digital_given.join(self._accepted, "cart_id")
                 .join(self._carts.select("cart_id", "employee_name"), "cart_id"))
        return global_row_number(lines, [F.col("sale_id"), F.col("pos")], "_r").withColumn("request_id", top + F.col("_r"))

    @property
    def sales(self) -> DataFrame:
        lines = self._lines.select("cart_id", "total").unionByName(self._digital_given.select("cart_id", "total"))
        totals = lines.groupBy("cart_id").agg(F.sum(F.col("total").cast("decimal(38,2)")).alias("total_amount"))
        return self._accepted.join(self._carts, "cart_id").join(totals, "cart_id", "left").select(
            F.col("sale_id").alias("id"), padded_code("S", F.col("sale_id")).alias("transaction_code"),
            F.col("sale_date").cast("date").alias("sale_date"), "payment_method",
            name_or_system(F.col("employee_name")).alias("employee_name"),
            F.coalesce(F.col("total_amount"), F.lit(0)).cast(MONEY).alias("total_amount"), "cart_id")

    @property
    def sale_items(self) -> DataFrame:
        return self._lines.join(self._accepted, "cart_id").select(
            "sale_id", "inventory_item_id", F.col("inv_name").alias("item_name"), F.col("pos").alias("line_no"),
            F.col("quantity").cast(QUANTITY).alias("quantity"), F.col("price").cast(MONEY).alias("price"),
            F.col("total").cast(MONEY).alias("total"))

    @property
    def requests(self) -> DataFrame:
        return self._digital.select(
            F.col("request_id").alias("id"), padded_code("EL", F.col("request_id")).alias("request_code"),
            F.lit("eload").alias("service_type"), F.lit(P.PENDING).alias("status"), "mobile_number",
            F.col("total").cast(MONEY).alias("amount"), F.lit("").alias("request_kind"), "network", "load_type",
            "load_value", F.lit("").alias("reference_no"), "notes",
            name_or_system(F.col("employee_name")).alias("requested_by_name"), "sale_id")

    @property
    def sale_digital_items(self) -> DataFrame:
        return self._digital.select(
            "sale_id", F.lit("eload").alias("service_type"), padded_code("EL", F.col("request_id")).alias("request_code"),
            "mobile_number", "network", "load_type", "load_value", "notes",
            F.col("quantity").cast(QUANTITY).alias("quantity"), F.col("price").cast(MONEY).alias("price"),
            F.col("total").cast(MONEY).alias("total"))


def ingest_sales(carts: DataFrame, inventory: DataFrame, sales: DataFrame, requests: DataFrame) -> IngestResult:
    return IngestResult(carts, inventory, sales, requests)


def commit_sales(store, carts: DataFrame) -> tuple[int, DataFrame]:
    """DM3 on a :class:`~tillpoint.sinks.versions.VersionedTables`: a batch of carts
    becomes sales, lines and requests, all four tables in one version. Returns
    ``(version, rejects)``."""
    def job(view):
        result = ingest_sales(carts, view.inventory_items, view.sales, view.digital_service_requests)
        more = {"sales": result.sales.drop("cart_id"), "sale_items": result.sale_items,
                "sale_digital_items": result.sale_digital_items, "digital_service_requests": result.requests.drop("sale_id")}
        return {n: Added(df) for n, df in more.items()}, result.rejects

    return store.update(job, name="sales")
