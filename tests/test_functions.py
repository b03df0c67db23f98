"""Scalar functions on the edge rows of FIXTURES §4."""

import math

from pyspark.sql import functions as F

from tillpoint.functions import normalize as FN
from tillpoint.functions import text as FT
from tillpoint.jobs.imports import js_number


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_phone_strings(spark):
    cases = {"0917-123-4567": "0917 123 4567", "091712345678": "0917 123 4567",
             "9171234567": "", "": "", None: "", "09171234567": "0917 123 4567"}
    for raw, want in cases.items():
        assert one(spark, FT.ph_mobile(F.col("v")), raw) == want, raw
    assert one(spark, FT.ph_mobile_partial(F.col("v")), "09171") == "0917 1"


def test_product_names(spark):
    cases = {"Coke (1L)": ("Coke", "1L"), "(1L)": ("(1L)", ""), "A (b) c": ("A (b) c", ""),
             "A ()": ("A ()", ""), None: ("", ""), "Tea (green (x))": ("Tea (green (x))", ""),
             "Milk (1 L)  ": ("Milk", "1 L")}
    for raw, (name, variant) in cases.items():
        r = one(spark, FT.product_name_parts(F.col("v")), raw)
        assert (r["name"], r["variant"]) == (name, variant), raw


def test_promo_prices(spark):
    cases = {"GO+99": 99.0, "SURF4ALL99": 99.0, "ALL DATA": 0.0, "X 1.5": 1.5, None: 0.0}
    for raw, want in cases.items():
        assert one(spark, FT.last_number(F.col("v")), raw) == want, raw
    assert one(spark, FT.last_number(F.col("v"), whole_digits_only=True), "X 1.5") == 5.0


def test_status_and_filters(spark):
    assert one(spark, FN.normalize_item_status(F.col("v")), " LOW-stock ") == "Low Stock"
    assert one(spark, FN.normalize_item_status(F.col("v")), None) == "In Stock"
    assert one(spark, FN.normalize_item_status(F.col("v")), "Discontinued") == "In Stock"
    assert one(spark, FN.normalize_inventory_filter(F.col("v")), "low / out of stock") == "Low/Out of Stock"
    assert one(spark, FN.normalize_inventory_filter(F.col("v")), None) == "all"
    assert one(spark, FN.normalize_sales_filter(F.col("v")), " Week ") == "week"
    assert one(spark, FN.normalize_sales_filter(F.col("v")), "year") == "all"
    assert one(spark, FN.normalize_role(F.col("v")), " USER ") == "User"
    assert one(spark, FN.normalize_role(F.col("v")), "cashier") == "Admin"
    assert one(spark, FN.normalize_service_type(F.col("v")), "GCash") == "gcash"
    assert one(spark, FN.rate_limit_key(F.col("v")), "   ") == "unknown"


def test_codes_never_cut(spark):
    df = spark.createDataFrame([(7,), (12345,)], "v long")
    got = [r[0] for r in df.select(FN.sale_code(F.col("v"))).collect()]
    assert got == ["S0007", "S12345"]
    got = [r[0] for r in df.select(FN.request_code(F.lit("gcash"), F.col("v"))).collect()]
    assert got == ["GC0007", "GC12345"]


def test_js_number(spark):
    cases = {"": 0.0, "1.5": 1.5, "2.": 2.0, ".5": 0.5, "1e2": 100.0, "0x10": 16.0, "0b11": 3.0,
             "0o17": 15.0, "1d": None, "1.5f": None, "NaN": None, "abc": None, " 7 ": 7.0}
    for raw, want in cases.items():
        got = one(spark, js_number(F.col("v")), raw)
        assert got == want, (raw, got)
    assert math.isinf(one(spark, js_number(F.col("v")), "Infinity"))
    assert one(spark, js_number(F.col("v")), "-Infinity") < 0


def test_labels(spark):
    import datetime as dt
    d = spark.createDataFrame([(dt.date(2000, 6, 5), "1234.5")], "d date, x string")
    r = d.select(FT.weekday_short(F.col("d")).alias("w"), FT.long_date(F.col("d")).alias("l"),
                 FT.php_currency(F.col("x").cast("decimal(18,2)")).alias("c")).first()
    assert (r["w"], r["l"], r["c"]) == ("Mon", "Jun 5, 2000", "₱1,234.50")
    assert one(spark, FT.short_label(F.col("v")), "abcdefghijklmnopqrstuvwxyz") == "abcdefghijklmnopqrst..."
    assert one(spark, FT.device_name_from_agent(F.col("v")),
               "Mozilla/5.0 (iPhone) CriOS/120 Safari/604") == "Chrome on iOS"
    lv = spark.createDataFrame([("regular", None, None, 50.0), ("promo", "GO+99", None, None)],
                               "t string, n string, p double, a double")
    got = [tuple(r[0]) for r in lv.select(FT.load_value_and_amount(F.col("t"), F.col("n"), F.col("p"), F.col("a"))).collect()]
    assert got == [("Regular 50", 50.0), ("GO+99", 99.0)]
