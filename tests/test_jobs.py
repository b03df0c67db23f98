"""Data-change jobs on the hand-made edge fixtures of FIXTURES §4."""

import datetime as dt
from decimal import Decimal as Dm

from pyspark.sql import functions as F

from tillpoint.jobs import imports as IM
from tillpoint.jobs import requests as RQ
from tillpoint.jobs import sales_ingest as SI

INV_SCHEMA = ("id long, barcode string, name string, category string, supplier string, status string, "
              "stock_quantity int, unit_price decimal(18,2), selling_price decimal(18,2), reorder_level int")


def inventory(spark):
    return spark.createDataFrame([
        (1, "111", "Coke (1L)", "Drinks", "ACME", "In Stock", 5, Dm(10), Dm(12), 2),
        (2, "222", "Bread", "Food", "", "Out of Stock", 0, Dm(20), Dm(25), 2),
        (3, "333", "coke (1l)", "Drinks", "ACME", "In Stock", 5, Dm(10), Dm(12), 2),
    ], INV_SCHEMA)


def categories(spark):
    return spark.createDataFrame([(1, "Drinks"), (2, "Food")], "category_id long, category_name string")


def rows(spark, data):
    cols = ["barcode", "name", "category", "supplier", "stock_quantity", "unit_price", "selling_price",
            "reorder_level", "status"]
    out = [("f.csv", i + 2, *r, None) for i, r in enumerate(data)]
    return spark.createDataFrame(out, "file string, row_number int, " + ", ".join(f"{c} string" for c in cols)
                                 + ", error string")


def test_preview_rules(spark):
    data = [
        ("999", "New thing", "Drinks", "", "", "", "1", "", ""),          # blank prices/stock are 0: valid
        ("998", "A", "Drinks", "", "1", "1d", "1", "", ""),               # 1d is not a number
        ("997", "A", "Drinks", "", "1", "Infinity", "1", "", ""),         # not finite
        ("996", "A", "Drinks", "", "2.5", "1", "1", "", ""),              # not whole
        ("995", "A", "Drinks", "", "1", "1", "1", "", "Sold"),            # bad status
        ("994", "A", "drinks", "", "1", "1", "1", "", ""),                # category case matters
        ("999", "Again", "Drinks", "", "1", "1", "1", "", ""),            # repeated barcode
        ("", "COKE (1L)", "Drinks", "", "1", "0x10", "1", "", "low-stock"),  # blank barcode: name match
        ("", "Nobody", "Drinks", "", "1", "1", "1", "", ""),              # blank barcode, no match
    ]
    p = IM.preview_import(rows(spark, data), inventory(spark), categories(spark))
    got = {r["row_number"]: r for r in p.collect()}
    assert got[2]["error"] is None and got[2]["unit_price"] == 0.0 and got[2]["existing_id"] is None
    assert got[3]["error"] == "Row 3: Unit Price and Selling Price must be valid non-negative numbers."
    assert got[4]["error"] == "Row 4: Unit Price and Selling Price must be valid non-negative numbers."
    assert got[5]["error"] == "Row 5: Stock Quantity and Reorder Level must be non-negative whole numbers."
    assert got[6]["error"] == "Row 6: Status must be In Stock, Low Stock, or Out of Stock."
    assert got[7]["error"] == "Row 7: Choose a valid category from Settings."
    assert got[8]["error"] == "Row 8: Barcode is duplicated in this CSV."
    assert got[9]["error"] is None and got[9]["barcode"] == "111" and got[9]["existing_id"] == 1
    assert got[9]["unit_price"] == 16.0 and got[9]["status"] == "Low Stock"
    assert got[10]["error"] == "Row 10: Barcode is required."
    s = IM.preview_summary(p).first()
    assert (s["total"], s["new_products"], s["existing_products"], s["errors"]) == (9, 1, 1, 7)


def test_apply_is_all_or_nothing_and_modes(spark):
    bad = IM.preview_import(rows(spark, [("999", "X", "Drinks", "", "1", "-1", "1", "", "")]),
                            inventory(spark), categories(spark))
    inv, summary = IM.apply_import(bad, inventory(spark), "update")
    assert tuple(summary.first()) == ("f.csv", 0, 0, 0) and inv.count() == 3
    good = IM.preview_import(rows(spark, [("999", "X", "Drinks", "", "1", "1", "2", "", ""),
                                          ("111", "Coke", "Drinks", "", "7", "1", "2", "", "")]),
                             inventory(spark), categories(spark))
    inv, summary = IM.apply_import(good, inventory(spark), "update")
    assert tuple(summary.first()) == ("f.csv", 1, 1, 0)
    by_id = {r["id"]: r for r in inv.collect()}
    assert by_id[4]["barcode"] == "999" and by_id[1]["name"] == "Coke" and by_id[1]["stock_quantity"] == 7
    _, summary = IM.apply_import(good, inventory(spark), "skip")
    assert tuple(summary.first()) == ("f.csv", 1, 0, 1)


def test_files_are_applied_one_after_another(spark):
    """One bad file does not block the others; a barcode in two files is new for the
    first and existing for the second."""
    data = rows(spark, [("999", "First", "Drinks", "", "1", "1", "2", "", ""), ("111", "Coke", "Drinks", "", "7", "1", "2", "", ""),
                        ("999", "Second", "Drinks", "", "3000000000", "1", "2", "", ""), ("888", "X", "Drinks", "", "1", "0xFFFFFFFFFFFFFFFFFF", "2", "", "")])
    named = data.withColumn("file", F.element_at(F.array(F.lit("a.csv"), F.lit("a.csv"), F.lit("b.csv"), F.lit("c.csv")), F.col("row_number") - 1))
    preview = IM.preview_import(named, inventory(spark), categories(spark))
    assert {r["file"]: r["error"] for r in preview.collect() if r["error"]} == {
        "c.csv": "Row 5: Unit Price and Selling Price must be valid non-negative numbers."}
    inv, summary = IM.apply_import(preview, inventory(spark), "update")
    assert sorted(map(tuple, summary.collect())) == [("a.csv", 1, 1, 0), ("b.csv", 0, 1, 0), ("c.csv", 0, 0, 0)]
    new = [r for r in inv.collect() if r["barcode"] == "999"]
    assert [(r["id"], r["name"], r["stock_quantity"]) for r in new] == [(4, "Second", 3000000000)]
    inv, summary = IM.apply_import(preview, inventory(spark), "skip")
    assert sorted(map(tuple, summary.collect())) == [("a.csv", 1, 0, 1), ("b.csv", 0, 0, 1), ("c.csv", 0, 0, 0)]
    assert [r["name"] for r in inv.collect() if r["barcode"] == "999"] == ["First"]


def test_edits_keep_ids_and_barcodes_unique(spark):
    cols = ("edit_id long, id long, barcode string, name string, category string, supplier string, stock_text string, "
            "unit_price_text string, selling_price_text string, reorder_text string, status_text string")
    tail = ("Drinks", "", "1", "1", "1", "0", "")
    edits = spark.createDataFrame([(1, 1, "NEW", "one", *tail), (2, 3, "NEW", "two", *tail), (3, 1, "NEW", "three", *tail)], cols)
    inv, rejects = IM.apply_item_edits(edits, inventory(spark), categories(spark), "Admin")
    got = {r["id"]: (r["barcode"], r["name"]) for r in inv.collect()}
    assert inv.count() == 3 and got[1] == ("NEW", "three") and got[3][0] == "333"
    assert [(r["edit_id"], r["error"]) for r in rejects.collect()] == [(2, "Barcode already exists.")]


def test_renames_never_multiply_rows(spark):
    from tillpoint.jobs import reference as RF
    suppliers = spark.createDataFrame([(1, "ACME", "", ""), (2, "ACME", "", ""), (3, "BETA", "", "")],
                                      "supplier_id long, supplier_name string, contact_no string, address string")
    ren = spark.createDataFrame([(1, 1, "ONE", "09"), (2, 2, "TWO", "x"), (3, 1, "UNO", "08"), (4, 3, "ONE", "y"), (5, 3, "ACME", "z")],
                                "rename_id long, supplier_id long, new_name string, contact_no string")
    table, inv, rejects = RF.rename_suppliers(ren, suppliers, inventory(spark))
    assert {r["supplier_id"]: (r["supplier_name"], r["contact_no"]) for r in table.collect()} == {1: ("UNO", "08"), 2: ("TWO", "x"), 3: ("BETA", "")}
    assert inv.count() == 3 and {r["supplier"] for r in inv.collect()} <= {"UNO", "TWO", ""}
    assert sorted(r["rename_id"] for r in rejects.collect()) == [4, 5]


def test_promos_and_settings(spark):
    from tillpoint.jobs import reference as RF
    promos = spark.createDataFrame([(1, "TM", 1, "EZ50", Dm(50)), (1, "TM", 2, "ALL20", Dm(20)), (2, "SUN", 3, "EZ50", Dm(50))],
                                   "network_id long, network_name string, promo_id long, promo_name string, selling_price decimal(18,2)")
    ch = spark.createDataFrame([(1, 1, "ALL20", "9"), (2, 2, " ALL25 ", "25"), (3, 3, "", "1"), (4, 9, "x", "1"), (5, 3, "EZ55", "Infinity"), (6, 1, "ALL25", "1")],
                               "change_id long, promo_id long, promo_name string, selling_price string")
    out, rejects = RF.update_promos(ch, promos)
    assert {r["promo_id"]: (r["promo_name"], float(r["selling_price"])) for r in out.collect()} == {1: ("EZ50", 50.0), 2: ("ALL25", 25.0), 3: ("EZ50", 50.0)}
    assert sorted(r["change_id"] for r in rejects.collect()) == [1, 3, 4, 5, 6]
    left, missing = RF.remove_promos(spark.createDataFrame([(2,), (2,), (8,)], "promo_id long"), promos)
    assert left.count() == 2 and [r["promo_id"] for r in missing.collect()] == [8]
    settings = spark.createDataFrame([(1, "Shop", 1, 0)], "id int, store_name string, low_stock_alert int, weekly_sales_alert int")
    changes = spark.createDataFrame([(1, "A", 0), (2, "B", None)], "ts int, store_name string, low_stock_alert int")
    assert tuple(RF.update_settings(settings, changes).first()) == (1, "B", 0, 0)


def test_only_users_of_the_batch_lose_their_devices(spark):
    from tillpoint.jobs import reference as RF
    users = spark.createDataFrame([(1, "ann", "Ann", "Admin", 1), (2, "bob", "Bob", "User", 0)],
                                  "id long, username string, full_name string, role string, is_active int")
    devices = spark.createDataFrame([(1, 1), (2, 2)], "id long, user_id long").withColumn("revoked_at", F.lit(None).cast("timestamp_ntz"))
    changes = spark.createDataFrame([("Ann ", "Ann", "x", 0, 1), ("new", "New", "user", 0, 1)],
                                    "username string, full_name string, role string, is_active int, ts int")
    new_users, new_devices, _ = RF.upsert_users(changes, users, devices, "2024-01-25 00:00:00")
    assert {r["id"]: r["is_active"] for r in new_users.collect()} == {1: 0, 2: 0, 3: 0}
    assert {r["user_id"]: r["revoked_at"] is not None for r in new_devices.collect()} == {1: True, 2: False}


def test_request_amounts_that_cannot_be_stored_are_refused(spark):
    inputs = spark.createDataFrame([(1, "Infinity"), (2, "1e30"), (3, "25"), (4, "abc"), (5, "-1")], "input_id long, amount string").select(
        "*", F.lit("gcash").alias("service_type"), F.lit("09171234567").alias("mobile_number"),
        *[F.lit("").alias(c) for c in ("cash_flow", "reference_number", "network", "load_type", "load_value", "notes", "requested_by_name")])
    old = spark.createDataFrame([(7,)], "id long")
    new, rejects = RQ.create_requests(inputs, old)
    assert [(r["input_id"], r["id"], float(r["amount"])) for r in new.collect()] == [(3, 8, 25.0)]
    assert {r["input_id"]: r["error"] for r in rejects.collect()} == {
        1: "Amount must be greater than zero.", 2: "Amount must be greater than zero.", 4: "Amount must be greater than zero.",
        5: "Enter a valid GCash amount."}


def test_item_edits_owner_rule_and_user_status(spark):
    edits = spark.createDataFrame([(1, 1, "333", "Coke", "Drinks", "", "1", "1", "1", "0", "In Stock"),
                                   (2, 3, "333", "Coke", "Drinks", "", "1", "1", "1", "0", "Sold out"),
                                   (3, 9, "9", "X", "Drinks", "", "1", "1", "1", "0", "")],
                                  "edit_id long, id long, barcode string, name string, category string, supplier string, "
                                  "stock_text string, unit_price_text string, selling_price_text string, "
                                  "reorder_text string, status_text string")
    _, rejects = IM.apply_item_edits(edits, inventory(spark), categories(spark), "Admin")
    got = {r["id"]: r["error"] for r in rejects.collect()}
    assert got[1] == "Barcode already exists." and got[9] == "Item not found."
    assert got[3] == "Status must be In Stock, Low Stock, or Out of Stock."
    inv, _ = IM.apply_item_edits(edits, inventory(spark), categories(spark), "User")
    assert {r["id"]: r["status"] for r in inv.collect()}[3] == "In Stock"


def _reference_backfill(items):
    used, out = set(), {}
    for i, code in sorted(items):
        b = (code or "").strip()
        if not b or b in used:
            b = f"LEGACY-{i}"
            if b in used:
                b = f"LEGACY-{i}-{len(used) + 1}"
        used.add(b)
        out[i] = b
    return out


def test_barcode_backfill_matches_reference_walk(spark):
    items = [(1, None), (2, ""), (3, "A"), (4, "A"), (5, "LEGACY-7"), (6, " A "), (7, ""), (8, "LEGACY-3"),
             (9, "B"), (10, "LEGACY-11"), (11, "B"), (12, "LEGACY-11-11"), (20, ""), (21, "LEGACY-20"), (22, "LEGACY-21"),
             (23, "LEGACY-22"), (24, "LEGACY-23"), (25, "LEGACY-30"), (26, "LEGACY-25"), (27, "LEGACY-24"), (30, " ")]
    items += [(i, f"LEGACY-{i - 1}") for i in range(31, 90)]
    got = {r["id"]: r["barcode"] for r in IM.barcode_backfill(
        spark.createDataFrame(items, "id long, barcode string")).collect()}
    assert got == _reference_backfill(items)


def test_sale_ingest_payload_edges(spark):
    inv = inventory(spark)
    item = "struct<inventory_item_id: bigint, quantity: double, price: double>"
    dig = ("struct<mobile_number: string, network: string, load_type: string, load_value: string, "
           "notes: string, quantity: double, price: double>")
    carts = spark.createDataFrame([
        (1, dt.date(2000, 6, 15), "Cash", "Ana", [], []),                                   # empty cart
        (2, dt.date(2000, 6, 15), "Cash", "Ana", [(99, 1.0, 5.0)], []),                     # unknown item
        (3, dt.date(2000, 6, 15), "Cash", "Ana", [(1, 1.0, 12.0), (2, 1.0, 25.0)], []),     # out of stock beside good
        (4, dt.date(2000, 6, 15), "Cash", " ", [(1, 0.0, 12.0)], []),                       # quantity 0 only
        (5, dt.date(2000, 6, 15), "Cash", "", [(1, 2.0, 12.0)],
         [("", "GLOBE", "regular", "Regular 50", "", None, 50.0),                            # no number: dropped
          ("0917 123 4567", "GLOBE", "regular", "Regular 50", "", None, 50.0)]),
    ], f"cart_id long, sale_date date, payment_method string, employee_name string, items array<{item}>, "
       f"digital_items array<{dig}>")
    sales = spark.createDataFrame([(100,)], "id long")
    reqs = spark.createDataFrame([(500,)], "id long")
    res = SI.ingest_sales(carts, inv, sales, reqs)
    rej = {r["cart_id"]: r["error"] for r in res.rejects.collect()}
    assert rej == {1: "Add at least one item to the sale.", 2: "One of the sale items does not exist.",
                   3: "Bread is marked out of stock.", 4: "Add at least one item to the sale."}
    s = res.sales.first()
    assert (s["id"], s["transaction_code"], float(s["total_amount"]), s["employee_name"]) == (101, "S0101", 74.0, "System")
    r = res.requests.first()
    assert (r["id"], r["request_code"], r["status"], float(r["amount"])) == (501, "EL0501", "Pending", 50.0)
    assert res.sale_items.first()["item_name"] == "Coke (1L)"


def test_transition_commands(spark):
    reqs = spark.createDataFrame([
        (1, "gcash", "Pending", "", None, None), (2, "eload", "Pending", "", None, None),
        (3, "eload", "Completed", "", None, None)],
        "id long, service_type string, status string, reference_no string, completed_at timestamp_ntz, "
        "failed_at timestamp_ntz").withColumn("completed_by_name", F.lit("")).withColumn("failed_reason", F.lit(""))
    t0 = dt.datetime(2000, 6, 15, 8)
    cmds = spark.createDataFrame([
        (1, 1, "complete", t0, "", "", "Bo"),          # gcash without reference
        (2, 1, "fail", t0 + dt.timedelta(hours=1), "", "", "Bo"),   # no reason
        (3, 1, "complete", t0 + dt.timedelta(hours=2), "R9", "", "Bo"),
        (4, 1, "complete", t0 + dt.timedelta(hours=3), "R9", "", "Bo"),  # complete twice
        (5, 2, "fail", t0, "", "no load", ""),
        (6, 3, "fail", t0, "", "x", "Bo"),             # fail a completed one
        (7, 9, "complete", t0, "", "", "Bo"),
    ], "command_id long, request_id long, action string, ts timestamp_ntz, reference_no string, reason string, by_name string")
    new, outcomes = RQ.apply_transitions(reqs, cmds)
    got = {r["command_id"]: r["outcome"] for r in outcomes.collect()}
    assert got == {1: "GCash completion requires a reference number.", 2: "Failure reason is required.",
                   3: "applied", 4: "This request is already completed.", 5: "applied",
                   6: "Completed requests cannot be marked as failed.", 7: "Request not found."}
    state = {r["id"]: (r["status"], r["reference_no"]) for r in new.collect()}
    assert state[1] == ("Completed", "R9") and state[2][0] == "Failed" and state[3][0] == "Completed"


def test_preview_with_duplicated_stored_barcode(spark):
    inv = inventory(spark).unionByName(spark.createDataFrame(
        [(4, "111", "Coke copy", "Drinks", "", "In Stock", 5, Dm(10), Dm(12), 2)], INV_SCHEMA))
    p = IM.preview_import(rows(spark, [("111", "Coke", "Drinks", "", "1", "1", "1", "", "")]), inv, categories(spark))
    r = p.first()
    assert p.count() == 1 and r["existing_id"] == 1 and r["error"] == "Row 2: Barcode already exists."


def test_duplicate_rules_in_one_pass(spark):
    from tillpoint.jobs import audit as AU
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, None), (4, None), (5, "c"), (5, "c")],
                               "id long, code string")
    got = AU.violations_by_key([(df, [AU.unique("duplicate_sale_id", F.col("id")),
                                      AU.unique("duplicate_transaction_code", F.col("code"))])])
    assert sorted(r.n for r in got.collect()) == [2, 3]


def test_audit_finds_a_breach_of_every_rule(spark):
    from types import SimpleNamespace

    from tillpoint.jobs import audit as AU
    df = spark.createDataFrame
    t = SimpleNamespace(
        inventory_items=df([(1, " x ", "A"), (1, "x", "A"), (2, "y", "gone"), (3, "z", None)], "id long, barcode string, category string"),
        sales=df([(1, "T1", 5.0), (1, "T2", 4.0), (2, "T2", 0.0), (3, "T3", 9.0)], "id long, transaction_code string, total_amount double"),
        sale_items=df([(1, 1, 3.0), (9, 2, 1.0), (9, 8, 1.0), (None, None, 1.0)], "sale_id long, inventory_item_id long, total double"),
        sale_digital_items=df([(1, 2.0), (8, 1.0), (None, 1.0)], "sale_id long, total double"),
        digital_service_requests=df([(1, "R1"), (1, "R2"), (2, "R2"), (3, "R2")], "id long, request_code string"),
        categories=df([("A",), ("a",), ("B",)], "category_name string"),
        suppliers=df([("S",), ("S",), ("s",)], "supplier_name string"),
        users=df([(1, "Ann"), (2, "ann"), (3, "bob")], "id long, username string"),
        user_devices=df([(1, None), (1, None), (2, None), (2, "2024"), (7, "2024")], "user_id long, revoked_at string"))
    promos = df([(1, "Net", "p", 1.0), (1, "Net", "p", 0.0), (2, "NET", "p", -1.0)],
                "network_id long, network_name string, promo_name string, selling_price double")
    got = {r.rule: r.violations for r in AU.integrity_audit(t, promos).collect()}
    two = {"sale_total_not_lines", "orphan_sale_item_sale", "promo_price_not_positive"}
    assert len(got) == 19 and got == {rule: 2 if rule in two else 1 for rule in got}
    empty = SimpleNamespace(**{k: v.limit(0) for k, v in vars(t).items()})
    assert {r.violations for r in AU.integrity_audit(empty, promos.limit(0)).collect()} == {0}
