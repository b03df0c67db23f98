"""SC2 reader on the CSV edge fixtures of FIXTURES §4."""

import os
import tempfile

import pytest

from tillpoint.sources.csv_import import read_inventory_csv

HEADER = "Barcode,Name,Category,Supplier,Stock Quantity,Unit Price,Selling Price,Reorder Level,Status"


@pytest.fixture(scope="module")
def parsed(spark):
    """One read of many files: {file name: [row, ...]} in row order."""
    files = {
        "order.csv": "﻿" + "\r\n".join([
            "Status, name ,Category,Unit Price,Selling Price,Barcode",
            "In Stock,Coke (1L),Drinks,10,12,111",
            "",
            ",,,,,",
            "Low Stock,Short",
            "In Stock,Wide,Drinks,1,2,3,EXTRA",
        ]) + "\r\n",
        "quotes.csv": HEADER + '\n1,"b ""q"" c","multi\nline, two",,5,1,2,10,In Stock\r\n2,y"z","",""",""",,,,,"x\r"\r\n',
        "long.csv": HEADER + '\n3,"' + "\n".join(f"line {i}" for i in range(300)) + '",c,,1,1,1,1,s\n4,n,c,,1,1,1,1,s',
        "blank_start.csv": "\n \n  " + HEADER + "\n5,n,c,s,1,2,3,4,ok  \n\n \n",
        "empty.csv": "",
        "spaces.csv": " 　\n  \n",
        "open.csv": HEADER + '\n222,"bad\n333,x',
        "columns.csv": "Name,Category\nx,y",
        "column.csv": "Name,Category,Unit Price,Selling Price\nx,y,1,2",
        "rowless.csv": HEADER + "\n , \n",
        "header_only.csv": HEADER,
    }
    folder = tempfile.mkdtemp(prefix="csv-", dir=os.environ.get("TILLPOINT_SCRATCH"))
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", newline="", encoding="utf-8") as f:
            f.write(text)
    out = {}
    for r in read_inventory_csv(spark, folder).orderBy("file", "row_number").collect():
        out.setdefault(os.path.basename(r["file"]), []).append(r)
    return out


def test_header_order_blank_short_and_wide_rows(parsed):
    rows = {r["row_number"]: r for r in parsed["order.csv"]}
    assert sorted(rows) == [2, 5, 6]
    assert (rows[2]["name"], rows[2]["barcode"], rows[2]["status"]) == ("Coke (1L)", "111", "In Stock")
    assert (rows[5]["name"], rows[5]["category"], rows[5]["unit_price"]) == ("Short", "", "")
    assert rows[6]["error"] == "Row 6: contains more values than the header row." and rows[6]["name"] is None


def test_quotes_newlines_and_carriage_returns(parsed):
    one, two = parsed["quotes.csv"]
    assert (one["name"], one["category"], one["status"]) == ('b "q" c', "multi\nline, two", "In Stock")
    assert (two["row_number"], two["name"], two["category"], two["supplier"], two["status"]) == (3, "yz", "", '","', "x")


def test_a_record_over_many_lines(parsed):
    one, two = parsed["long.csv"]
    assert one["name"].split("\n") == [f"line {i}" for i in range(300)]
    assert (two["row_number"], two["barcode"]) == (3, "4")


def test_text_is_trimmed_before_it_is_numbered(parsed):
    (row,) = parsed["blank_start.csv"]
    assert (row["row_number"], row["barcode"], row["status"], row["error"]) == (2, "5", "ok", None)


@pytest.mark.parametrize("name, message", [
    ("empty.csv", "Choose a non-empty CSV file."),
    ("spaces.csv", "Choose a non-empty CSV file."),
    ("open.csv", "The CSV contains an unclosed quoted value."),
    ("columns.csv", "Missing required columns: unit price, selling price, status."),
    ("column.csv", "Missing required column: status."),
    ("rowless.csv", "The CSV does not contain any product rows."),
    ("header_only.csv", "The CSV does not contain any product rows."),
])
def test_file_errors(parsed, name, message):
    (row,) = parsed[name]
    assert (row["row_number"], row["error"]) == (None, message)


def test_large_file_in_many_splits(spark):
    """Prefix sums over splits: the same rows whatever the split size."""
    folder = tempfile.mkdtemp(prefix="csv-", dir=os.environ.get("TILLPOINT_SCRATCH"))
    with open(os.path.join(folder, "a.csv"), "w", newline="") as f:
        f.write(HEADER + "\n" + "".join(f'{i},"n {i},\n""x""",c,,1,1,1,1,s\n' for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = read_inventory_csv(spark, folder).orderBy("row_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["row_number"], r["barcode"], r["name"]) for r in rows] == [(i + 2, str(i), f'n {i},\n"x"') for i in range(3000)]
