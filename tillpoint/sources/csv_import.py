"""SC2: product CSV import reader, distributed over the lines of all files.

No file is ever held by one task. Files are read line by line (large files
in splits), and what quoting says about a line is arithmetic over the lines
before it: a line starts inside a quoted value when an odd number of quotes
precedes it in its file. That number, and the number of finished records, are
prefix sums: inside a split by a window, across splits by a small table.

* ``""`` inside quotes is one quote; a quote anywhere opens a quoted run;
  commas and newlines inside quotes are text; a record's last value loses a
  trailing ``\\r``.
* The text of a file counts from its first to its last non-blank line,
  trimmed. A file without one is empty; a file with an odd number of quotes
  has an unclosed value; both are errors of the file.
* Headers are matched by trimmed lower-case name in any order, per file; five
  are required. Rows are numbered by record (the first row is 2), blank rows
  are skipped, a row wider than the header is an error of the row.

Output: ``file, row_number, barcode, name, category, supplier, stock_quantity,
unit_price, selling_price, reorder_level, status, error`` (``row_number`` and
the values are NULL on a file-level error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.functions.normalize import JS_WHITESPACE, js_trim
from tillpoint.session import cut_lineage

# -- fixed values: import headers and messages --------------------------------
FIELDS = ("barcode", "name", "category", "supplier", "stock quantity", "unit price",
          "selling price", "reorder level", "status")
REQUIRED = ("name", "category", "unit price", "selling price", "status")
MSG_EMPTY = "Choose a non-empty CSV file."
MSG_UNCLOSED = "The CSV contains an unclosed quoted value."
MSG_NO_ROWS = "The CSV does not contain any product rows."
MSG_WIDE = "contains more values than the header row."

COLUMNS = [f.replace(" ", "_") for f in FIELDS]
# one value up to its comma: plain characters and quoted runs ("" inside a
# quoted run is two adjacent runs)
_VALUE = r'((?:[^",]++|"[^"]*+")*+),'


def _unquoted(raw: Column) -> Column:
    """The text of one raw value: cut at its quotes, every second piece lies
    inside them; an empty piece between two inside ones was a doubled quote."""
    pieces = F.split(raw, '"', -1)
    last = F.size(pieces) - 1
    text = F.transform(pieces, lambda p, i: F.when((i % 2 == 0) & (i > 0) & (i < last) & (p == ""), F.lit('"')).otherwise(p))
    return F.array_join(text, "")


def record_values(record: Column) -> Column:
    """The values of one record's text."""
    raw = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(_VALUE), 1)
    values = F.transform(raw, _unquoted)
    return F.transform(values, lambda v, i: F.when(i == F.size(values) - 1, F.regexp_replace(v, "\r\\z", "")).otherwise(v))


def _running(rows: DataFrame, amount: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the file's earlier lines. A split's
    lines share a window (bounded by the split size); splits carry over through
    one row each."""
    inside = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carry = (rows.groupBy("file", "split").agg(F.sum(amount).alias("_sum"))
             .select("file", "split", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry")))
    return (rows.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
            .join(carry, ["file", "split"]).withColumn(out, F.col("_carry") + F.col("_in")).drop("_in", "_carry"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, split, line, value``: every line with its place. A line's place is
    its split's first byte and its order in the split."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"), "value")


def records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, bad_files)`` of the lines: ``file, rec, record`` with the header
    as record 0, and ``file, error`` for empty and unclosed files."""
    place = F.struct("split", "line")
    full = js_trim(F.col("value")) != ""
    span = lines.groupBy("file").agg(
        F.min(F.when(full, place)).alias("first"), F.max(F.when(full, place)).alias("last"),
        F.sum(F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))).alias("quotes"))
    bad = span.select("file", F.when(F.col("first").isNull(), F.lit(MSG_EMPTY)).when(F.col("quotes") % 2 == 1, F.lit(MSG_UNCLOSED)).alias("error"))
    good = span.where("first is not null and quotes % 2 = 0").select("file", "first", "last")
    text = lines.join(good, "file").where((place >= F.col("first")) & (place <= F.col("last")))
    text = text.withColumn("value", F.when(place == F.col("first"), F.ltrim("value", F.lit(JS_WHITESPACE))).otherwise(F.col("value")))
    text = text.withColumn("value", F.when(place == F.col("last"), F.rtrim("value", F.lit(JS_WHITESPACE))).otherwise(F.col("value")))
    text = text.drop("first", "last").withColumn("quotes", F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit(""))))
    text = _running(text, "quotes", "quotes_before")
    ends = ((F.col("quotes_before") + F.col("quotes")) % 2 == 0).cast("int")
    text = _running(text.withColumn("ends", ends), "ends", "rec")
    whole = (F.col("quotes_before") % 2 == 0) & (F.col("ends") == 1)
    one = text.where(whole).select("file", "rec", F.col("value").alias("record"))
    several = (text.where(~whole).groupBy("file", "rec")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "line", "value"))), lambda s: s["value"]), "\n").alias("record")))
    return one.unionByName(several), bad.where("error is not null")


def read_inventory_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Parsed rows of all files (see module doc)."""
    # the lines feed the files' spans, both prefix sums and the records: they are
    # written once, which also fixes the line order
    lines = cut_lineage(read_lines(spark, paths))
    found, bad = records(lines)
    found = cut_lineage(found.withColumn("values", record_values(F.col("record"))).drop("record"))
    header = found.where("rec = 0").select("file", F.transform("values", lambda v: F.lower(js_trim(v))).alias("headers"))
    missing = F.filter(F.array(*[F.lit(h) for h in REQUIRED]), lambda h: ~F.array_contains(F.col("headers"), h))
    header = header.withColumn("missing", missing)
    unfit = header.where(F.size("missing") > 0).select(
        "file", F.concat(F.lit("Missing required column"), F.when(F.size("missing") > 1, F.lit("s")).otherwise(F.lit("")),
                         F.lit(": "), F.array_join("missing", ", "), F.lit(".")).alias("error"))
    header = header.where(F.size("missing") == 0).select("file", F.size("headers").alias("width"), *[
        F.array_position("headers", h).alias(f"_at_{h.replace(' ', '_')}") for h in FIELDS])
    rows = found.where("rec > 0").join(header, "file").where(F.exists("values", lambda v: js_trim(v) != ""))
    number = (F.col("rec") + 1).cast("int")
    wide = F.size("values") > F.col("width")

    def value(name: str) -> Column:
        at = F.col(f"_at_{name}")
        got = F.when((at > 0) & (at <= F.size("values")), js_trim(F.get("values", (at - 1).cast("int"))))
        return F.when(~wide, F.coalesce(got, F.lit(""))).alias(name)

    parsed = rows.select("file", number.alias("row_number"), *[value(c) for c in COLUMNS],
                         F.when(wide, F.concat(F.lit("Row "), number.cast("string"), F.lit(f": {MSG_WIDE}"))).alias("error"))
    # files of zero bytes have no line: they are in the reader's list of files only
    names = spark.createDataFrame([(f,) for f in spark.read.text(paths).inputFiles()], "name string")
    local = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    seen = lines.select(local(F.col("file")).alias("name")).distinct()
    zero = names.select(local(F.col("name")).alias("name")).join(seen, "name", "left_anti").select(F.col("name").alias("file"), F.lit(MSG_EMPTY).alias("error"))
    rowless = header.select("file").join(rows.select("file").distinct(), "file", "left_anti").select("file", F.lit(MSG_NO_ROWS).alias("error"))
    errors = bad.unionByName(unfit).unionByName(zero).unionByName(rowless)
    return parsed.unionByName(errors, allowMissingColumns=True)
