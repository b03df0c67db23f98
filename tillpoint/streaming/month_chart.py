"""ST3: the live month chart with its three series.

GCash and load come from the completed requests (``live_totals``). Products come from
two more streams, sales and their lines, each with a watermark of its own: a line
meets its sale in a stream-stream join, whichever arrives first, and adds to its sale
day's total. The join keeps a row until the other side's watermark has passed
``SPAN`` beyond it, so the state is that of the last hours. The totals of changed days
go to an ``EpochTable``; a replayed batch adds to the totals before it again.

A backlog is handed in by slices of time (``write_arrivals``, ``drain_products``): a
batch holds its own rows in the state, so one batch of all of them would hold them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.functions.dates import as_utc_instant, date_lit, month_length, month_start, next_month_start
from tillpoint.operators.sales import calendar
from tillpoint.sinks.versions import Files
from tillpoint.streaming.epochs import EpochTable
from tillpoint.streaming.live_totals import read_daily_totals

SALES_SCHEMA = "id long, sale_date date, created_at timestamp"
LINES_SCHEMA = "sale_id long, total decimal(18,2), recorded_at timestamp"
LATENESS = "2 hours"
#: A sale and its lines are recorded within this time of each other.
SPAN = "15 minutes"
#: About so many sales, with their lines, are in the join's state at a time while a
#: backlog is drained.
SLICE_SALES = 2_000_000
_WRITERS = 8  # files of a slice, at most


def joined_lines(sales: DataFrame, lines: DataFrame, lateness: str = LATENESS, span: str = SPAN) -> DataFrame:
    """(sale_date, total) of every line whose sale is there, from two streams (or
    two batches): inner, so a line without a sale never counts."""
    s = sales.select("id", "sale_date", "created_at").withWatermark("created_at", lateness)
    n = lines.select("sale_id", "total", "recorded_at").withWatermark("recorded_at", lateness)
    near = F.expr(f"recorded_at BETWEEN created_at - INTERVAL {span} AND created_at + INTERVAL {span}")
    return s.join(n, (F.col("id") == F.col("sale_id")) & near).select("sale_date", "total")


def products_table(spark: SparkSession, out: str) -> EpochTable:
    return EpochTable(spark, f"{out}/products", "day date, products decimal(28,2)", ["day"])


def start_products(sales: DataFrame, lines: DataFrame, out: str, trigger: dict, lateness: str = LATENESS, span: str = SPAN):
    """Start the products series into ``out``; returns the query handle."""
    table = products_table(sales.sparkSession, out)

    def add(batch: DataFrame, epoch: int) -> None:
        mine = batch.groupBy(F.col("sale_date").alias("day")).agg(F.sum("total").alias("more"))
        before = table.read(epoch).select("day", F.col("products").alias("had"))
        total = F.col("more") + F.coalesce("had", F.lit(0).cast("decimal(28,2)"))
        table.write(mine.join(before, "day", "left").select("day", total.cast("decimal(28,2)").alias("products")), epoch)

    return (joined_lines(sales, lines, lateness, span).writeStream.outputMode("append").foreachBatch(add)
            .option("checkpointLocation", f"{out}/_products").trigger(**trigger).start())


def read_chart(spark: SparkSession, out: str, as_of: str) -> DataFrame:
    """``as_of``'s calendar month as the streams have it now, zero filled: day_of_month,
    day, gcash, load, products."""
    first, nxt = date_lit(month_start(as_of)), date_lit(next_month_start(as_of))
    month = (F.col("day") >= first) & (F.col("day") < nxt)
    amount = lambda s: F.sum(F.when(F.col("service_type") == s, F.col("total")))
    digital = read_daily_totals(spark, out).where(month).groupBy("day").agg(amount("gcash").alias("gcash"), amount("eload").alias("load"))
    products = products_table(spark, out).read().where(month).select("day", "products")
    zero = F.lit(0).cast("decimal(18,2)")
    return (calendar(spark, month_start(as_of), month_length(as_of)).join(digital, "day", "left").join(products, "day", "left")
            .select(F.dayofmonth("day").alias("day_of_month"), "day", *[F.coalesce(c, zero).alias(c) for c in ("gcash", "load", "products")]))


def _staged(rows: DataFrame, key: str, folder: str) -> None:
    """Write rows by ``slice``, each slice by a few tasks."""
    dealt = rows.withColumn("_task", F.pmod(F.xxhash64(key), F.lit(_WRITERS))).repartition("slice", "_task")
    dealt.drop("_task").write.partitionBy("slice").parquet(folder)


def write_arrivals(t, folder: str, slice_sales: int = SLICE_SALES) -> int:
    """The shop's sales and lines as stream inputs, lines with their sale's time, staged
    as slices 0, 1, ... in order of time; returns the number of slices. Rows of one time
    share a slice, as they share the state; rows without a time are in the first."""
    t.sales.select("id", "sale_date", as_utc_instant(F.col("created_at")).alias("created_at")).write.parquet(f"{folder}/all")
    s = t.spark.read.schema(SALES_SCHEMA).parquet(f"{folder}/all").withColumn("at", F.unix_micros("created_at"))
    parts = -(-s.count() // slice_sales)
    shares = [k / parts for k in range(1, parts)]
    cuts = sorted(set(s.approxQuantile("at", shares, 0.1 / parts))) if shares else []
    if cuts:
        s = s.withColumn("slice", F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c < F.col("at"))))
    else:
        s = s.withColumn("slice", F.lit(0))
    lines = t.sale_items.select("sale_id", "total").join(s.select(F.col("id").alias("sale_id"), F.col("created_at").alias("recorded_at"), "slice"), "sale_id")
    _staged(lines.select("sale_id", F.col("total").cast("decimal(18,2)").alias("total"), "recorded_at", "slice"), "sale_id", f"{folder}/staged/lines")
    _staged(s.drop("at"), "id", f"{folder}/staged/sales")
    return len(cuts) + 1


def arrivals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    stream = lambda schema, name: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}")
    return stream(SALES_SCHEMA, "sales"), stream(LINES_SCHEMA, "lines")


def drain_products(spark: SparkSession, folder: str, slices: int, out: str):
    """Run the products series over staged arrivals; returns the stopped query. One query
    takes them slice by slice: a slice appears by a rename, whole, and the next one when
    the rows that its watermark has passed are out of the state."""
    files = Files(spark, folder)
    for name in ("sales", "lines"):
        files.make(f"{folder}/{name}")
    query = start_products(*arrivals(spark, folder), out, {"processingTime": "0 seconds"})
    try:
        for k in range(slices):
            for name in ("sales", "lines"):
                if files.names(f"{folder}/staged/{name}/slice={k}"):
                    files.publish(f"{folder}/staged/{name}/slice={k}", f"{folder}/{name}/{k}")
            query.processAllAvailable()
    finally:
        query.stop()
    return query
