"""ST4 live feed and ST5 new-alert detection.

An alert is new when its key ``(title, message, link, tone)`` has not been
seen before: in a batch a null-safe anti join against the seen keys (``link`` may be
NULL), in a stream a deduplication with a bounded memory. The live feed keeps running
counts of pending requests: each micro-batch of incoming events (``foreachBatch``; the
reference polls every 10 s) adds its own, and the feed is built from the total, the
inventory and the week's sales, never from all requests again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.operators.dashboard import AlertSettings, notifications
from tillpoint.sources.canonical import requests_from_events
from tillpoint.sources.tables import Tables
from tillpoint.streaming.epochs import EpochTable
from tillpoint.streaming.live_totals import events_stream, scratch_path

ALERT_KEY = ("title", "message", "link", "tone")


def new_alerts(current: DataFrame, seen: DataFrame) -> DataFrame:
    """ST5: alerts of ``current`` whose key is not in ``seen``."""
    cond = reduce(lambda a, b: a & b, [current[c].eqNullSafe(seen[c]) for c in ALERT_KEY])
    return current.join(seen.select(*ALERT_KEY), cond, "left_anti")


FEED_SCHEMA = "position int, tone string, title string, message string, link string, shown_at timestamp"
#: How long a shown alert is remembered: the state holds the keys of this time.
MEMORY = "7 days"


def shown_stream(spark: SparkSession, feed: str, memory: str = MEMORY) -> DataFrame:
    """ST5 streaming: the first of each alert key among the polls under ``feed`` (files
    of feed rows with ``shown_at``). A poll that is written again adds nothing, and a
    key is forgotten when the watermark is ``memory`` past it."""
    polls = spark.readStream.schema(FEED_SCHEMA).option("recursiveFileLookup", "true").parquet(feed)
    return polls.withWatermark("shown_at", memory).dropDuplicatesWithinWatermark(list(ALERT_KEY))


def start_shown(spark: SparkSession, out: str, trigger: dict, memory: str = MEMORY):
    """Start ST5 from ``<out>/feed`` into ``<out>/seen`` (a file sink, each batch once);
    returns the query handle."""
    return (shown_stream(spark, f"{out}/feed", memory).writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", f"{out}/_seen").trigger(**trigger).start(f"{out}/seen"))


def read_shown(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(FEED_SCHEMA).parquet(f"{out}/seen")


def write_poll(current: DataFrame, out: str, poll: str, shown_at: Column) -> None:
    """One poll's feed, in a folder of its own that a repeated poll writes again."""
    rows = current.select(F.col("position").cast("int").alias("position"), *[F.col(c) for c in ("tone", "title", "message", "link")], shown_at.alias("shown_at"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{out}/feed/{poll}")


COUNTS = ("eload_pending", "gcash_pending", "total_pending")


def start_alert_feed(spark: SparkSession, data_dir: str, as_of: str, out: str, trigger: dict,
                     settings: AlertSettings = AlertSettings(), role: str = "Admin"):
    """Live ST4: each batch of new events adds to the pending counts (an ``EpochTable``
    of one row: a batch reads the total before it and its own rows only) and writes
    the feed as a poll under ``<out>/feed``. Returns the query handle."""
    counts = EpochTable(spark, f"{out}/counts", ", ".join(f"{c} long" for c in ("one", *COUNTS)), ["one"])

    def on_batch(batch: DataFrame, epoch: int) -> None:
        requests = requests_from_events(batch).filter(F.col("status") == P.PENDING)
        mine = requests.agg(F.count_if(F.col("service_type") == "eload").alias(COUNTS[0]),
                            F.count_if(F.col("service_type") == "gcash").alias(COUNTS[1]), F.count(F.lit(1)).alias(COUNTS[2]))
        both = counts.read(epoch).select(*COUNTS).unionByName(mine).agg(*[F.sum(c).alias(c) for c in COUNTS])
        counts.write(both.select(F.lit(1).cast("long").alias("one"), *COUNTS), epoch)
        current = notifications(Tables(spark, data_dir), as_of, settings, role, counts.read(epoch + 1).select(*COUNTS))
        write_poll(current, out, f"epoch={epoch}", F.current_timestamp())

    return (events_stream(spark, data_dir).writeStream.foreachBatch(on_batch)
            .option("checkpointLocation", f"{out}/_checkpoint").trigger(**trigger).start())


def run_alert_feed(spark: SparkSession, data_dir: str, as_of: str, out_dir: str | None = None,
                   settings: AlertSettings = AlertSettings(), role: str = "Admin") -> DataFrame:
    """ST4 + ST5 drained: the feed of everything that is there now, and the alerts that
    were not shown before."""
    out = out_dir or scratch_path(spark, "alerts")
    start_alert_feed(spark, data_dir, as_of, out, {"availableNow": True}, settings, role).awaitTermination()
    start_shown(spark, out, {"availableNow": True}).awaitTermination()
    return read_shown(spark, out)
