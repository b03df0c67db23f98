"""ST2: sliding idle sessions from activity.

Each request extends the session's expiry to ``last + 30 min``; a request at
or after the expiry starts a new session. Batch form: gap-and-island
(lag + carry-forward over even blocks, no per-key window). Streaming form:
``session_window`` with a gap of 30 min minus 1 µs, because Spark keeps an
event that lands exactly on the gap in the old session while the
reference starts a new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.operators.windows import gap_sessions

def _idle():
    return F.expr(f"INTERVAL {P.SESSION_IDLE_MINUTES} MINUTES")


def activity_sessions(activity: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Batch ST2: ``key, session_start, last_activity, expires_at, requests``."""
    marked = gap_sessions(activity.select(key, ts, tie), key, ts, tie,
                          P.SESSION_IDLE_MINUTES * 60, "session_start")
    return (marked.groupBy(key, "session_start")
            .agg(F.max(ts).alias("last_activity"), F.count(F.lit(1)).alias("requests"))
            .withColumn("expires_at", F.col("last_activity") + _idle()))


def session_stream(activity: DataFrame, key: str = "user_id", ts: str = "ts",
                   watermark: str = "1 hour") -> DataFrame:
    """Streaming ST2 over a stream whose ``ts`` is TIMESTAMP (not NTZ). In append
    mode a live query hands out a session once the watermark has passed its end; a
    drained run (:func:`drain_sessions`) hands out the open ones as well."""
    gap = f"{P.SESSION_IDLE_MINUTES * 60 * 1_000_000 - 1} microseconds"
    return (activity.withWatermark(ts, watermark)
            .groupBy(key, F.session_window(ts, gap).alias("session"))
            .agg(F.count(F.lit(1)).alias("requests"), F.max(ts).alias("last_activity"))
            .select(key, F.col("session.start").alias("session_start"), "last_activity",
                    (F.col("last_activity") + _idle()).alias("expires_at"), "requests"))


def drain_sessions(activity: DataFrame, out: str, key: str = "user_id") -> DataFrame:
    """All sessions of a finite stream, the still open ones included: complete mode
    (the input ends, so its state is bounded by it), each batch in its own epoch's
    folder; the last epoch holds every session."""
    spark = activity.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/epoch={epoch}")

    query = (session_stream(activity, key).writeStream.outputMode("complete").foreachBatch(write)
             .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/table")
    return rows.where(F.col("epoch") == rows.select(F.max("epoch")).scalar()).drop("epoch")
