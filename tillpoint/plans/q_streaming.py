"""Registered stateful / streaming queries (ST1-ST3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.functions.dates import as_utc_instant, shift_days
from tillpoint.operators.dashboard import notifications
from tillpoint.plans.present import flat
from tillpoint.plans.q_digital import CHART_MONTH_SQL, notifications_sql
from tillpoint.plans.registry import register
from tillpoint.plans.sqlviews import with_views
from tillpoint.session import cut_lineage
from tillpoint.streaming import alerts, live_totals, lockouts, month_chart, sessions


# Attempts that do reach the limits: every event of a user group's day squeezed into
# its first hour; sign-ups succeed.
_ATTEMPTS_SQL = """
tries AS (SELECT 'group' || CAST(user_id % 20 AS VARCHAR) AS key, date_trunc('day', ts) + INTERVAL (event_id % 3600) SECOND AS ts,
                 event_type = 'signup' AS success FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, success) AS n FROM tries)"""


def lockouts_sql(preset) -> str:
    """The rule attempt by attempt, all keys side by side."""
    lock, window = f"INTERVAL {preset.lock_minutes} MINUTE", f"INTERVAL {preset.window_minutes} MINUTE"
    return f"""
WITH RECURSIVE {_ATTEMPTS_SQL.strip()},
walk(key, n, ts, first, failures, until, locked) AS (
  SELECT key, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), 0, CAST(NULL AS TIMESTAMP), false FROM numbered WHERE n = 1
  UNION ALL
  SELECT s.key, s.n, s.ts,
         CASE WHEN s.refused THEN s.first WHEN s.success THEN NULL WHEN s.again THEN s.first ELSE s.ts END,
         CASE WHEN s.refused THEN s.failures WHEN s.success THEN 0 WHEN s.again THEN s.failures + 1 ELSE 1 END,
         CASE WHEN s.refused THEN s.until WHEN NOT s.success AND CASE WHEN s.again THEN s.failures + 1 ELSE 1 END >= {preset.max_failures} THEN s.ts + {lock} END,
         NOT s.refused AND NOT s.success AND CASE WHEN s.again THEN s.failures + 1 ELSE 1 END >= {preset.max_failures}
  FROM (SELECT a.key, a.n, a.ts, a.success, w.first, w.failures, w.until,
               coalesce(w.until > a.ts, false) AS refused,
               w.until IS NULL AND w.first IS NOT NULL AND a.ts <= w.first + {window} AS again
        FROM walk w JOIN numbered a ON a.key = w.key AND a.n = w.n + 1) s)
SELECT key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS locked_at, strftime(until, '%Y-%m-%d %H:%M:%S.%f') AS locked_until,
       CAST(failures AS BIGINT) AS failures
FROM walk WHERE locked"""


def _attempts(t):
    e = t.raw("events")
    ts = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("event_id") % 3600).cast("decimal(18,6)"))
    return e.select(F.concat(F.lit("group"), (F.col("user_id") % 20).cast("string")).alias("key"), ts.alias("ts"),
                    (F.col("event_type") == "signup").alias("success"))


@register("lockouts", lockouts_sql(lockouts.ACCOUNT))
def lockouts_account(t):
    """ST1 with the account preset."""
    return flat(lockouts.detect_lockouts(_attempts(t), lockouts.ACCOUNT))


@register("lockouts_address", lockouts_sql(lockouts.ADDRESS))
def lockouts_address(t):
    """ST1 with the address preset."""
    return flat(lockouts.detect_lockouts(_attempts(t), lockouts.ADDRESS))


@register("lockouts_pin", lockouts_sql(lockouts.PIN))
def lockouts_pin(t):
    """ST1 with the PIN preset."""
    return flat(lockouts.detect_lockouts(_attempts(t), lockouts.PIN))


@register("lockouts_stream", lockouts_sql(lockouts.ACCOUNT))
def lockouts_stream(t):
    """ST1 streaming form, drained: attempts arrive out of order (up to 20 minutes late)
    in three slices, then a heartbeat lets the watermark pass all of them."""
    folder = live_totals.scratch_path(t.spark, "lockouts")
    attempts = _attempts(t).withColumn("late", F.pmod(F.xxhash64("key", "ts"), F.lit(1200)))
    arrival = attempts.withColumn("arrives", F.unix_seconds(as_utc_instant(F.col("ts"))) + F.col("late"))
    arrival = cut_lineage(arrival.select("key", as_utc_instant(F.col("ts")).alias("ts"), "success", "arrives"))
    cuts = [float("-inf"), *arrival.approxQuantile("arrives", [1 / 3, 2 / 3], 0.01), float("inf")]
    slices = [arrival.where((F.col("arrives") > lo) & (F.col("arrives") <= hi)) for lo, hi in zip(cuts, cuts[1:])]
    beat = arrival.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(F.lit(None).cast("string").alias("key"), "ts", F.lit(True).alias("success"))
    for rows in (*slices, beat):
        rows.select("key", "ts", "success").write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema("key string, ts timestamp, success boolean").parquet(f"{folder}/in")
        lockouts.start_lockouts(stream, folder, {"availableNow": True}).awaitTermination()
    return flat(lockouts.read_lockouts(t.spark, folder))


_SESSIONS_SQL = """
WITH a AS (SELECT user_id, ts, event_id,
                  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
b AS (SELECT *, CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN ts END AS start FROM a),
c AS (SELECT *, max(start) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_start FROM b)
SELECT user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_activity,
       CAST(count(*) AS BIGINT) AS requests,
       strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS expires_at
FROM c GROUP BY user_id, session_start"""


@register("sessions", _SESSIONS_SQL.strip())
def activity_sessions(t):
    """ST2 batch: idle-timeout sessions over all activity (events)."""
    return flat(sessions.activity_sessions(t.raw("events")))


@register("stream_daily_totals", with_views("""
SELECT strftime(CAST(completed_at + INTERVAL 8 HOUR AS DATE), '%Y-%m-%d') AS day, service_type,
       CAST(SUM(amount) AS DOUBLE) AS total, CAST(count(*) AS BIGINT) AS requests
FROM digital_service_requests
WHERE status = 'Completed' AND completed_at IS NOT NULL
GROUP BY 1, 2""", "digital_service_requests"))
def stream_daily_totals(t):
    """ST3: the streaming query drained with availableNow, read back."""
    return flat(live_totals.run_daily_totals(t.spark, t.data_dir))


@register("stream_sessions", _SESSIONS_SQL.strip())
def stream_sessions(t):
    """ST2 streaming form (session_window), drained."""
    activity = live_totals.events_stream(t.spark, t.data_dir).select("user_id", as_utc_instant(F.col("ts")).alias("ts"))
    return flat(sessions.drain_sessions(activity, live_totals.scratch_path(t.spark, "sessions")))


_POLL_DAYS = [shift_days(P.AS_OF, -2), shift_days(P.AS_OF, -1), P.AS_OF]


@register("alerts_stream", with_views("WITH " + ", ".join(f"day{k} AS ({notifications_sql(d)})" for k, d in enumerate(_POLL_DAYS))
    + "SELECT title, message, link, tone, min(day) AS shown_at FROM ("
    + " UNION ALL ".join(f"SELECT *, '{d} 00:00:00.000000' AS day FROM day{k}" for k, d in enumerate(_POLL_DAYS))
    + ") GROUP BY title, message, link, tone", "digital_service_requests", "inventory_items", "sales"))
def alerts_stream(t):
    """ST5 streaming form: the feeds of three days as polls, the last one written twice;
    every alert once, with the day that showed it first."""
    out = live_totals.scratch_path(t.spark, "alerts")
    for day in (*_POLL_DAYS, _POLL_DAYS[-1]):
        alerts.write_poll(notifications(t, day), out, f"day={day}", as_utc_instant(F.lit(day).cast("timestamp_ntz")))
        alerts.start_shown(t.spark, out, {"availableNow": True}).awaitTermination()
    return flat(alerts.read_shown(t.spark, out).select("title", "message", "link", "tone", "shown_at"))


@register("alert_feed_live", with_views(f"SELECT title, message, link, tone FROM ({notifications_sql(P.AS_OF)})",
                                        "digital_service_requests", "inventory_items", "sales"))
def alert_feed_live(t):
    """ST4 + ST5 live feed, drained: running pending counts from the events stream."""
    return flat(alerts.run_alert_feed(t.spark, t.data_dir, P.AS_OF).select("title", "message", "link", "tone"))


@register("chart_stream", CHART_MONTH_SQL)
def chart_stream(t):
    """ST3 streaming form, drained: GCash, load and products from three streams."""
    out = live_totals.scratch_path(t.spark, "chart")
    slices = month_chart.write_arrivals(t, f"{out}/in")
    live_totals.start_daily_totals(t.spark, t.data_dir, out, {"availableNow": True}).awaitTermination()
    month_chart.drain_products(t.spark, f"{out}/in", slices, out)
    return flat(month_chart.read_chart(t.spark, out, P.AS_OF))
