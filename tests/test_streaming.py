"""ST2 / ST3: streaming forms agree with the batch forms; the session edge."""

import datetime as dt

from pyspark.sql import functions as F

from tillpoint.sources.canonical import requests_from_events
from tillpoint.streaming import live_totals, sessions

SMALL = "/root/testdata/sf0.001"


def test_stream_daily_totals_equal_batch(spark, tables):
    streamed = live_totals.run_daily_totals(spark, SMALL)
    batch = live_totals.daily_totals(requests_from_events(tables.raw("events")))
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_streams_read_a_folder_of_files_and_see_new_ones(spark, tables):
    """The events table as a folder of part files; a live query picks up a file of
    later events that is added."""
    import os
    import shutil
    import tempfile
    import time

    folder = tempfile.mkdtemp(prefix="live-", dir=os.environ.get("TILLPOINT_SCRATCH"))
    events = tables.raw("events")
    cut = sorted(r["ts"] for r in events.select("ts").collect())[len(events.collect()) // 2]
    low, high = events.where(F.col("ts") < F.lit(cut)), events.where(F.col("ts") >= F.lit(cut))
    low.repartition(3).write.parquet(f"{folder}/events.parquet")
    high.coalesce(1).write.parquet(f"{folder}/more")
    want = lambda e: sorted(live_totals.daily_totals(requests_from_events(e)).collect())
    out = live_totals.scratch_path(spark, "live-totals")
    query = live_totals.start_daily_totals(spark, folder, out, {"processingTime": "1 second"})
    try:
        assert query.isActive
        query.processAllAvailable()
        assert sorted(live_totals.read_daily_totals(spark, out).collect()) == want(low)
        (part,) = [f for f in os.listdir(f"{folder}/more") if f.endswith(".parquet")]
        shutil.copy(f"{folder}/more/{part}", f"{folder}/events.parquet/late-{part}")
        end = time.time() + 60
        while time.time() < end and sorted(live_totals.read_daily_totals(spark, out).collect()) != want(events):
            query.processAllAvailable()
            time.sleep(1)
        assert sorted(live_totals.read_daily_totals(spark, out).collect()) == want(events)
    finally:
        query.stop()
    drained = sessions.drain_sessions(
        live_totals.events_stream(spark, folder).select("user_id", F.to_timestamp("ts").alias("ts")), live_totals.scratch_path(spark, "live-sessions"))
    assert drained.count() == sessions.activity_sessions(spark.read.parquet(f"{folder}/events.parquet")).count()


def test_session_gap_edge(spark):
    t0 = dt.datetime(2024, 1, 1, 9)
    rows = [(1, 1, t0), (2, 1, t0 + dt.timedelta(minutes=30) - dt.timedelta(microseconds=1)),
            (3, 1, t0 + dt.timedelta(minutes=60) - dt.timedelta(microseconds=1)),  # exactly 30 min later
            (4, 2, t0)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    got = sorted((r["user_id"], r["session_start"], r["requests"]) for r in sessions.activity_sessions(df).collect())
    assert got == [(1, t0, 2), (1, t0 + dt.timedelta(minutes=60) - dt.timedelta(microseconds=1), 1), (2, t0, 1)]


def _attempt_files(spark, folder, rows, n):
    spark.createDataFrame(rows, "key string, ts timestamp_ntz, success boolean").withColumn("ts", F.col("ts").cast("timestamp")) \
         .coalesce(1).write.parquet(f"{folder}/in/part={n}")


def test_lockout_stream_matches_batch_in_any_order(spark):
    """Rows arrive shuffled, later by up to 20 minutes, over several batches; a
    heartbeat ends the run and no state is left."""
    import random

    from tillpoint.streaming.lockouts import ACCOUNT, detect_lockouts, read_lockouts, start_lockouts

    rnd = random.Random(11)
    t0 = dt.datetime(2024, 1, 1, 8)
    rows = []
    for key in ["a", "b", "c", "hot", "hot"]:
        t = t0 + dt.timedelta(minutes=rnd.randint(0, 100))
        for _ in range(40):
            t += dt.timedelta(seconds=rnd.choice([5, 20, 60, 300, 901]))
            rows.append((key, t, rnd.random() < 0.08))
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rnd.uniform(0, 20)))
    assert rows != sorted(rows, key=lambda r: r[1])
    folder = live_totals.scratch_path(spark, "lock-stream")
    end = max(r[1] for r in rows)
    for n, chunk in enumerate((rows[:60], rows[60:130], rows[130:], [(None, end + dt.timedelta(days=1), True)])):
        _attempt_files(spark, folder, chunk, n)
        stream = spark.readStream.schema("key string, ts timestamp, success boolean, part int").parquet(f"{folder}/in")
        query = start_lockouts(stream.select("key", "ts", "success"), folder, {"availableNow": True}, ACCOUNT)
        query.awaitTermination()
    streamed = sorted((r["key"], r["locked_at"].replace(tzinfo=None), r["locked_until"].replace(tzinfo=None), r["failures"]) for r in read_lockouts(spark, folder).collect())
    batch = sorted(map(tuple, detect_lockouts(spark.createDataFrame(rows, "key string, ts timestamp_ntz, success boolean")).collect()))
    assert streamed == batch and batch
    (state,) = query.lastProgress["stateOperators"]
    assert state["numRowsTotal"] == 0


def test_lockout_rows_beyond_the_lateness_are_dropped(spark):
    """A failure that arrives an hour late does not complete a lock."""
    from tillpoint.streaming.lockouts import ACCOUNT, read_lockouts, start_lockouts

    t0 = dt.datetime(2024, 1, 1, 8)
    fails = [("k", t0 + dt.timedelta(seconds=s), False) for s in range(ACCOUNT.max_failures - 1)]
    folder = live_totals.scratch_path(spark, "lock-late")
    for n, chunk in enumerate((fails, [(None, t0 + dt.timedelta(hours=1), True)], [("k", t0 + dt.timedelta(seconds=30), False)], [(None, t0 + dt.timedelta(days=1), True)])):
        _attempt_files(spark, folder, chunk, n)
        stream = spark.readStream.schema("key string, ts timestamp, success boolean, part int").parquet(f"{folder}/in")
        query = start_lockouts(stream.select("key", "ts", "success"), folder, {"availableNow": True})
        query.awaitTermination()
    assert read_lockouts(spark, folder).collect() == [] and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_alert_feed_appends_only_new(spark):
    """The drained feed shows every alert once; a poll that is written again, a poll with
    an unchanged feed and a null link add nothing; a changed text does."""
    from tillpoint.operators.dashboard import notifications
    from tillpoint.sources.tables import Tables
    from tillpoint.streaming import alerts

    out = live_totals.scratch_path(spark, "alerts-test")
    seen = alerts.run_alert_feed(spark, SMALL, "2000-06-15", out)
    feed = notifications(Tables(spark, SMALL), "2000-06-15")
    want = sorted(feed.select("title", "message").collect())
    assert sorted(seen.select("title", "message").collect()) == want
    assert seen.where("link is null").count() > 0
    now = F.current_timestamp()
    for poll, rows in (("epoch=0", feed), ("again", feed), ("later", feed.withColumn("message", F.concat("message", F.lit("!"))))):
        alerts.write_poll(rows, out, poll, now)
        alerts.start_shown(spark, out, {"availableNow": True}).awaitTermination()
        if poll != "later":
            assert sorted(alerts.read_shown(spark, out).select("title", "message").collect()) == want
    assert alerts.read_shown(spark, out).count() == 2 * len(want)


def test_shown_alerts_are_forgotten_after_the_memory(spark):
    """The state holds the keys of the memory only; after it an alert is new again."""
    import datetime as dt

    from tillpoint.streaming import alerts

    out = live_totals.scratch_path(spark, "alerts-memory")
    for day in range(1, 13):
        rows = spark.createDataFrame([(1, "t", "same", "m", None), (2, "t", f"day {day}", "m", "/x")], "position int, tone string, title string, message string, link string")
        alerts.write_poll(rows, out, f"day={day}", F.lit(dt.datetime(2024, 1, day)).cast("timestamp"))
        query = alerts.start_shown(spark, out, {"availableNow": True}, "2 days")
        query.awaitTermination()
    shown = sorted(r.shown_at.day for r in alerts.read_shown(spark, out).where("title = 'same'").collect())
    assert shown[0] == 1 and 2 < len(shown) < 6 and all(b - a > 2 for a, b in zip(shown, shown[1:]))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


def test_epochs_are_merged_and_a_batch_may_be_replayed(spark):
    from tillpoint.streaming.epochs import EpochTable

    table = EpochTable(spark, live_totals.scratch_path(spark, "epochs"), "k long, v long", ["k"], every=5)
    batch = lambda n: spark.range(n % 4, n % 4 + 3).selectExpr("id AS k", f"CAST({n} AS LONG) AS v").coalesce(1)
    want, most = {}, 0
    assert table.read().collect() == []
    for n in range(30):
        table.write(batch(n), n)
        want |= {k: n for k in range(n % 4, n % 4 + 3)}
        most = max(most, len(table.folders()))
        if n in (7, 13, 29):  # right after a merge too
            assert {r.k: (r.v, r.epoch) for r in table.read().collect()} == {k: (v, v) for k, v in want.items()}
            table.write(batch(n), n)
            assert {r.k: r.v for r in table.read().collect()} == want
            assert {r.k: r.v for r in table.read(n).collect()} == {k: max(e for e in range(n) if e % 4 <= k < e % 4 + 3) for k in {k for e in range(n) for k in range(e % 4, e % 4 + 3)}}
    assert most <= 8 and len(table._files.names(f"{table.root}/tail")) <= 14 and len(table._bases()) <= 2


def test_lines_that_arrive_before_their_sale(spark):
    """Whichever side comes first, each line counts once on its sale's day; a line
    without a sale never does, and old rows leave the state."""
    from tillpoint.streaming import month_chart as MC

    out = live_totals.scratch_path(spark, "chart-test")
    day = dt.datetime(2024, 1, 5, 10)
    at = lambda m: day + dt.timedelta(minutes=m)
    put = lambda rows, schema, where: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{out}/in/{where}")
    from decimal import Decimal as D
    steps = [([], [(1, D("5.00"), at(0)), (9, D("7.00"), at(1))]),
             ([(1, day.date(), at(1)), (2, day.date(), at(2))], [(1, D("1.50"), at(2))]),
             ([], [(2, D("2.00"), at(3)), (1, D("0.25"), at(4))]),
             ([(3, dt.date(2024, 1, 8), at(3 * 24 * 60))], [(3, D("4.00"), at(3 * 24 * 60)), (2, D("100.00"), at(5))])]
    totals = []
    for sales, lines in steps:
        put(sales, MC.SALES_SCHEMA, "sales")
        put(lines, MC.LINES_SCHEMA, "lines")
        query = MC.start_products(*MC.arrivals(spark, f"{out}/in"), out, {"availableNow": True})
        query.awaitTermination()
        totals.append({str(r.day): str(r.products) for r in MC.products_table(spark, out).read().collect()})
    assert totals[0] == {} and totals[1] == {"2024-01-05": "6.50"} and totals[2] == {"2024-01-05": "8.75"}
    # the last line came three days late: with its sale still in state it counts
    assert totals[3] == {"2024-01-05": "108.75", "2024-01-08": "4.00"}
    put([], MC.SALES_SCHEMA, "sales")
    put([(2, D("100.00"), at(6))], MC.LINES_SCHEMA, "lines")
    query = MC.start_products(*MC.arrivals(spark, f"{out}/in"), out, {"availableNow": True})
    query.awaitTermination()
    assert {str(r.day): str(r.products) for r in MC.products_table(spark, out).read().collect()} == totals[3]
    assert query.lastProgress is None or query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_a_backlog_is_drained_by_slices_of_time(spark):
    """The join's state holds a slice or two, not the backlog; every line still counts,
    at an instant with many rows, near a slice's edge and without a time, too."""
    from decimal import Decimal as D
    from types import SimpleNamespace

    from tillpoint.streaming import month_chart as MC

    day = dt.datetime(2024, 1, 1)
    at = [day + dt.timedelta(minutes=m) for k in range(20) for m in (k * 1440, k * 1440, k * 1440 + 5)] + [None]
    sales = [(i, t and t.date(), t) for i, t in enumerate(at)]
    lines = [(i, D("1.25") * n) for i in range(len(at)) for n in (1, 2)] + [(999, D("9.00"))]
    t = SimpleNamespace(spark=spark, sales=spark.createDataFrame(sales, "id long, sale_date date, created_at timestamp_ntz"),
                        sale_items=spark.createDataFrame(lines, "sale_id long, total decimal(18,2)"))
    seen = {}
    for size in (1000, 6):
        out = live_totals.scratch_path(spark, "slices-test")
        slices = MC.write_arrivals(t, f"{out}/in", size)
        query = MC.drain_products(spark, f"{out}/in", slices, out)
        totals = {r.day: r.products for r in MC.products_table(spark, out).read().collect()}
        assert totals == {(day + dt.timedelta(days=k)).date(): D("11.25") for k in range(20)}
        seen[size] = slices, max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
        assert not query.isActive
    assert seen[1000][0] == 1 and seen[1000][1] >= 3 * 60
    assert seen[6][0] >= 6 and seen[6][1] <= 80
