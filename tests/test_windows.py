"""Skew-safe window helpers against plain single-partition windows."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillpoint.operators.windows import (_blocks, carry_forward_max, first_by_order, gap_sessions, global_row_number,
                                         next_within_key, prev_within_key)


def _events(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < 0.4 else rnd.randint(1, 30)          # one hot key
        ts = base + dt.timedelta(seconds=rnd.randint(0, 3 * 24 * 3600))
        rows.append((i, key, ts, rnd.randint(0, 100)))
    return spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v long")


def test_next_and_prev_within_key(spark):
    df = _events(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.select("id", F.lead("ts").over(w).alias("n"), F.lag("ts").over(w).alias("p"))
    got = next_within_key(df, "k", "ts", "id", "n").join(prev_within_key(df, "k", "ts", "id", "p").select("id", "p"), "id")
    assert sorted(want.collect()) == sorted(got.select("id", "n", "p").collect())


def test_carry_forward_and_gap_sessions(spark):
    df = _events(spark).withColumn("mark", F.when(F.col("v") < 5, F.col("ts")))
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.max("mark").over(w).alias("c"))
    got = carry_forward_max(df, "k", "ts", "id", "mark", "c").select("id", "c")
    assert sorted(want.collect()) == sorted(got.collect())
    sess = gap_sessions(df, "k", "ts", "id", 1800, "s").select("id", "k", "ts", "s").toPandas()
    for _, g in sess.sort_values(["ts", "id"]).groupby("k"):
        start = prev = None
        for ts, s in zip(g["ts"], g["s"]):
            if prev is None or (ts - prev).total_seconds() >= 1800:
                start = ts
            assert s == start
            prev = ts


def test_global_row_number_and_first_by_order(spark):
    df = _events(spark).repartition(7)
    got = global_row_number(df, [F.col("v").desc(), F.col("id").asc()], "rn").select("id", "rn")
    want = df.select("id", F.row_number().over(Window.orderBy(F.col("v").desc(), "id")).alias("rn"))
    assert sorted(got.collect()) == sorted(want.collect())
    firsts = first_by_order(df, ["k"], [F.col("ts"), F.col("id")], "f").filter("f").select("k", "id")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id"))) \
             .filter("r = 1").select("k", "id")
    assert sorted(firsts.collect()) == sorted(want.collect())


def test_a_burst_on_one_key_is_cut_into_even_blocks(spark):
    """A third of all rows on one key inside one second, and many at one instant."""
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 0, base + dt.timedelta(microseconds=rnd.randint(0, 999_999) if i % 2 else 500_000), i) for i in range(10_000)]
    rows += [(i, rnd.randint(1, 500), base + dt.timedelta(seconds=rnd.randint(0, 10**6)), i) for i in range(10_000, 30_000)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v long").repartition(5)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small blocks, as if the data were large
    try:
        sizes = [r["count"] for r in _blocks(df, "k", "ts", "id").groupBy("_rb").count().collect()]
        assert len(sizes) > 3 and max(sizes) < 2 * sum(sizes) / len(sizes)
        w = Window.partitionBy("k").orderBy("ts", "id")
        want = df.select("id", F.lead("ts").over(w).alias("n"), F.lag("ts").over(w).alias("p"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
        got = (next_within_key(df, "k", "ts", "id", "n").select("id", "n").join(prev_within_key(df, "k", "ts", "id", "p").select("id", "p"), "id")
               .join(carry_forward_max(df, "k", "ts", "id", "v", "c").select("id", "c"), "id"))
        assert sorted(map(str, want.collect())) == sorted(map(str, got.collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_null_keys_and_times_and_an_empty_table(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, None, t, 5), (2, None, t, 1), (3, 1, None, 2), (4, 1, None, None), (5, 1, t, 1)],
                               "id long, k long, ts timestamp_ntz, v long")
    w = Window.partitionBy("k").orderBy("ts", "id")
    for rows in (df, df.limit(0)):
        want = rows.select("id", F.lead("ts").over(w).alias("n"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
        got = next_within_key(rows, "k", "ts", "id", "n").select("id", "n").join(carry_forward_max(rows, "k", "ts", "id", "v", "c").select("id", "c"), "id")
        assert sorted(map(str, want.collect())) == sorted(map(str, got.collect()))
