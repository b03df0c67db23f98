"""QY12: quick-sale recommendations, and AG15 cart totals.

Scores per available item over every product line:
* today = quantity sold on ``as_of``;
* week  = quantity sold on or after ``as_of - 6`` (open upper bound);
* smart = sum of ``3 * quantity + max(1, 14 - days_ago)`` per line, with
  ``days_ago = max(0, as_of - sale_date)``.
Top 6 / 6 / 8; an empty smart list falls back to the first 8 available
items by name. Ties: the reference keeps first-seen order while walking
sales newest first, i.e. the item's latest contributing sale wins; here
latest sale date desc, latest sale id desc, item id asc.

Lines are aggregated per item (partial aggregation) before anything is
sorted; each list is a top-k (TakeOrderedAndProject), never a full sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.functions.dates import date_lit, shift_days
from tillpoint.functions.normalize import normalize_item_status
from tillpoint.operators.sales import sale_lines_all


def available_items(t) -> DataFrame:
    i = t.inventory_items
    return i.filter(normalize_item_status(F.col("status")) != P.OUT_OF_STOCK).select("id", "name")


def item_scores(t, as_of: str) -> DataFrame:
    s = t.sales.select(F.col("id").alias("sale_id"), "sale_date")
    lines = t.sale_items.select("sale_id", F.col("inventory_item_id").alias("id"), "quantity")
    avail = available_items(t)
    # scores first: the items' availability is looked up once an item, not once a
    # line, and a hot item is one row by then
    scored = lines.join(s, "sale_id", "inner")
    today = F.col("sale_date") == date_lit(as_of)
    week = F.col("sale_date") >= date_lit(shift_days(as_of, -6))
    days_ago = F.greatest(F.lit(0), F.datediff(date_lit(as_of), F.col("sale_date")))
    smart = F.col("quantity") * 3 + F.greatest(F.lit(1), F.lit(14) - days_ago)
    latest = F.struct("sale_date", "sale_id")
    agg = scored.groupBy("id").agg(
        F.sum(F.when(today, F.col("quantity"))).alias("today_score"),
        F.max(F.when(today, latest)).alias("today_latest"),
        F.sum(F.when(week, F.col("quantity"))).alias("week_score"),
        F.max(F.when(week, latest)).alias("week_latest"),
        F.sum(smart).alias("smart_score"),
        F.max(latest).alias("smart_latest"))
    return agg.join(avail, "id", "inner")


def _top(scores: DataFrame, which: str, k: int) -> DataFrame:
    score, latest = F.col(f"{which}_score"), F.col(f"{which}_latest")
    top = (scores.filter(score.isNotNull())
           .orderBy(score.desc(), latest["sale_date"].desc(), latest["sale_id"].desc(), F.col("id").asc())
           .limit(k))
    return top.select(F.lit(which).alias("list"), "id", "name", score.cast("bigint").alias("score"),
                      latest["sale_date"].alias("_d"), latest["sale_id"].alias("_s"),
                      F.lit(None).cast("string").alias("_n"))


def recommendations(t, as_of: str) -> DataFrame:
    """``list, position, id, name, score`` for the today / week / smart lists."""
    from pyspark.sql import Window

    scores = item_scores(t, as_of)
    lists = _top(scores, "today", 6).unionByName(_top(scores, "week", 6)).unionByName(_top(scores, "smart", 8))
    n_smart = scores.filter(F.col("smart_score").isNotNull()).select(F.count(F.lit(1))).scalar()
    fallback = (available_items(t).orderBy("name", "id").limit(8)
                .select(F.lit("smart").alias("list"), "id", "name", F.lit(None).cast("bigint").alias("score"),
                        F.lit(None).cast("date").alias("_d"), F.lit(None).cast("bigint").alias("_s"),
                        F.col("name").alias("_n"))
                .filter(n_smart == 0))
    every = lists.unionByName(fallback)
    # at most 20 rows here, so a small window is fine
    w = Window.partitionBy("list").orderBy(F.col("score").desc_nulls_last(), F.col("_d").desc(),
                                           F.col("_s").desc(), "_n", "id")
    return every.withColumn("position", F.row_number().over(w)).drop("_d", "_s", "_n")


def cart_totals(t) -> DataFrame:
    """AG15: amount, line count and units per cart (each sale's payload)."""
    lines = sale_lines_all(t)
    return lines.groupBy(F.col("sale_id").alias("cart_id")).agg(
        F.sum(F.col("quantity") * F.col("price")).cast("decimal(18,2)").alias("amount"),
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))
