"""Rankings: AG3, AG6, AG7, WN1, WN4/FN16, SO8, SO11.

Lines are pre-aggregated per item before the join with the item table;
the join input is then one row per sold item, and a hot item is combined
map-side by the partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.text import short_label
from tillpoint.operators.windows import global_row_number

def _zero():
    return F.lit(0).cast("decimal(18,2)")


def item_totals(t) -> DataFrame:
    """AG6: quantity and revenue per sold item (inner join: unknown items drop)."""
    per_item = (t.sale_items.groupBy("inventory_item_id")
                .agg(F.sum("quantity").alias("quantity_sold"), F.sum("total").alias("revenue")))
    inv = t.inventory_items.select("id", "name")
    return (per_item.join(inv, per_item.inventory_item_id == inv.id, "inner")
                    .select(inv.id, inv.name, "quantity_sold", "revenue",
                            F.when(F.col("quantity_sold") != 0,
                                   F.col("revenue").cast("double") / F.col("quantity_sold").cast("double"))
                             .otherwise(F.lit(0.0)).alias("average_price")))


def rank_order():
    return [F.col("quantity_sold").desc(), F.col("revenue").desc(), F.col("id").asc()]


def best_selling(t) -> DataFrame:
    """AG6 + WN1: every sold item with its rank (quantity, revenue desc, id)."""
    return global_row_number(item_totals(t), rank_order(), "rank")


def best_selling_top(t, k: int = 8) -> DataFrame:
    """SO11: the first ``k`` of the ranking as a top-k (no full rank needed),
    with the chart's 20-character label."""
    top = item_totals(t).orderBy(*rank_order()).limit(k)
    return top.select("id", "name", short_label(F.col("name")).alias("label"),
                      "quantity_sold", "revenue")


def best_selling_totals(t) -> DataFrame:
    """AG7: total units, total revenue and the top item, one row."""
    it = item_totals(t)
    order = F.struct((-F.col("quantity_sold")).alias("q"), (-F.col("revenue")).alias("r"), F.col("id").alias("i"))
    return it.agg(F.coalesce(F.sum("quantity_sold"), F.lit(0)).cast("bigint").alias("total_units"),
                  F.coalesce(F.sum("revenue"), _zero()).alias("total_revenue"),
                  F.min_by("id", order).alias("top_item_id"),
                  F.min_by("name", order).alias("top_item_name"))


def category_revenue(t) -> DataFrame:
    """AG3: revenue per category of sold items (unsold categories absent), highest
    first."""
    per_item = t.sale_items.groupBy("inventory_item_id").agg(F.sum("total").alias("revenue"))
    inv = t.inventory_items.select("id", "category")
    return (per_item.join(inv, per_item.inventory_item_id == inv.id, "inner")
                    .groupBy("category").agg(F.coalesce(F.sum("revenue"), _zero()).alias("revenue"))
                    .orderBy(*category_order()))


def category_order():
    return [F.col("revenue").desc(), F.col("category").asc()]


def category_share(t) -> DataFrame:
    """FN16 / WN4: each category's share of the total, half-up to 0.1 %.

    The total is a scalar subquery (one distributed sum), not an
    unpartitioned window; the share is exact integer arithmetic on cents.
    """
    cr = category_revenue(t)
    total = cr.select(F.sum("revenue")).scalar()
    rev_cents = (F.col("revenue") * 100).cast("decimal(38,0)")
    tot_cents = (total * 100).cast("decimal(38,0)")
    tenths = F.expr("(rc * 2000 + tc) div (2 * tc)")
    return (cr.withColumn("rc", rev_cents).withColumn("tc", tot_cents)
              .select("category", "revenue",
                      F.when(F.col("tc") > 0, tenths.cast("double") / 10.0).otherwise(F.lit(0.0)).alias("share_pct")))


def best_category(t) -> DataFrame:
    """SO8: highest-revenue category (name breaks ties), NULL when none."""
    cr = category_revenue(t)
    order = F.struct((-F.col("revenue")).alias("r"), F.col("category").alias("c"))
    return cr.agg(F.min_by("category", order).alias("best_category"),
                  F.min_by("revenue", order).alias("best_category_revenue"))
