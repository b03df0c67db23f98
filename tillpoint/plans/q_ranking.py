"""Registered ranking queries (QY6, QY7) with their oracles."""

from __future__ import annotations

from tillpoint.operators import ranking as R
from tillpoint.plans.present import flat, positioned
from tillpoint.plans.registry import register
from tillpoint.plans.sqlviews import with_views

_SOLD = """
sold AS (SELECT inventory_item_id AS id, sum(quantity) AS q, sum(total) AS r FROM sale_items GROUP BY inventory_item_id)"""

_ITEM_AGG = f"""{_SOLD},
agg AS (SELECT id, (SELECT name FROM inventory_items i WHERE i.id = sold.id) AS name, q, r
        FROM sold WHERE id IN (SELECT id FROM inventory_items))"""

_CAT_AGG = f"""{_SOLD},
cat AS (SELECT category, coalesce(sum(r), 0) AS revenue FROM inventory_items NATURAL JOIN sold GROUP BY category)"""


@register("best_selling", with_views(f"""
WITH {_ITEM_AGG}
SELECT id, name, CAST(q AS BIGINT) AS quantity_sold, CAST(r AS DOUBLE) AS revenue,
       CASE WHEN q <> 0 THEN CAST(r AS DOUBLE) / CAST(q AS DOUBLE) ELSE 0.0 END AS average_price,
       CAST(row_number() OVER (ORDER BY q DESC, r DESC, id ASC) AS BIGINT) AS rank
FROM agg""", "sale_items", "inventory_items"))
def best_selling(t):
    return flat(R.best_selling(t))


@register("best_selling_top8", with_views(f"""
WITH {_ITEM_AGG}
SELECT id, name, CASE WHEN length(name) > 20 THEN substr(name, 1, 20) || '...' ELSE name END AS label,
       CAST(q AS BIGINT) AS quantity_sold, CAST(r AS DOUBLE) AS revenue
FROM agg ORDER BY q DESC, r DESC, id ASC LIMIT 8""", "sale_items", "inventory_items"))
def best_selling_top8(t):
    return flat(R.best_selling_top(t, 8))


@register("best_selling_totals", with_views(f"""
WITH {_ITEM_AGG}
SELECT CAST(COALESCE(SUM(q), 0) AS BIGINT) AS total_units,
       CAST(COALESCE(SUM(r), 0) AS DOUBLE) AS total_revenue,
       (SELECT id FROM agg ORDER BY q DESC, r DESC, id ASC LIMIT 1) AS top_item_id,
       (SELECT name FROM agg ORDER BY q DESC, r DESC, id ASC LIMIT 1) AS top_item_name
FROM agg""", "sale_items", "inventory_items"))
def best_selling_totals(t):
    return flat(R.best_selling_totals(t))


@register("category_revenue", with_views(f"""
WITH {_CAT_AGG}
SELECT category, CAST(revenue AS DOUBLE) AS revenue,
       CAST(row_number() OVER (ORDER BY revenue DESC, category) AS BIGINT) AS position FROM cat""", "sale_items", "inventory_items"))
def category_revenue(t):
    """AG3 with each category's place."""
    return flat(positioned(R.category_revenue(t), ["category"], R.category_order(), ["revenue"]))


@register("category_share", with_views(f"""
WITH {_CAT_AGG},
tot AS (SELECT CAST(SUM(revenue) * 100 AS HUGEINT) AS tc FROM cat)
SELECT category, CAST(revenue AS DOUBLE) AS revenue,
       CASE WHEN tc > 0 THEN CAST((CAST(revenue * 100 AS HUGEINT) * 2000 + tc) // (2 * tc) AS DOUBLE) / 10.0
            ELSE 0.0 END AS share_pct
FROM cat, tot""", "sale_items", "inventory_items"))
def category_share(t):
    return flat(R.category_share(t))


@register("best_category", with_views(f"""
WITH {_CAT_AGG}
SELECT (SELECT category FROM cat ORDER BY revenue DESC, category ASC LIMIT 1) AS best_category,
       CAST((SELECT revenue FROM cat ORDER BY revenue DESC, category ASC LIMIT 1) AS DOUBLE) AS best_category_revenue
""", "sale_items", "inventory_items"))
def best_category(t):
    return flat(R.best_category(t))
