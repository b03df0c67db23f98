"""The canonical views as SQL text, for the DuckDB oracles.

These are an independent statement of FIXTURES §3 in plain SQL; the
Spark side builds the same views with the DataFrame API
(``tillpoint.sources.canonical``). ``with_views`` prefixes a query with
just the CTEs it needs.
"""

from __future__ import annotations

_CODE = "CASE WHEN {k} < 10000 THEN lpad(CAST({k} AS VARCHAR), 4, '0') ELSE CAST({k} AS VARCHAR) END"

VIEWS: dict[str, str] = {
    "sales": f"""
SELECT o_orderkey AS id,
       'S' || {_CODE.format(k='o_orderkey')} AS transaction_code,
       CAST(o_orderdate AS DATE) AS sale_date,
       o_orderpriority AS payment_method,
       c_name AS employee_name,
       CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
       o_orderdate AS created_at
FROM orders JOIN customer ON c_custkey = o_custkey""",
    "inventory_items": """
SELECT p_partkey AS id,
       '480' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS barcode,
       p_name || ' (' || p_brand || ')' AS name,
       p_type AS category,
       s_name AS supplier,
       CASE WHEN p_size - 1 <= 0 THEN 'Out of Stock' WHEN p_size - 1 <= 10 THEN 'Low Stock' ELSE 'In Stock' END AS status,
       CAST(p_size - 1 AS INTEGER) AS stock_quantity,
       CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) + CAST(p_partkey % 20 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS selling_price,
       10 AS reorder_level
FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)""",
    "sale_items": """
SELECT l_orderkey AS sale_id,
       l_partkey AS inventory_item_id,
       p_name || ' (' || p_brand || ')' AS item_name,
       l_linenumber AS line_no,
       CAST(l_quantity AS INTEGER) AS quantity,
       CAST(p_retailprice AS DECIMAL(18,2)) AS price,
       CAST(CAST(l_quantity AS INTEGER) * CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS total
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "digital_service_requests": f"""
SELECT event_id AS id,
       CASE WHEN event_type IN ('purchase','signup') THEN 'GC' ELSE 'EL' END || {_CODE.format(k='event_id')} AS request_code,
       CASE WHEN event_type IN ('purchase','signup') THEN 'gcash' ELSE 'eload' END AS service_type,
       CASE WHEN event_id % 10 = 9 THEN 'Pending' WHEN event_id % 10 = 8 THEN 'Failed' ELSE 'Completed' END AS status,
       '09' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS mobile_number,
       CAST(value AS DECIMAL(18,2)) AS amount,
       CASE WHEN event_type NOT IN ('purchase','signup') THEN '' WHEN event_id % 2 = 0 THEN 'Cash In' ELSE 'Cash Out' END AS request_kind,
       CASE WHEN event_type IN ('purchase','signup') THEN ''
            WHEN user_id % 6 = 0 THEN 'TM' WHEN user_id % 6 = 1 THEN 'GLOBE' WHEN user_id % 6 = 2 THEN 'SMART'
            WHEN user_id % 6 = 3 THEN 'TNT' WHEN user_id % 6 = 4 THEN 'SUN' ELSE 'DITO' END AS network,
       CASE WHEN event_type IN ('purchase','signup') THEN '' ELSE 'regular' END AS load_type,
       CASE WHEN event_type IN ('purchase','signup') THEN '' ELSE 'Regular ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS load_value,
       CASE WHEN event_type IN ('purchase','signup') AND event_id % 10 < 8 THEN 'REF' || CAST(event_id AS VARCHAR) ELSE '' END AS reference_no, '' AS notes,
       'Staff ' || CAST(user_id % 5 AS VARCHAR) AS requested_by_name,
       ts - INTERVAL '8614' DAY AS requested_at,
       CASE WHEN event_id % 10 < 8 THEN 'Staff ' || CAST((user_id + 1) % 5 AS VARCHAR) ELSE '' END AS completed_by_name,
       CASE WHEN event_id % 10 < 8 THEN ts - INTERVAL '8614' DAY + INTERVAL '2' HOUR END AS completed_at,
       CASE WHEN event_id % 10 = 8 THEN 'no signal' ELSE '' END AS failed_reason,
       CASE WHEN event_id % 10 = 8 THEN 'Staff ' || CAST((user_id + 2) % 5 AS VARCHAR) ELSE '' END AS failed_by_name,
       CASE WHEN event_id % 10 = 8 THEN ts - INTERVAL '8614' DAY + INTERVAL '1' HOUR END AS failed_at
FROM events""",
    "sale_digital_items": """
SELECT event_id AS sale_id, 'eload' AS service_type,
       'Regular ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS load_value,
       '09' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS mobile_number,
       1 AS quantity,
       CAST(value AS DECIMAL(18,2)) AS price,
       CAST(value AS DECIMAL(18,2)) AS total
FROM events JOIN orders ON o_orderkey = event_id
WHERE event_type NOT IN ('purchase','signup')""",
    "users": """
SELECT c_custkey AS id, 'user' || CAST(c_custkey AS VARCHAR) AS username, c_name AS full_name,
       CASE WHEN c_custkey % 10 = 0 THEN 'Admin' ELSE 'User' END AS role,
       CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AS is_active
FROM customer""",
    "user_devices": """
SELECT event_id AS id, user_id, 'Chrome on Android' AS device_name,
       CAST(event_id % 2 AS INTEGER) AS pin_enabled,
       ts AS created_at, ts AS last_used_at, ts + INTERVAL '20' DAY AS expires_at,
       lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revoked_at
FROM events WHERE event_type = 'signup'""",
    "auth_attempts": """
SELECT 'user' || CAST(user_id AS VARCHAR) AS key, ts, event_type = 'signup' AS success
FROM events WHERE event_type IN ('error','signup')""",
    "suppliers": """
SELECT s_suppkey AS supplier_id, s_name AS supplier_name, '' AS contact_no, '' AS address FROM supplier""",
    "categories": """
SELECT min(p_partkey) AS category_id, p_type AS category_name FROM part GROUP BY p_type""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named canonical views as CTEs."""
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
