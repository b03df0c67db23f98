"""Canonical table schemas (FIXTURES §2), for reading the shop's own tables
without inference. Money is DECIMAL(18,2); times are TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

from pyspark.sql import types as T

_M = T.DecimalType(18, 2)
_TS = T.TimestampNTZType()


def _s(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS = {
    "inventory_items": _s(("id", T.LongType()), ("barcode", T.StringType()), ("name", T.StringType()),
                          ("category", T.StringType()), ("supplier", T.StringType()), ("status", T.StringType()),
                          ("stock_quantity", T.IntegerType()), ("unit_price", _M), ("selling_price", _M),
                          ("reorder_level", T.IntegerType())),
    "sales": _s(("id", T.LongType()), ("transaction_code", T.StringType()), ("sale_date", T.DateType()),
                ("payment_method", T.StringType()), ("employee_name", T.StringType()), ("total_amount", _M),
                ("created_at", _TS)),
    "sale_items": _s(("sale_id", T.LongType()), ("inventory_item_id", T.LongType()), ("item_name", T.StringType()),
                     ("line_no", T.IntegerType()), ("quantity", T.IntegerType()), ("price", _M), ("total", _M)),
    "sale_digital_items": _s(("sale_id", T.LongType()), ("service_type", T.StringType()),
                             ("request_code", T.StringType()), ("mobile_number", T.StringType()),
                             ("network", T.StringType()), ("load_type", T.StringType()),
                             ("load_value", T.StringType()), ("notes", T.StringType()),
                             ("quantity", T.IntegerType()), ("price", _M), ("total", _M)),
    "digital_service_requests": _s(
        ("id", T.LongType()), ("request_code", T.StringType()), ("service_type", T.StringType()),
        ("status", T.StringType()), ("mobile_number", T.StringType()), ("amount", _M),
        ("request_kind", T.StringType()), ("network", T.StringType()), ("load_type", T.StringType()),
        ("load_value", T.StringType()), ("reference_no", T.StringType()), ("notes", T.StringType()),
        ("requested_by_name", T.StringType()),
        ("requested_at", _TS), ("completed_by_name", T.StringType()), ("completed_at", _TS),
        ("failed_reason", T.StringType()), ("failed_by_name", T.StringType()), ("failed_at", _TS)),
    "suppliers": _s(("supplier_id", T.LongType()), ("supplier_name", T.StringType()),
                    ("contact_no", T.StringType()), ("address", T.StringType())),
    "categories": _s(("category_id", T.LongType()), ("category_name", T.StringType())),
    "users": _s(("id", T.LongType()), ("username", T.StringType()), ("full_name", T.StringType()),
                ("role", T.StringType()), ("is_active", T.IntegerType())),
    "user_devices": _s(("id", T.LongType()), ("user_id", T.LongType()), ("device_name", T.StringType()),
                       ("pin_enabled", T.IntegerType()), ("created_at", _TS), ("last_used_at", _TS),
                       ("expires_at", _TS), ("revoked_at", _TS)),
    "auth_attempts": _s(("key", T.StringType()), ("ts", _TS), ("success", T.BooleanType())),
}

# how the engine lays out tables it writes: a derived partition column per
# table (monthly folders) and the sort order inside the files (so Parquet
# min/max statistics skip row groups for day ranges inside a month)
PARTITIONS = {"sales": ("sale_month", "date_format(sale_date, 'yyyy-MM')", ["sale_date", "id"])}
