"""DM9: bring an older table up to the canonical schema.

A column that is missing gets the reference's default (``supplier`` and
``failed_*`` texts ``''``, ``employee_name`` ``'System'``); a missing
``status`` is derived from stock and reorder level (FN2); a missing or
repeated barcode goes through the WN3 backfill. Existing columns are cast
to the canonical types, and columns that the canonical schema does not know
stay as they are, after the others. Column checks read the schema only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.normalize import derive_legacy_status
from tillpoint.jobs.imports import barcode_backfill
from tillpoint.sources.schemas import SCHEMAS

# -- fixed values: defaults of columns added by the reference's migrations ----
DEFAULTS = {
    "inventory_items": {"supplier": "", "status": None, "barcode": None},
    "sales": {"employee_name": "System"},
    "digital_service_requests": {"failed_reason": "", "failed_by_name": "", "failed_at": None},
}


def backfill_schema(df: DataFrame, table: str) -> DataFrame:
    schema = SCHEMAS[table]
    out = df
    for name, default in DEFAULTS.get(table, {}).items():
        if name in out.columns:
            continue
        if table == "inventory_items" and name == "status":
            out = out.withColumn("status", derive_legacy_status(F.col("stock_quantity"), F.col("reorder_level")))
        else:
            out = out.withColumn(name, F.lit(default).cast(schema[name].dataType) if default is not None
                                 else F.lit(None).cast(schema[name].dataType))
    if table == "inventory_items":
        codes = barcode_backfill(out.select("id", "barcode")).select("id", F.col("barcode").alias("_bc"))
        out = out.join(codes, "id", "left").withColumn("barcode", F.col("_bc")).drop("_bc")
    present = [f for f in schema.fields if f.name in out.columns]
    others = [c for c in out.columns if c not in schema.fieldNames()]
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in present], *others)
