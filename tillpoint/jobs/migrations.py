"""DM9 on stored tables: a declared list of migrations and a stored schema version.

Every step names one table and the columns that it adds, with the value they take
where they are missing. ``migrate`` runs the steps after the store's schema version,
table by table, and publishes the changed tables together with the new number as one
commit: a reader sees all of it or nothing. A table that has the columns is not
rewritten, and a second run commits nothing. Columns that the schema does not know
stay, after the others; a missing key column is refused, it has no default.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.normalize import derive_legacy_status, js_trim, text_or_empty
from tillpoint.jobs.imports import barcode_backfill
from tillpoint.sinks.versions import CommitConflict, VersionedTables
from tillpoint.sources.schemas import SCHEMAS


class Migration(NamedTuple):
    number: int
    table: str
    columns: dict  # column -> its value as SQL, or None for a rule of its own


# -- fixed values: the columns that older tables lack and their defaults -------
MIGRATIONS = (
    Migration(1, "users", {"role": "'Admin'", "is_active": "1"}),
    Migration(2, "inventory_items", {"supplier": "''", "stock_quantity": "0", "unit_price": "0", "selling_price": "0",
                                     "reorder_level": "10", "status": None}),
    Migration(3, "inventory_items", {"barcode": None}),
    Migration(4, "digital_service_requests", {"failed_reason": "''", "failed_by_name": "''", "failed_at": "NULL"}),
    Migration(5, "digital_service_requests", {
        "status": "'Pending'", "mobile_number": "''", "amount": "0", "request_kind": "''", "network": "''", "load_type": "''",
        "load_value": "''", "reference_no": "''", "notes": "''", "requested_by_name": "''", "completed_by_name": "''", "completed_at": "NULL"}),
    Migration(6, "sales", {"employee_name": "'System'", "total_amount": "0"}),
    Migration(7, "sale_digital_items", {
        "service_type": "'eload'", "request_code": "''", "mobile_number": "''", "network": "''", "load_type": "''", "load_value": "''",
        "notes": "''", "quantity": "1", "price": "0", "total": "0"}),
    Migration(8, "suppliers", {"contact_no": "''", "address": "''"}),
    Migration(9, "user_devices", {"pin_enabled": "0", "last_used_at": "NULL", "revoked_at": "NULL"}),
)
LATEST = MIGRATIONS[-1].number


def _barcodes(df: DataFrame) -> DataFrame:
    """WN3 where a barcode is missing, blank or repeated; else the table as it is."""
    coded = df if "barcode" in df.columns else df.withColumn("barcode", F.lit(None).cast("string"))
    code = js_trim(text_or_empty(F.col("barcode")))
    if coded.groupBy(code.alias("c")).count().where("count > 1 OR c = ''").isEmpty():
        return df
    codes = barcode_backfill(coded.select("id", "barcode")).select(F.col("id").alias("_id"), F.col("barcode").alias("_bc"))
    return (coded.join(codes, F.col("id") == F.col("_id"), "left").withColumn("barcode", F.coalesce("_bc", code))
            .drop("_id", "_bc"))


def apply(step: Migration, df: DataFrame) -> DataFrame:
    """``df`` after the step; the same object where there is nothing to do."""
    schema = SCHEMAS[step.table]
    if "barcode" in step.columns:
        out = _barcodes(df)
    else:
        out = df
        for name in [c for c in step.columns if c not in df.columns]:
            rule = step.columns[name]
            value = F.expr(rule) if rule is not None else derive_legacy_status(F.col("stock_quantity"), F.col("reorder_level"))
            out = out.withColumn(name, value.cast(schema[name].dataType))
    if out is df:
        return df
    known = [f for f in schema.fields if f.name in out.columns]
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known],
                      *[c for c in out.columns if c not in schema.fieldNames()])


def migrate(store: VersionedTables, tries: int = 3) -> tuple[int, list[int]]:
    """Bring the current version up to the newest schema. Returns the version that has
    it and the numbers of the steps that changed a table."""
    for left in range(tries, 0, -1):
        view = store.at()
        done = view.manifest.get("schema_version", 0)
        if done >= LATEST:
            return view.version, []
        changed, ran = {}, []
        for step in MIGRATIONS:
            if step.number <= done or step.table not in view.manifest["tables"]:
                continue
            before = changed.get(step.table, getattr(view, step.table))
            after = apply(step, before)
            if after is not before:
                changed[step.table] = after
                ran.append(step.number)
        for name in view.manifest["tables"]:
            have = changed.get(name, getattr(view, name)).columns
            lacking = [c for c in SCHEMAS[name].fieldNames() if c not in have] if name in SCHEMAS else []
            if lacking:
                raise ValueError(f"{name} lacks {', '.join(lacking)}, for which there is no default")
        try:
            return store.commit(view.version, changed, "migrate", schema_version=LATEST), ran
        except CommitConflict:  # another job committed first: look again
            if left == 1:
                raise
    raise ValueError("tries must be positive")
