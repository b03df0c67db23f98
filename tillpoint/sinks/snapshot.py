"""SK3: dated snapshot of every canonical table with a manifest, and a
verify job that recomputes the manifest from the written files.

The reference offers the raw database file for download and has an unused
helper that adds app, version, date, schema version and a per-file hash.
Here each table is written as Parquet; its manifest entry is the row
count and an order-free checksum (the sum of ``xxhash64`` over all columns,
and of a second hash; sums, so that pairs of equal rows do not cancel out),
computed by one aggregation over the *written* files, so the
manifest vouches for what is on storage.

Dated snapshots (``dated_snapshot``) go to a folder of their own that is never written
again, with a SHA-256 of every file; ``restore`` checks the files first, refuses a
damaged, missing or foreign one by name, and publishes all tables as one new version.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# -- fixed values: snapshot metadata ------------------------------------------
APP = "tillpoint"
SCHEMA_VERSION = 1
SNAPSHOT_TABLES = ("inventory_items", "sales", "sale_items", "sale_digital_items",
                   "digital_service_requests", "suppliers", "categories", "users", "user_devices")


def table_checksum(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and ``checksum`` (order-free)."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.concat_ws("-", *[F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
                                     for h in (F.xxhash64(*df.columns), F.xxhash64(*df.columns, F.lit("second")))]).alias("checksum"))


def write_snapshot(t, folder: str, as_of: str) -> DataFrame:
    """Write every table under ``folder`` and the manifest next to them;
    returns the manifest as a DataFrame (table, rows, checksum)."""
    from tillpoint.sources.store import CanonicalTables, write_canonical

    spark: SparkSession = t.spark
    write_canonical(t, folder, SNAPSHOT_TABLES)
    stored = CanonicalTables(spark, folder)
    parts = [table_checksum(getattr(stored, name)).select(F.lit(name).alias("table"), "rows", "checksum")
             for name in SNAPSHOT_TABLES]
    manifest = parts[0]
    for p in parts[1:]:
        manifest = manifest.unionByName(p)
    manifest = manifest.coalesce(1)
    manifest.write.mode("overwrite").json(f"{folder}/_manifest")
    meta = {"app": APP, "schema_version": SCHEMA_VERSION, "as_of": as_of,
            "written_at": _dt.datetime.now(_dt.timezone.utc).isoformat(), "tables": list(SNAPSHOT_TABLES)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_meta")
    return spark.read.json(f"{folder}/_manifest")


def verify_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Recompute each table's entry from its files: ``table, rows, checksum,
    ok`` (ok = matches the stored manifest)."""
    stored = spark.read.json(f"{folder}/_manifest")
    names = SNAPSHOT_TABLES
    from tillpoint.sources.store import CanonicalTables

    stored_tables = CanonicalTables(spark, folder)
    parts = [table_checksum(getattr(stored_tables, n)).select(F.lit(n).alias("table"),
                                                                         F.col("rows").alias("rows_now"),
                                                                         F.col("checksum").alias("checksum_now"))
             for n in names]
    now = parts[0]
    for p in parts[1:]:
        now = now.unionByName(p)
    return (stored.join(now, "table", "full")
            .withColumn("ok", (F.col("rows") == F.col("rows_now")) & (F.col("checksum") == F.col("checksum_now"))))


# -- dated snapshots with hashes of files -----------------------------------------
#: Rows of one file, so that a file stays far below the 2 GB that a row of
#: ``binaryFile`` may hold.
FILE_ROWS = 2_000_000


class DamagedSnapshot(Exception):
    """Files of a snapshot differ from its manifest."""


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(table, file, bytes, sha256) of every data file under ``folder``, read and hashed
    on the executors. ``file`` is the path below the folder."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
             .load(folder))
    below = F.substring_index("path", f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    return files.select(F.substring_index(below, "/", 1).alias("table"), below.alias("file"), F.col("length").alias("bytes"),
                        F.sha2("content", 256).alias("sha256"))


def dated_snapshot(t, root: str, as_of: str, names=SNAPSHOT_TABLES) -> str:
    """Write the tables to a new folder ``<root>/<as_of>/<id>`` with ``_files``, the
    files' hashes, and ``_meta``; returns the folder. Nothing is overwritten. The file
    list is written last: a folder without it is no snapshot."""
    import uuid

    from tillpoint.sources.store import write_canonical

    spark: SparkSession = t.spark
    folder = f"{root.rstrip('/')}/{as_of}/{uuid.uuid4().hex}"
    write_canonical(t, folder, names, mode="errorifexists", max_rows=FILE_ROWS)
    meta = {"app": APP, "schema_version": SCHEMA_VERSION, "as_of": as_of,
            "written_at": _dt.datetime.now(_dt.timezone.utc).isoformat(), "tables": list(names)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{folder}/_meta")
    file_hashes(spark, folder).write.json(f"{folder}/_files")
    return folder


def verify_files(spark: SparkSession, folder: str) -> DataFrame:
    """(table, file, state) of every file that is listed or there: ``ok``, ``damaged``,
    ``missing`` or ``foreign`` (not listed)."""
    listed = spark.read.schema("table string, file string, bytes long, sha256 string").json(f"{folder}/_files")
    now = file_hashes(spark, folder).select("table", "file", F.col("sha256").alias("now"))
    return listed.join(now, ["table", "file"], "full").select("table", "file", F.when(F.col("now").isNull(), "missing")
                                                               .when(F.col("sha256").isNull(), "foreign")
                                                               .when(F.col("now") != F.col("sha256"), "damaged").otherwise("ok").alias("state"))


def restore(spark: SparkSession, folder: str, store, named: int = 20) -> int:
    """Publish a dated snapshot's tables as the next version of ``store`` (a
    :class:`~tillpoint.sinks.versions.VersionedTables`) and return its number. Raises
    DamagedSnapshot, naming up to ``named`` files, and changes nothing, if any file
    is not what the manifest says. Tables that the snapshot lacks stay."""
    from tillpoint.sources.store import CanonicalTables

    wrong = verify_files(spark, folder).where("state != 'ok'").orderBy("file")
    found = wrong.limit(named + 1).collect()
    if found:
        more = " and more" if len(found) > named else ""
        raise DamagedSnapshot(", ".join(f"{r['file']} ({r['state']})" for r in found[:named]) + more)
    meta = json.loads(spark.read.text(f"{folder}/_meta").first()["value"])
    stored = CanonicalTables(spark, folder)
    return store.commit(store.current(), {n: getattr(stored, n) for n in meta["tables"]}, f"restore {meta['as_of']}")
