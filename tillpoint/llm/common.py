"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.session import ensure_checkpoint_dir, ship_package

#: Words are maximal runs of characters other than these (ASCII white space);
#: ``bytes.split()`` without arguments cuts at exactly the same six bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder for lineage cuts, package on the Python workers, and Arrow
    batches for long texts: Spark's default of 10,000 rows is made for short ones
    (another setting of the session's stays)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")


def cut(df: DataFrame) -> DataFrame:
    """Written copy in the shared checkpoint folder: later stages re-read it, so a
    lost executor costs one task, and a step with two readers runs once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Like :func:`cut`, but as compressed Parquet (column pruning, small files)."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names."""
    return ensure_checkpoint_dir(spark)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id is fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(0))


def row_hash(doc_id: Column, seed: int) -> Column:
    """Deterministic order for samples and permutations."""
    return F.xxhash64(doc_id, F.lit(seed))


def bounded_sample(rows: DataFrame, key: str, limits: dict, seed: int) -> DataFrame:
    """(doc_id, key): for each key of ``limits`` (a short list) the rows with the least
    hashes, at most the key's limit. Rows that cannot be among them (by four times the
    expected hash) go before the shuffle, so a frequent key is no large group."""
    rows = rows.where(F.col(key).isin(list(limits))).select("doc_id", key)
    sizes = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
    if not sizes:
        return rows
    by_key = lambda f: F.coalesce(*[F.when(F.col(key) == k, F.lit(f(k))) for k in sizes])
    share = (row_hash(F.col("doc_id"), seed).cast("double") + 2.0**63) / 2.0**64
    near = rows.withColumn("_h", share).where(F.col("_h") < by_key(lambda k: (4.0 * limits[k] + 20) / sizes[k]))
    order = Window.partitionBy(key).orderBy("_h", "doc_id")
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= by_key(lambda k: limits[k])).select("doc_id", key)


def slices(batches, column: str = "text", max_bytes: int = SLICE_BYTES):
    """Cut Arrow batches into runs of rows with about ``max_bytes`` of text, so a
    task's memory does not depend on the batch size; one longer text is a run."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        block = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // max_bytes
        edges = np.flatnonzero(np.diff(block)) + 1
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def byte_buffer(words: list[bytes]) -> np.ndarray:
    """The words in one uint8 array, with a space before, between and after."""
    return np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
