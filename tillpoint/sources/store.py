"""The shop's own canonical tables on storage (as written by SK3 or by the
shop's loaders), read with explicit schemas.

``CanonicalTables`` has the same attributes as ``Tables`` (``sales``,
``inventory_items``, ...), so every operator runs on either. ``sales`` is
stored in monthly folders (``sale_month``) with rows sorted by
``sale_date``: ``sales_in_months`` turns a date range into a partition
filter, and inside a month the pushed ``sale_date`` filter skips row groups
by their min/max statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillpoint.sources.schemas import PARTITIONS, SCHEMAS


class CanonicalTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.data_dir = folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        if name not in self._cache:
            schema = SCHEMAS[name]
            df = self.spark.read.schema(schema).parquet(f"{self.data_dir}/{name}")
            self._cache[name] = df.select(*schema.fieldNames())
        return self._cache[name]

    def sales_in_months(self, first_day: str, last_day: str) -> DataFrame:
        """``sales`` limited to the months overlapping a date range (a
        partition filter on the folder column), for callers that know it."""
        from pyspark.sql import functions as F
        df = self.spark.read.schema(SCHEMAS["sales"]).parquet(f"{self.data_dir}/sales")
        months = F.col("sale_month").between(first_day[:7], last_day[:7])
        return df.filter(months).select(*SCHEMAS["sales"].fieldNames())

    def raw(self, name: str) -> DataFrame:
        raise KeyError(f"{name!r} is a driver table; canonical storage holds only the shop tables")

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self._read(name)
        raise AttributeError(name)


def write_table(df: DataFrame, name: str, path: str, mode: str = "errorifexists", max_rows: int = 0) -> None:
    """Write one table in the engine's layout; ``max_rows`` bounds a file's rows."""
    from pyspark.sql import functions as F

    if name in PARTITIONS:
        column, expr, order = PARTITIONS[name]
        # range-partition on the sort order: each task writes a slice of
        # days, and a month or day holding a third of the rows is still
        # split over many tasks; rows are sorted inside each file
        df = (df.withColumn(column, F.expr(expr)).repartitionByRange(*order)
              .sortWithinPartitions(*order))
    writer = df.write.mode(mode).option("maxRecordsPerFile", max_rows)
    if name in PARTITIONS:
        writer = writer.partitionBy(column)
    writer.parquet(path)


def write_canonical(tables, folder: str, names=None, mode: str = "overwrite", max_rows: int = 0) -> None:
    """Write canonical tables under ``folder`` with the engine's layout."""
    for name in names or SCHEMAS:
        write_table(getattr(tables, name).select(*SCHEMAS[name].fieldNames()), name, f"{folder}/{name}", mode, max_rows)
