"""SC1: table scan over the driver's parquet folder.

A ``Tables`` object is a lazily-populated handle on one data folder. It
never reads data itself: every method returns a DataFrame whose scan
Catalyst prunes to the referenced columns and into which it pushes filters.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


class Tables:
    """Raw driver tables plus the canonical shop views built on them."""

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark = spark
        self.data_dir = data_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in RAW_TABLES:
            raise KeyError(f"unknown table {name!r}")
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.data_dir}/{name}.parquet")
        return self._raw[name]

    # canonical views (SC1 over the adapters); imported lazily to avoid a cycle
    @cached_property
    def sales(self) -> DataFrame:
        from tillpoint.sources import canonical
        return canonical.sales(self)

    @cached_property
    def inventory_items(self) -> DataFrame:
        from tillpoint.sources import canonical
        return canonical.inventory_items(self)

    @cached_property
    def sale_items(self) -> DataFrame:
        from tillpoint.sources import canonical
        return canonical.sale_items(self)

    @cached_property
    def sale_digital_items(self) -> DataFrame:
        from tillpoint.sources import canonical
        return canonical.sale_digital_items(self)

    @cached_property
    def digital_service_requests(self) -> DataFrame:
        from tillpoint.sources import canonical
        return canonical.digital_service_requests(self)

    @cached_property
    def users(self) -> DataFrame:
        from tillpoint.sources import canonical
        return canonical.users(self)

    @cached_property
    def user_devices(self) -> DataFrame:
        from tillpoint.sources import canonical
        return canonical.user_devices(self)

    @cached_property
    def auth_attempts(self) -> DataFrame:
        from tillpoint.sources import canonical
        return canonical.auth_attempts(self)

    @cached_property
    def suppliers(self) -> DataFrame:
        from tillpoint.sources import canonical
        return canonical.suppliers(self)

    @cached_property
    def categories(self) -> DataFrame:
        from tillpoint.sources import canonical
        return canonical.categories(self)


def load(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """SC1: one canonical table (or a raw table) by name."""
    tables = Tables(spark, data_dir)
    if name in RAW_TABLES:
        return tables.raw(name)
    return getattr(tables, name)
