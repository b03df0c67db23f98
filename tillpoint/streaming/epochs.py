"""Keyed state of a ``foreachBatch`` stream on storage, with a bounded number of folders.

Each micro-batch writes its changed rows to a folder of its own epoch; a batch replayed
after a failure rewrites that folder. Every ``every`` epochs the rows before the current
one are merged into a base, so that a reader opens the base and a short tail:

    <root>/base/upto=<k>/     the latest row of every key of the epochs up to k
    <root>/tail/epoch=<n>/    the rows that batch n changed

Only the last batch can be replayed, and a base never holds it. A base counts once its
``_SUCCESS`` file is there; the base before it stays for readers that opened it, with
the epochs since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.sinks.versions import Files


class EpochTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], every: int = 20):
        self.spark, self.root, self.schema, self.keys, self.every = spark, root.rstrip("/"), schema, keys, every
        self._files = Files(spark, self.root)

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._files.names(f"{self.root}/{folder}") if n.startswith(f"{prefix}="))

    def _bases(self) -> list[int]:
        return [k for k in self._numbers("base", "upto") if "_SUCCESS" in self._files.names(f"{self.root}/base/upto={k}")]

    def folders(self, before: int | None = None) -> list[str]:
        """What a reader opens for the state before an epoch (now, if None)."""
        fits = lambda n: before is None or n < before
        base = max((k for k in self._bases() if fits(k)), default=None)
        tail = [n for n in self._numbers("tail", "epoch") if fits(n) and (base is None or n > base)]
        return [f"{self.root}/base/upto={base}"] * (base is not None) + [f"{self.root}/tail/epoch={n}" for n in tail]

    def read(self, before: int | None = None) -> DataFrame:
        """The latest row of every key, with the epoch that changed it last."""
        paths = self.folders(before)
        full = f"{self.schema}, epoch long"
        rows = self.spark.read.schema(full).parquet(*paths) if paths else self.spark.createDataFrame([], full)
        values = [c for c in rows.columns if c not in (*self.keys, "epoch")]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "epoch").alias("v"), F.max("epoch").alias("epoch"))
        return latest.select(*self.keys, "v.*", "epoch")

    def write(self, rows: DataFrame, epoch: int) -> None:
        """Store what batch ``epoch`` changed, after merging older epochs when due."""
        base = max(self._bases(), default=-1)
        if epoch - 1 - base > self.every:
            self.compact(epoch - 1)
        rows.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{self.root}/tail/epoch={epoch}")

    def compact(self, upto: int) -> None:
        older = self._bases()
        self.read(upto + 1).write.mode("overwrite").parquet(f"{self.root}/base/upto={upto}")
        kept = max(older, default=-1)  # readers of this base need it and the epochs after it
        for k in older:
            if k < kept:
                self._files.delete(f"{self.root}/base/upto={k}")
        for n in self._numbers("tail", "epoch"):
            if n <= kept:
                self._files.delete(f"{self.root}/tail/epoch={n}")
