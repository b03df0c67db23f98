"""SparkSession construction and lineage-cut helpers.

Cluster jobs get their settings from the submitting environment; the
builder here only fills in what is unset, so a cluster's
``spark.sql.shuffle.partitions`` or ``spark.checkpoint.dir`` always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes
# (a broadcast happens only when the measured side is under
# spark.sql.autoBroadcastJoinThreshold), coalesces small shuffle
# partitions and splits skewed join partitions.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    # lineage cuts are deleted once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.files.maxPartitionBytes": "128MB",
}


def build_session(master: str | None = None, app: str = "tillpoint",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session or create one with the engine defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a home.

    On a cluster the shared folder comes from ``spark.checkpoint.dir``.
    Only a local-mode session (tests, the bench) may fall back to a fresh
    temporary folder; a cluster without the setting is a configuration error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    base = os.environ.get("TILLPOINT_SCRATCH") or tempfile.gettempdir()
    local_dir = tempfile.mkdtemp(prefix="tillpoint-ckpt-", dir=base)
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages re-read the written copy, so a lost
    executor does not force recomputation from the source tables."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_stored(df: DataFrame, label: str) -> DataFrame:
    """Like :func:`cut_lineage`, but as Parquet: a step that needs a few of the columns
    reads those only."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tillpoint`` importable in Python workers (what ``--py-files``
    does at submit time): zip the package once per SparkContext and register
    it with ``addPyFile``. Needed only by the operators that run Python on
    executors (the exact CSV reader, the streaming lockout state)."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="tillpoint-pyfiles-")
    zip_path = os.path.join(out_dir, "tillpoint.zip")
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zip_path)
    _SHIPPED.add(key)
