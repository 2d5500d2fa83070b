"""Session factory and the one place that decides where scratch tables live."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join may sit right below an aggregation on the same key; split it anyway.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Texts can be long: a Python worker holds a whole batch, as Arrow, as Python texts and as numbers.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # Generated methods above this many bytes are never compiled by the JVM; run such stages
    # operator by operator instead, where each projection is small enough to be compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}


def build(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Create a session; leave master and sizing to spark-submit unless given."""
    builder = SparkSession.builder.appName("marketloom")
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def pin(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings results rely on to a session somebody else built."""
    for key, value in SETTINGS.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, for the few Python functions they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="marketloom-package-")) / "marketloom"
    context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates and stream checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session that
    leaves it unset gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="marketloom-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local
