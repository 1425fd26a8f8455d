"""Session settings the library counts on, and a session for tests and benchmarks."""

from __future__ import annotations

import functools
import os
import tempfile

from pyspark.sql import SparkSession

# Settings that may be changed on a running session. Skewed join partitions are split at
# run time even where that costs one more shuffle: one account may own a third of the rows.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # wall-clock times in files are read as instants of the session zone, UTC, without a cast that
    # would keep filters on them from the scan
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above. Shuffle width and file split size stay as the cluster set them."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(
    cpus: int | str = 8, shuffle_partitions: int = 8, extra: dict[str, str] | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("caseflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CASEFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in (extra or {}).items():
        builder = builder.config(name, value)
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _temporary_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"caseflow-{application}-")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of this machine is used only by a local session that names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    return _temporary_folder(spark.sparkContext.applicationId)
