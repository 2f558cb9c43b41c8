"""Session helpers shared by tests, the bench and the driver entry point."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "logloom") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LOGLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workers_can_import(spark: SparkSession) -> None:
    """Puts this repository on the Python path of the workers, and bounds their Arrow batches."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    # rows are texts: smaller Arrow batches bound what a worker and its JVM hold, unless the session says otherwise
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder named by spark.checkpoint.dir.

    A local master may do without that setting and gets a temporary folder; a cluster may not, because its
    executors must share the folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="logloom-checkpoint-"))
    return df.checkpoint(eager)
