"""Session settings the operators are tuned for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Shuffled hash joins are picked at run time only where every partition is small
# enough to hash; everything else stays a spilling sort-merge join.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(name: str, cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": os.environ.get("ATOMFRAME_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.local.dir": scratch,
        "spark.checkpoint.dir": os.path.join(scratch, "checkpoints"),
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
