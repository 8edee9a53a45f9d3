"""Session defaults. On a cluster take the cluster's session; these are for a single node."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int | None = None, name: str = "claimloom") -> SparkSession:
    n = partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    conf = {
        "spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; only where that is unset and all runs on this machine a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="claimloom-checkpoint-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/claimloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: no plan downstream recomputes it, no executor's loss loses it, and it goes once nothing uses it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
