"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster use the one you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tonelake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # One task per core already: merging small partitions would idle cores.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        # Arrays per unit come from many small groups: keep them hashed instead of sorted.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints.

    Without one, a local session gets a folder of its own; a cluster must
    name a shared folder, since executors can be lost.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            configured = tempfile.mkdtemp(prefix="tonelake-checkpoint-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
