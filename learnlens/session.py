"""Session helpers: a tuned local session for tests and the bench, and the
settings recommended on a cluster."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "learnlens") -> SparkSession:
    """Session for tests and the bench (single JVM)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Broadcast only what is measured: no estimate-based broadcast at
        # planning time; AQE may still broadcast a side whose shuffle output
        # it has measured below the bound. Explicit, row-count-checked
        # broadcast() hints (operators.joins) are unaffected.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEARNLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.parquet.inferTimestampNTZ.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_settings() -> dict[str, str]:
    """Settings we recommend on a large cluster (documented, not forced).

    Partitions are sized for ~256 MiB input splits and AQE coalesces small
    shuffle partitions after each stage, so the static partition count only
    needs to be large enough for the biggest stage. Joins are broadcast only
    on a measured size (AQE) or after an explicit row-count check, never on a
    planner estimate.
    """
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.shuffle.partitions": "8000",
    }


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own
    only where that is unset and one machine does everything."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="learnlens-")
