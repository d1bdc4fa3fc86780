"""Session helpers: a tuned local session and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and bench.py; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stream state.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets
    a temporary folder of its own; on a cluster a machine-local folder would not survive an executor.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """New unused path below the shared folder; one folder per application, free to delete after it ends."""
    app = spark.sparkContext.applicationId
    return f"{work_dir(spark).rstrip('/')}/tidemark-{app}/{name}-{uuid.uuid4().hex[:12]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and, unlike an RDD checkpoint, gives the next plan the real
    size of the data (so small sides are broadcast by the optimizer) and no inherited constraints, which
    grow exponentially in iterative joins.
    """
    path = fresh_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores before CPU-heavy work; a large scan is left alone.

    For plain scans only: counting the partitions of a plan with a shuffle would run that shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df
