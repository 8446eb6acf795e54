"""Session helpers.

The library never creates a global session; every operator takes DataFrames.
``get_spark`` exists for tests, the bench and the driver entry points.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "shardwright") -> SparkSession:
    cores = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cores}]"
    parts = shuffle_partitions or int(os.environ.get("SHARDWRIGHT_SHUFFLE_PARTITIONS", cores))
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SHARDWRIGHT_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written tables.

    ``spark.checkpoint.dir`` names a folder that driver and executors reach; it is
    read from the session and used as is. Only a local master, where one machine is
    all there is, gets a scratch folder when it is unset; a cluster without it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="shardwright-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if path.removeprefix("file://").rstrip("/") not in (spark.sparkContext.getCheckpointDir() or ""):
        spark.sparkContext.setCheckpointDir(path)                 # once: Spark adds a folder of its own
    return path


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    The frame is persisted first, so the checkpoint write reads the cached
    partitions instead of computing the plan a second time. Used where a plan
    would otherwise grow with every iteration."""
    checkpoint_dir(df.sparkSession)
    cached = df.persist()
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
