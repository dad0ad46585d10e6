"""Session helpers: a local session for tests and benches, and the shared
checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "lodestar") -> SparkSession:
    """A local session as used by the tests and ``bench.py``; on a cluster use the cluster's own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("LODESTAR_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a scratch one only when none is configured
    (tests, local runs). On a cluster ``spark.checkpoint.dir`` names a shared folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="lodestar-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def data_tag(path: str) -> str:
    """A stable short name for an input folder (the same in every process, so a restarted
    stream finds its checkpoint again)."""
    import hashlib
    return hashlib.sha1(path.rstrip("/").encode("utf-8")).hexdigest()[:12]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for written intermediate tables, under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def range_partitions(df) -> int:
    """An explicit partition count for ``repartitionByRange`` in the jobs that number rows per
    partition (AQE does not coalesce a shuffle with a given count). Those jobs also checkpoint
    the rows together with their ``spark_partition_id()``: the partition a row lands in is then
    data, read alike by every branch of the plan, however AQE plans each branch."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
