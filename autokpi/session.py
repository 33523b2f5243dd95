"""Spark session helper.

Settings that matter at scale are set here once: AQE (coalesce + skew join),
UTC session time zone, ANSI left on (so every lenient cast in the library is an
explicit ``try_*``), the UI off.  Master, partitions and memory are left as
configured; a local master is chosen only where none is.
"""

from __future__ import annotations

import os

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "autokpi") -> SparkSession:
    """Return the active session or build a local one with the library defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    SparkContext._ensure_initialized()
    given = SparkConf()
    master = master or os.environ.get("AUTOKPI_MASTER") or (None if given.contains("spark.master") else "local[*]")
    parts = shuffle_partitions or os.environ.get("AUTOKPI_SHUFFLE_PARTITIONS") or (
        None if given.contains("spark.sql.shuffle.partitions") or not (master or "").startswith("local") else 8)
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master) if master else builder
    builder = builder.config("spark.sql.shuffle.partitions", str(parts)) if parts else builder
    spark = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``checkpoint()`` has a reliable folder.

    On a cluster the folder must be the shared one named by
    ``spark.checkpoint.dir``; only a local master may fall back to a folder in
    the warehouse.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir()
