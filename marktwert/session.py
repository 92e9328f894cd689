"""Spark session construction and cluster-shared locations.

On a cluster the session is created by the platform; ``get_session`` then
returns it as it is, so cluster configuration always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings of the local sessions that ``get_session`` builds.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Top-k per group (row_number <= k) gets a map-side partial limit.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    # Broadcast only sides whose measured size is under this bound.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_session(master: str | None = None, app_name: str = "marktwert",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("MARKTWERT_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared folder.  Only a local master, whose executors
    share the driver's disk, gets a fresh scratch folder when nothing is
    configured; any other master raises.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    active_dir = sc.getCheckpointDir()
    if not configured:
        if not active_dir and not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = active_dir or tempfile.mkdtemp(prefix="marktwert-ckpt-", dir="/tmp")
    if not active_dir:
        sc.setCheckpointDir(configured)
    return configured


def is_local(master: str) -> bool:
    """Whether executors run in the driver's process."""
    return master == "local" or master.startswith("local[")


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path for written intermediates under the shared checkpoint folder, in
    a folder of this application (two sessions never share a path)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, spark.sparkContext.applicationId, *parts])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a fresh folder of the shared directory and read
    back: plans that use it more than once read files, as does a lost executor."""
    spark = df.sparkSession
    path = shared_path(spark, "stored", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate of this application, in whatever store it is."""
    base = shared_path(spark)
    if not path.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"not an intermediate of this application: {path}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
