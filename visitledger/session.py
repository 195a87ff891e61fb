"""Session settings the engine expects, and the shared folder for tables written between stages."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shuffles start with many partitions and are merged up to the advisory size, so a task's share does not grow with the input.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.python.filterPushdown.enabled": "true",
    # A job's shuffle files go when it ends, not when the driver happens to collect its garbage: a sync runs many jobs in turn.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # The JVM compiles no method above 8000 bytes of code; beyond that Spark shall generate split functions instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`.

    Only a local session without that setting (tests) gets a folder of its own; on a cluster such a folder would be on one
    machine's disk, so there a session without the setting is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder made by `shared_dir` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="visitledger-")
