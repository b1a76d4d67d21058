"""A session with the settings that the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """ANSI mode, UTC, adaptive plans with skew joins, and the state store that stateful streaming needs."""
    conf = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | more
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    builder = SparkSession.builder.config(map=conf)
    return (builder.master(master) if master else builder).getOrCreate()


_OWN: dict[str, str] = {}


def shared_place(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share, spark.checkpoint.dir; a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = _OWN.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="tapeloom-"))
    path = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
