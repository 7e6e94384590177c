"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Wide decode projections exceed the 8000 bytes of bytecode that the JVM compiles
    # in one method; below this limit Spark splits them instead of fusing the stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Deep offset pages sort on the executors instead of gathering offset + limit rows on the driver.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "slotframe", **extra: str) -> SparkSession:
    """A session with the settings above; the cluster's own settings stay untouched."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the setting is missing (tests on one machine) a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    made = tempfile.mkdtemp(prefix="slotframe-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is ever reused or cleared."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
