"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only settings that are right at any scale.  Partition counts are left to AQE:
# it starts from the cluster's own setting and coalesces or splits from there.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A hot key is split even where its partitioning is used again after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Call-site capture doubles the time it takes to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Keeps streaming state off the JVM heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app_name: str = "tallymart", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    partitions = os.environ.get("TALLYMART_SHUFFLE_PARTITIONS")
    settings = dict(DEFAULTS)
    if partitions:
        settings["spark.sql.shuffle.partitions"] = partitions
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Settings that only affect how plans run, safe in a session built elsewhere.
TUNING = ("spark.sql.session.timeZone", "spark.sql.adaptive.forceOptimizeSkewedJoin", "spark.python.sql.dataFrameDebugging.enabled")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the tuning settings to a session that was built elsewhere."""
    for key in TUNING:
        if spark.conf.isModifiable(key):
            spark.conf.set(key, DEFAULTS[key])
    return spark


# Rows of an input split or of a shuffled part are several times as large in a task's memory,
# once for each sort and grouping of its stage.  With these bounds a task's share stays the
# same while tables grow: there are more tasks.  Spark puts small parts together again.
SPLIT_BYTES = {"spark.sql.files.maxPartitionBytes": 32 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20}
SHUFFLE_PARTS = 2000  # parts before small ones are put together


def bound_tasks(spark: SparkSession) -> SparkSession:
    """Bound what one task of a plan reads; a session that has smaller splits or more parts keeps its own."""
    jvm = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    for key, most in SPLIT_BYTES.items():
        if jvm.byteStringAsBytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    own = spark.conf.get(key, None) or spark.conf.get("spark.sql.shuffle.partitions")
    if int(own) < SHUFFLE_PARTS:
        spark.conf.set(key, str(SHUFFLE_PARTS))
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one named in ``spark.checkpoint.dir``.

    On a cluster every executor has to see the same folder, so the setting is
    required there.  A local session without it (tests) gets one folder for
    its whole life, which is removed when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallymart-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written once to the scratch folder and read back.

    Cuts the lineage for work that reads a frame several times; a lost
    executor costs no recomputation.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
