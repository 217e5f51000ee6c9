"""Session settings and the shared folder used for intermediate files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_TUNING = {
    # windows leave the data hashed by station; a later join on (station, date)
    # may then reuse that layout instead of shuffling both sides again
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # the JVM never compiles a method beyond 8000 bytes of bytecode; a wide stage
    # is faster as split expressions than as one interpreted loop
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a stage of windows sorts its rows several times over: its tasks are bounded by bytes,
    # dealt finely first and put together up to this size, so that a task does not grow with the input
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "256",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the plans are designed for."""
    for key, value in _TUNING.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", app: str = "zephyria", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        # a stack trace per Column call would triple the time to build a wide plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall
    back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="zephyria-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused between runs."""
    return f"{shared_root(spark)}/zephyria/{name}-{uuid.uuid4().hex}"
