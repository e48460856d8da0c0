"""Spark session defaults shared by tests, bench and jobs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_spark(master: str | None = None, app: str = "tidemark", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from the submit
    configuration (add ``cluster_conf(...)`` as ``extra``); locally the master defaults to
    ``local[*]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    elif "PYSPARK_GATEWAY_PORT" not in os.environ:
        # standalone Python process: run locally. Under spark-submit the gateway already exists and
        # the cluster's master (and the rest of the submit configuration) is kept as given.
        builder = builder.master("local[*]")
    conf = dict(_DEFAULTS)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.session.timeZone",):
        spark.conf.set(k, conf[k])
    checkpoint_dir(spark)
    return spark


def cluster_conf(executors: int, cores_per_executor: int, executor_memory_gb: int = 16) -> dict[str, str]:
    """Recommended settings for a large cluster (e.g. 1000 executors reading ~100 TB).

    Shuffle partitions start at ~3 per core and AQE coalesces them to the advisory size, so the
    event-grain shuffles (already reduced by partial aggregation) neither spill nor create tiny
    tasks; input splits stay at 256 MB; skewed partitions above 5× the median and 1 GB are split.
    Pass the result as ``extra`` to ``get_spark`` or to spark-submit ``--conf``.
    """
    cores = executors * cores_per_executor
    return {
        "spark.sql.shuffle.partitions": str(max(200, 3 * cores)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * 1024 * 1024),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.executor.memory": f"{executor_memory_gb}g",
        "spark.executor.cores": str(cores_per_executor),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` as the cluster names it. Only when it is unset and the master
    is local (tests) a private scratch folder is created and registered, removed at exit; a cluster
    without the setting is an error, because executors do not share the driver's folders.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written intermediate table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialized(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: later actions see one fixed result."""
    path = scratch_path(df.sparkSession, f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
