"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "retentio") -> SparkSession:
    """Return a session tuned for these jobs.

    On a cluster the master and most settings come from ``spark-submit``;
    the values here only fill gaps.  AQE stays on so shuffle partitions are
    coalesced/split at runtime and skewed joins are split.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", "12g")
    cores = os.cpu_count() or 8
    parts = shuffle_partitions or max(8, cores)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # the driver's status store keeps job/stage/SQL history even with the
        # UI off; long sessions (tuning, many reports) should not accumulate it
        .config("spark.sql.ui.retainedExecutions", "50")
        .config("spark.ui.retainedJobs", "200")
        .config("spark.ui.retainedStages", "200")
        .config("spark.ui.retainedTasks", "10000")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set one only when unset.

    On a cluster this names a shared (HDFS/S3) folder.  Only in local runs
    and tests, where nothing is configured, a scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder "
                               "(HDFS/S3/...) when running on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="retentio-ckpt-")  # local runs and tests only
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def cut_lineage(df: DataFrame, name: str | None = None) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder.

    Used where a frame is read several times (the customer mart inside a
    query, the training frame of a cross validation): it is computed once,
    and a lost executor re-reads the written files instead of recomputing
    the lineage.  A written table is preferred over ``DataFrame.checkpoint``:
    it is computed once (an RDD checkpoint recomputes its input unless
    cached), stored columnar, read back with column pruning and filter
    pushdown, and gives Catalyst real size statistics.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"materialized/{name or uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scale_conf(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 << 20,
               min_partitions: int = 200) -> dict[str, str]:
    """Shuffle/file partition sizes for an input of ``input_bytes``.

    Only keys the cluster has not set are changed.  Shuffle partitions start
    at input / target (AQE coalesces small ones and splits skewed ones at
    runtime), files are split at the same target size.
    """
    parts = max(min_partitions, -(-input_bytes // target_partition_bytes))
    wanted = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    applied = {}
    for k, v in wanted.items():
        if spark.sparkContext.getConf().get(k, None) is None:
            spark.conf.set(k, v)
            applied[k] = v
    return applied
