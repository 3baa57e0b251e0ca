"""Session and shared-storage helpers.

Intermediate results that must outlive a task (checkpoints, round-trip files)
go under the folder the cluster names in ``spark.checkpoint.dir``; a fallback
is set only when the session has none, and only where it is safe: a local
session, or a warehouse folder on shared storage.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession


def _launched_with_master() -> bool:
    """True under ``spark-submit``/``pyspark`` (the JVM, and its master, came first),
    when a SparkContext already runs in this process, or for a Spark Connect
    session (``SPARK_REMOTE``), which takes no master."""
    return (
        SparkContext._active_spark_context is not None
        or bool(os.environ.get("PYSPARK_GATEWAY_PORT"))
        or bool(os.environ.get("SPARK_REMOTE"))
    )


def build_session(master: str | None = None, partitions: int | None = None, app: str = "marquee") -> SparkSession:
    """Session for tests, the bench and the command line.

    Under ``spark-submit`` (a master is already configured) the cluster's own
    settings are kept as they are; only when no master is set does this start
    a local session sized to ``BENCH_CPUS`` cores, with AQE, skew splitting,
    ANSI and a UTC session zone. The operators do not depend on ANSI or the
    zone (``try_cast`` everywhere; years come from zone-free timestamps).
    """
    builder = SparkSession.builder.appName(app)
    if master or not _launched_with_master():
        cpus = os.environ.get("BENCH_CPUS", "8")
        builder = (
            builder.master(master or f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(partitions or int(cpus)))
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g")
            # Splits stay at 128 MB for large files; the smaller open cost only lets
            # inputs of a few MB still spread over every core instead of one or two.
            .config("spark.sql.files.openCostInBytes", str(1024 * 1024))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.ansi.enabled", "true")
        )
    elif partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # Spark Connect: no SparkContext
        pass
    # The checkpoint folder is resolved (and checked) when a job first needs a
    # scratch table, not here: most jobs never write one.
    return spark


def _is_local_master(spark: SparkSession, sc) -> bool:
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    return str(master).startswith("local")


def _fallback_dir(spark: SparkSession, sc) -> str:
    """The warehouse's ``_checkpoints`` folder, where every task and the driver see
    the same files: always in a local session, else only on shared storage."""
    warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/")
    scheme = re.match(r"^([A-Za-z][A-Za-z0-9+.-]+):", warehouse)
    shared = scheme is not None and scheme.group(1).lower() != "file"
    if not (shared or _is_local_master(spark, sc)):
        raise RuntimeError(
            "spark.checkpoint.dir is not set and the warehouse folder is not on shared storage; "
            "set spark.checkpoint.dir to a folder every executor can read (HDFS, S3, ...)"
        )
    return warehouse + "/_checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only if none is configured."""
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session has no SparkContext: use its conf as is
        sc = None
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        configured = configured or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = _fallback_dir(spark, sc)
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for a written table."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a scratch folder through the cluster's file system, best effort.

    Returns False instead of raising (no JVM under Spark Connect, a refused or
    timed-out delete): cleanup must never turn a finished job into a failed one.
    """
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(conf).delete(p, True))
    except Exception:
        return False
