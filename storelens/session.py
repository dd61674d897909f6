"""Session construction and cluster-shared scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every storelens job relies on.  ANSI mode stays on (Spark 4
# default): overflow and bad casts raise instead of silently producing nulls.
DEFAULT_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
# local mode runs every task in the driver JVM; on a cluster spark-submit sizes driver and executors
LOCAL_CONF = {"spark.driver.memory": "8g"}


def build_session(master: str | None = None, app_name: str = "storelens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or get) a session with the defaults above.

    Without ``master`` the master is whatever spark-submit or the environment
    names.  On a cluster, size ``spark.sql.shuffle.partitions`` to roughly input bytes / 128 MB; AQE then
    coalesces small partitions and splits skewed ones at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {**DEFAULT_CONF, **(LOCAL_CONF if master and master.startswith("local") else {})}
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# a shuffle partition of this many order lines is sorted or aggregated within a task's memory
PARTITION_ROWS = 250_000
MERGED_BYTES = "16m"  # to which AQE merges smaller ones, compressed
SCAN_BYTES = "32m"    # of a table file for one task: what it groups before the shuffle stays in memory


@contextmanager
def shuffles_for(spark: SparkSession, rows: int, merged: str = MERGED_BYTES) -> Iterator[None]:
    """While tables of ``rows`` rows are written, shuffle partitions of about ``PARTITION_ROWS`` rows at most and scans
    of ``SCAN_BYTES`` at most, so that their number follows the input; AQE still merges small partitions, to ``merged``."""
    number, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    scan = "spark.sql.files.maxPartitionBytes"
    rows_of = max(int(spark.conf.get(number)), -(-rows // PARTITION_ROWS))
    with settings(spark, {number: str(rows_of), size: merged, scan: SCAN_BYTES}):
        yield


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """``conf`` in force for what is planned within."""
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def path_exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or path pattern names anything, in whatever store Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A directory on the storage every executor can see.

    The cluster names it in ``spark.checkpoint.dir``; that setting is read from
    the session.  When it is unset, a local master gets a scratch folder; any
    other master raises, as a folder of the driver's disk is out of the
    executors' reach.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if sc.master.split("[")[0] != "local":
                raise RuntimeError(f"spark.checkpoint.dir is not set: master {sc.master} needs a folder that all "
                                   "executors share")
            base = tempfile.mkdtemp(prefix="storelens-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    path = base.rstrip("/")
    for part in parts:
        path = f"{path}/{part}"
    return path


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new, unused path under the shared directory (for written tables)."""
    path = shared_dir(spark, "storelens", kind, uuid.uuid4().hex)
    if path.startswith("file:"):
        os.makedirs(path[len("file:"):].rsplit("/", 1)[0], exist_ok=True)
    return path
