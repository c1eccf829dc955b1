"""Spark session settings and the shared checkpoint folder.

Settings are chosen for a large cluster first: the planner broadcasts a join
side whose size, estimated from its files, is under
``spark.sql.autoBroadcastJoinThreshold`` (Spark's 10 MB by default); adaptive
execution re-plans the other joins from measured shuffle sizes, coalesces
small shuffle partitions and splits skewed join partitions.
Local runs only lower the shuffle partition count.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of this library should carry.  On a cluster they are
# applied on top of whatever the cluster already sets; nothing here names a
# machine-local folder.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of iterative jobs are removed from the shared folder
    # once the DataFrames that own them are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "shopframe",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library's settings.

    ``master`` and ``shuffle_partitions`` are for local runs and tests; on a
    cluster leave them unset so the submit configuration decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint directory).  Only when neither is set and the master is local,
    as in tests, a fresh scratch folder is created and registered; on a
    cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # a folder on the driver's disk is not visible to executors
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach "
                "(the jobs checkpoint iterative state there)"
            )
        configured = _kept_until_exit(spark, tempfile.mkdtemp(prefix="shopframe-ckpt-"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_scratch_roots: dict[tuple[str, str], str] = {}


def _kept_until_exit(spark: SparkSession, path: str) -> str:
    """Create the folder and have the file system remove it, with all that
    is in it, when the application ends."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder, in a folder of
    this application that goes when it ends."""
    key = (spark.sparkContext.applicationId, checkpoint_root(spark))
    if key not in _scratch_roots:
        _scratch_roots[key] = _kept_until_exit(spark, os.path.join(key[1], f"scratch-{uuid.uuid4().hex[:12]}"))
    return os.path.join(_scratch_roots[key], f"{name}-{uuid.uuid4().hex[:12]}")


# Error classes Spark raises when a folder that a job reads does not exist
# yet, or exists without data files.
_ABSENT_ERRORS = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def is_absent_path_error(exc: Exception) -> bool:
    """True when ``exc`` says the folder read is missing or holds no data;
    any other read error (corrupt files, permissions) is not swallowed."""
    from pyspark.errors import AnalysisException

    return isinstance(exc, AnalysisException) and any(k in str(exc) for k in _ABSENT_ERRORS)
