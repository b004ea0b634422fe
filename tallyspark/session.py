"""Session construction and the shared folder used for checkpoints and table versions."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on: UTC for the date/time rules, ANSI on
# (Spark 4 default), AQE for runtime coalescing and skew splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # MIN/MAX/COUNT over a plain parquet scan read from file footers.
    "spark.sql.parquet.aggregatePushdown": "true",
    # Reliable checkpoints are deleted once their DataFrame is unreachable, so
    # a long-running session does not fill the shared folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "tallyspark",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is used as is.  Only a local
    session without one (tests) gets a private folder; on a cluster its executors
    would each write to their own disk, so there an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no SparkContext, the server owns the setting
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return _parent_of_checkpoint(current)
        configured = configured or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if sc is not None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
        if _settable(spark):
            spark.conf.set("spark.checkpoint.dir", configured)
    if sc is not None:
        sc.setCheckpointDir(configured)
    return configured


def _settable(spark: SparkSession) -> bool:
    try:
        return spark.conf.isModifiable("spark.checkpoint.dir")
    except Exception:
        return False


def _parent_of_checkpoint(path: str) -> str:
    # SparkContext appends a random subfolder to the configured folder.
    return path.rstrip("/").rsplit("/", 1)[0]


def shared_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path in the shared folder, e.g. for table versions or landed pages."""
    root = ensure_checkpoint_dir(spark)
    tail = list(parts) + ([uuid.uuid4().hex] if unique else [])
    return os.path.join(root, "tallyspark", *tail) if "://" not in root else "/".join([root.rstrip("/"), "tallyspark", *tail])
