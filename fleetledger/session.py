"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "fleetledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is written for.

    Partition counts are left to the cluster: adaptive execution coalesces small
    shuffles and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    # Set before the session starts: no stack traces for every column expression.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    # Checkpoints go when nothing refers to them any more.
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Put the settings into a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder."""
    base = _checkpoint_base(spark)
    return f"{base.rstrip('/')}/fleetledger/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Store ``df`` reliably and go on from the stored rows.

    Used where several later branches must see identical rows, or where a plan
    would otherwise be evaluated once per branch.
    """
    _checkpoint_base(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """As :func:`settle`, as a table in the shared folder: its size is known, so joins with a small one broadcast it."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _checkpoint_base(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fleetledger-"))
    return context.getCheckpointDir()
