"""Session defaults, checkpoints and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "docsieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own setting, else a local one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and spark.sparkContext.getCheckpointDir():
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Whether the shuffle files of a query go when it ends. Set here only where its rows are on the shared folder by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame reliably, so that later stages never recompute it; the shuffle files behind it are deleted."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # a plan of its own: the setting is read when a plan is made, and no other query shares its shuffles
        return df.select("*").checkpoint()
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder for a table written between two stages."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
