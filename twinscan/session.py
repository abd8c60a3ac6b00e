"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "twinscan", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with UTC time, adaptive execution and Arrow transfer.

    Sizes (partitions, memory) are the cluster's business; pass them only for local runs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Call sites of column expressions are only for error messages and make plans slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Shared folder named by the cluster for cutting lineage; `fallback` only where none is set."""
    return spark.conf.get("spark.checkpoint.dir", None) or fallback
