"""Session factory used by tests, the bench and command-line jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task sorts; inputs of fewer than LEAST_TASKS times as many are left to Spark.
ROWS_A_TASK, LEAST_TASKS = 200_000, 8


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A UTC, adaptive local session; on a cluster the submitter's session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a single machine whose session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="gridloom-")
    return shared_dir.own


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """How many tasks to deal that many rows to, so that what one sorts doesn't grow with the input; None for few rows.

    Spark merges the partitions of a shuffle by their bytes as compressed, and millions of narrow, alike rows are few such
    bytes until a task sorts them. The number is never the session's own, with which Spark would drop the dealing where
    one of its shuffles, which it may merge, has dealt by the same keys.
    """
    wanted = -(-rows // ROWS_A_TASK)
    return max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")) + 1) if wanted >= LEAST_TASKS else None


def dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """rows by keys to that many tasks, to as many as Spark finds right without a number."""
    return rows.repartition(tasks, *keys) if tasks else rows.repartition(*keys)
