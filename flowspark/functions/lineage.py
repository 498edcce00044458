"""Cutting the lineage of iterative jobs in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def base_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="flowspark-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base_folder(df.sparkSession))
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 100_000
#: Rows that one task sorts or aggregates at a time.
ROWS_PER_TASK = 250_000


def spread(df: DataFrame, rows: int, *keys: str, rows_per_task: int | None = None) -> DataFrame:
    """Deal ``df`` out by ``keys`` over as many partitions as ``rows`` need, so that a task's memory does not grow with the table."""
    parts = -(-rows // (rows_per_task or ROWS_PER_TASK))
    return df.repartition(parts, *keys) if parts > 1 else df


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised model table for broadcast after counting it; a larger one joins by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
