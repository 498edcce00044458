"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.lineage import cut

__all__ = ["cut", "written", "table", "held_out", "text_or_empty", "min_labels", "shuffles_dropped"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    The folder is the session's ``spark.checkpoint.dir``; only a local session without that setting (tests) gets one of its own.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="flowspark-tables-")
    path = f"{folder}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, not when the driver's JVM happens to collect its garbage.

    For chains of many steps that are each materialised by ``cut`` or ``written``: nothing reads a shuffle again then.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def held_out(doc_id: Column) -> Column:
    """Rows kept out of every fit: crc32 of the id as text leaves remainder 2 modulo 4; a missing id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def min_labels(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b), as (node, label) with the smallest node as label.

    In each round a node takes the smallest of the labels that its neighbours and its own label have, so long chains settle
    in a logarithmic number of rounds. A round is one join and one aggregation; only whether a row changed reaches the driver.
    """
    both = cut(edges.where("a <> b").select("a", "b").unionAll(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        ways = both.withColumn("was", F.lit(None).cast(labels.schema["label"].dataType)).unionAll(labels.select(F.col("node").alias("a"), F.col("label").alias("b"), F.col("label").alias("was")))
        new = cut(ways.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.max("was").alias("was"), F.min("label").alias("label")))
        if new.where("was <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
