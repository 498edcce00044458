"""Service levels by hour of day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trains_per_hour(slots: DataFrame, table: DataFrame, ts: str = "slot") -> DataFrame:
    """Attach trains per hour from (hour_from, hour_to, trains); the ranges become hours of day, so the join is an equi-join."""
    per_hour = table.select(F.explode(F.sequence("hour_from", F.col("hour_to") - 1)).alias("_h"), "trains")
    return slots.withColumn("_h", F.hour(ts)).join(per_hour, "_h").drop("_h")
