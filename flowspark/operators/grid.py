"""Slot spines and dense grids, generated in parallel instead of cross-joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock
from flowspark.functions import time as t


def service_spine(spark: SparkSession, first_day: Column, last_day: Column, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Service slots of every day in [first_day, last_day]: (day, tod, slot, daytype).

    Days are spread over the shuffle partitions before they are exploded into slots.
    """
    days = spark.range(1).select(F.explode(F.sequence(first_day, last_day)).alias("day")).repartition("day")
    s = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(clock.slots_per_day - 1))).alias("tod"))
    start = F.col("day").cast("timestamp_ntz") + t.minutes(60 * clock.service_start_hour + F.col("tod") * clock.slot_minutes)
    return s.select("day", "tod", start.alias("slot"), t.day_type("day", clock).alias("daytype"))


def window_spine(requests: DataFrame, clock: Clock = DEFAULT_CLOCK, start="start", end="end", inclusive=True) -> DataFrame:
    """Explode each request row into its service slots; the nightly pause is dropped.

    ``inclusive`` keeps a slot that begins exactly at ``end`` (the convention of expectation
    windows); otherwise the window is half-open.
    """
    hi = t.slot_no(end, clock) if inclusive else t.slot_no(F.col(end) - F.expr("INTERVAL 1 MICROSECOND"), clock)
    lo = t.slot_no(start, clock)
    s = requests.withColumn("_n", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    s = s.withColumn("slot", t.slot_from_no("_n", clock)).drop("_n")
    s = s.filter(t.in_service("slot", clock)).withColumn("day", t.service_day("slot", clock))
    return s.withColumn("tod", t.tod("slot", clock)).withColumn("daytype", t.day_type("day", clock))
