"""Impact of single crowd events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, DEFAULT_PARAMS, Clock, ModelParams
from flowspark.functions import time as t
from flowspark.functions.noise import p_ceiling
from flowspark.model.expect import base_lambda
from flowspark.model.fit import Fit
from flowspark.operators.grid import window_spine
from flowspark.operators.joins import kernel_load


def impact_cells(fit: Fit, events: DataFrame, weather: DataFrame | None, params: ModelParams = DEFAULT_PARAMS, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Per event, station and slot from 90 min before the start to 2 h 15 after the end: baseline, extra load, chance of the ceiling.

    Every event is its own scenario without other events or closures. Without a weather table the
    scenario is 18 degrees and dry, unless the events carry tmean and prcp.
    """
    e = events
    if weather is None:
        for name, default in (("tmean", 18.0), ("prcp", 0.0)):
            if name not in e.columns:
                e = e.withColumn(name, F.lit(default))
    w = e.withColumn("s0", F.col("start")).withColumn("e0", F.col("end"))
    w = w.withColumn("start", F.col("s0") - t.minutes(90)).withColumn("end", F.col("e0") + t.minutes(135))
    cells = window_spine(w, clock).join(fit.shares, "venue_key")
    if weather is not None:
        cells = cells.join(weather.select("slot"), "slot", "left_semi")
    c = base_lambda(fit, cells, weather)
    load = kernel_load(events, params, clock).groupBy("crowd_id", "slot").agg(F.sum("load").alias("crowd"))
    c = c.join(load, ["crowd_id", "slot"], "left").withColumn("extra", F.coalesce("crowd", F.lit(0.0)) * F.col("share"))
    return c.withColumn("lam", F.col("base") + F.col("extra")).withColumn("p", p_ceiling("lam", "ceiling"))


def event_impact(fit: Fit, events: DataFrame, weather: DataFrame | None, params: ModelParams = DEFAULT_PARAMS, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    c = impact_cells(fit, events, weather, params, clock)
    return c.groupBy("crowd_id", "station_key").agg(
        F.sum("extra").alias("extra"), F.sum("base").alias("baseline"), F.max("p").alias("p_max"), F.count(F.lit(1)).alias("slots")
    )
