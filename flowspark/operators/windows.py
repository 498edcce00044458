"""Window-function operators: rolling tests, runs, islands, merges, residuals.

Series windows are partitioned by (station, service day) wherever the rule cannot reach over the
nightly pause, so one busy station never forms one long partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock
from flowspark.functions import time as t


def op_index(clock: Clock = DEFAULT_CLOCK) -> Column:
    """Operating-slot number: consecutive over the nightly pause."""
    return F.unix_date("day").cast("long") * clock.slots_per_day + F.col("tod")


def rolling_z(cells: DataFrame, width: int = 4, floor_var: bool = False) -> DataFrame:
    """Rolling (sum observed - sum expected) / sqrt(sum expected^2 + 1) over ``width`` slots in service order."""
    w = Window.partitionBy("station_key", "day").orderBy("tod")
    r = w.rowsBetween(-(width - 1), 0)
    var = F.sum(F.col("expected") * F.col("expected")).over(r)
    sd = F.sqrt(F.greatest(var, F.lit(1.0))) if floor_var else F.sqrt(var + 1)
    out = cells.withColumn("n4", F.count(F.lit(1)).over(r)).withColumn("obs4", F.sum("reading").over(r))
    out = out.withColumn("exp4", F.sum("expected").over(r)).withColumn("span", F.col("tod") - F.min("tod").over(r))
    out = out.withColumn("z", (F.col("obs4") - F.col("exp4")) / sd)
    return out.filter((F.col("n4") == width) & (F.col("span") == width - 1))


def best_window(z: DataFrame, top: int | None = None) -> DataFrame:
    """Strongest rolling window per station and day."""
    w = Window.partitionBy("station_key", "day").orderBy(F.col("z").desc(), "tod")
    z = z.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    if top:
        k = F.row_number().over(Window.partitionBy("day").orderBy(F.col("z").desc(), "station_key"))
        z = z.withColumn("rank", k).filter(F.col("rank") <= top)
    return z


def alert_rules(cells: DataFrame) -> DataFrame:
    """Rules R1..R4 on cells with reading, q95, q99 and expected (normal level).

    R1 two and R2 three readings in a row above q95, R3 two above q99 (only slots that really
    follow each other), R4 last hour more than three standard deviations above normal.
    """
    w = Window.partitionBy("station_key", "day").orderBy("tod")
    c = cells.withColumn("a95", F.col("reading") > F.col("q95")).withColumn("a99", F.col("reading") > F.col("q99"))
    prev = lambda c_, k: F.coalesce(F.lag(c_, k).over(w), F.lit(False))
    step = F.col("tod") - F.lag("tod", 1).over(w)
    c1 = F.coalesce(step == 1, F.lit(False))
    c2 = c1 & F.coalesce(F.col("tod") - F.lag("tod", 2).over(w) == 2, F.lit(False))
    r4w = w.rowsBetween(-3, 0)
    z = (F.sum("reading").over(r4w) - F.sum("expected").over(r4w)) / F.sqrt(
        F.greatest(F.sum(F.col("expected") * F.col("expected")).over(r4w), F.lit(1.0))
    )
    span = F.coalesce(F.col("tod") - F.lag("tod", 3).over(w) == 3, F.lit(False))
    return (
        c.withColumn("R1", F.col("a95") & prev("a95", 1) & c1)
        .withColumn("R2", F.col("a95") & prev("a95", 1) & prev("a95", 2) & c2)
        .withColumn("R3", F.col("a99") & prev("a99", 1) & c1)
        .withColumn("R4", (z > 3) & span)
        .drop("a95", "a99")
    )


def long_rules(rules: DataFrame) -> DataFrame:
    """One row per firing (rule, station_key, slot, day, tod)."""
    arr = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("fired")) for r in ("R1", "R2", "R3", "R4")])
    x = rules.select("station_key", "slot", "day", "tod", F.explode(arr).alias("x"))
    return x.filter("x.fired").select(F.col("x.rule").alias("rule"), "station_key", "slot", "day", "tod")


def episodes(fired: DataFrame, gap: int = 4, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """First firing of each run: more than ``gap`` operating slots since the last firing."""
    w = Window.partitionBy("rule", "station_key").orderBy("op")
    f = fired.withColumn("op", op_index(clock))
    return f.withColumn("last", F.lag("op").over(w)).filter(F.col("last").isNull() | (F.col("op") - F.col("last") > gap)).drop("last")


def islands(flagged: DataFrame, keys: list[str], index: str, gap: int) -> DataFrame:
    """Number the islands of rows whose index steps are at most ``gap`` (column ``island``)."""
    w = Window.partitionBy(*keys).orderBy(index)
    step = F.col(index) - F.lag(index).over(w)
    new = F.when(step.isNull() | (step > gap), 1).otherwise(0)
    return flagged.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def flagged_windows(cells: DataFrame, gap: int = 2) -> DataFrame:
    """Merge flagged cells of a station and day into windows scored by over-capacity and event load."""
    f = islands(cells.filter("flag"), ["station_key", "day"], "tod", gap)
    span = f.groupBy("station_key", "day", "island").agg(F.min("tod").alias("tod_from"), F.max("tod").alias("tod_to"))
    inner = span.withColumn("tod", F.explode(F.sequence("tod_from", "tod_to")))
    j = inner.join(cells.select("station_key", "day", "tod", "over", "event_load", "p"), ["station_key", "day", "tod"])
    return j.groupBy("station_key", "day", "island", "tod_from", "tod_to").agg(
        (F.sum("over") + 0.2 * F.sum("event_load")).alias("score"), F.max("p").alias("p_max"), F.max("event_load").alias("event_load_max"),
        F.max_by("tod", F.struct(F.col("event_load"), -F.col("tod"))).alias("tod_event_peak"),
    )


def top_per_station(windows: DataFrame, per_station: int = 2, top: int = 8) -> DataFrame:
    """Best windows of each day, at most ``per_station`` of one station."""
    score = F.round("score", 6)  # sums in another order differ in the last bits
    w1 = Window.partitionBy("day", "station_key").orderBy(score.desc(), F.col("tod_from").desc())
    w2 = Window.partitionBy("day").orderBy(score.desc(), F.col("station_key").desc(), F.col("tod_from").desc())
    x = windows.withColumn("r1", F.row_number().over(w1)).filter(F.col("r1") <= per_station)
    return x.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= top).drop("r1")


def rain_episodes(weather: DataFrame, gap_minutes: int = 30, min_minutes: int = 30) -> DataFrame:
    """Wet slots merged over short gaps, per service day; the start is floored to the hour."""
    wet = weather.filter("prcp > 0").withColumn("m", t.slot_no("slot") * 15)
    g = islands(wet, ["day"], "m", gap_minutes).groupBy("day", "island").agg(
        t.hour_floor(F.min("slot")).alias("start"), F.max("slot").alias("last_slot"), F.max("prcp").alias("max_rain"), (F.sum("prcp") / 4).alias("mm")
    )
    return g.filter((t.slot_no("last_slot") - t.slot_no("start")) * 15 >= min_minutes)


def wet_window_at_peak(weather: DataFrame) -> DataFrame:
    """Per service day with rain: the contiguous wet window around the strongest rain."""
    wet = weather.filter("prcp > 0").withColumn("n", t.slot_no("slot"))
    wet = islands(wet, ["day"], "n", 1)
    best = F.max_by("island", F.struct("prcp", -F.col("n")))
    b = wet.groupBy("day").agg(best.alias("island"), F.max("prcp").alias("max_rain"))
    return wet.join(b, ["day", "island"]).groupBy("day", "max_rain").agg(F.min("slot").alias("start"), F.max("slot").alias("last_slot"), F.count(F.lit(1)).alias("slots"))


def zero_runs(cells: DataFrame, min_slots: int = 3, min_level: float = 20.0) -> DataFrame:
    """Runs of zero readings where the expected level is high: possible unlisted closures."""
    z = cells.filter((F.col("reading") == 0) & (F.col("expected") > min_level))
    g = islands(z, ["station_key", "day"], "tod", 1).groupBy("station_key", "day", "island")
    return g.agg(F.min("tod").alias("tod_from"), F.count(F.lit(1)).alias("zero_slots")).filter(F.col("zero_slots") >= min_slots).drop("island")


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Merge overlapping [start, end) rows of a key; n counts the merged rows."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0)
    x = rows.withColumn("_new", new).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_i")


def residuals(cells: DataFrame) -> DataFrame:
    """Reading minus the station's mean at the same day type and time of day."""
    w = Window.partitionBy("station_key", "daytype", "tod")
    return cells.withColumn("residual", F.col("reading") - F.avg("reading").over(w))


def best_block(cells: DataFrame, value: str, width: int) -> DataFrame:
    """Best block of ``width`` consecutive slots per station and day (first on ties)."""
    w = Window.partitionBy("station_key", "day").orderBy("tod").rowsBetween(0, width - 1)
    b = cells.withColumn("block", F.sum(value).over(w)).withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("n") == width)
    return b.groupBy("station_key", "day").agg(F.max("block").alias("block"), F.max_by("tod", F.struct("block", -F.col("tod"))).alias("tod_from"))


def fill_in_order(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Linear fill of missing values along a sequence; one-sided gaps step by one, never below zero."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, fwd = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    pos = F.row_number().over(w)
    x = rows.withColumn("_pos", pos)
    have = F.when(F.col(value).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(value).cast("double").alias("v")))
    x = x.withColumn("_h", have)
    x = x.withColumn("_a", F.last("_h", ignorenulls=True).over(back)).withColumn("_b", F.first("_h", ignorenulls=True).over(fwd))
    a, b, p = F.col("_a"), F.col("_b"), F.col("_pos")
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value).cast("double"))
        .when(a.isNotNull() & b.isNotNull(), a.v + (b.v - a.v) * (p - a.p) / (b.p - a.p))
        .when(a.isNotNull(), a.v + (p - a.p)).when(b.isNotNull(), F.greatest(F.lit(0.0), b.v - (b.p - p))).otherwise(F.lit(0.0))
    )
    return x.withColumn("filled", filled).drop("_pos", "_h", "_a", "_b")
