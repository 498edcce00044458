"""Peak reports that combine profiles, weather and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock
from flowspark.functions import time as t
from flowspark.operators import windows as win
from flowspark.operators.closures import section_roles
from flowspark.operators.graph import undirected
from flowspark.operators.grid import window_spine
from flowspark.operators.joins import closed_slots, within_km
from flowspark.operators.stats import load_band

AM, PM = (8, 15), (48, 55)  # 07:00-08:45 and 17:00-18:45 as positions in the service day


def peak_time(cells: DataFrame, caps: DataFrame, clock: Clock = DEFAULT_CLOCK, tie_pct: float = 2.0) -> DataFrame:
    """Usual peak under three definitions, rank and verdict against all stations, evening over morning, ceiling days."""
    wd = F.when(F.col("daytype") == 0, F.col("reading"))
    prof = cells.groupBy("station_key", "tod").agg(F.avg(wd).alias("m"), F.median(wd).alias("md"), F.avg("reading").alias("a"))
    g = prof.groupBy("station_key").agg(
        F.max_by("tod", F.struct("m", -F.col("tod"))).alias("wt"), F.max("m").alias("wd_peak"), F.max("md").alias("median_peak"), F.max("a").alias("all_peak")
    )
    mean = g.agg(F.avg("wd_peak")).scalar()
    diff = (F.col("wd_peak") / mean - 1) * 100
    verdict = F.when(F.abs(diff) < tie_pct, "about equal").when(diff > 0, "above").otherwise("below")
    g = g.withColumn("rank", F.rank().over(Window.orderBy(F.col("wd_peak").desc()))).withColumn("mean_of_peaks", mean).withColumn("verdict", verdict)
    d = day_means(cells).groupBy("station_key").agg(F.try_divide(F.avg("pm"), F.avg("am")).alias("pm_am_ratio"))
    mx = cells.filter("daytype = 0").groupBy("station_key", "day").agg(F.max("reading").alias("mx")).join(caps, "station_key")
    c = mx.groupBy("station_key").agg(F.avg((F.col("mx") >= F.col("ceiling")).cast("double")).alias("ceiling_share"))
    return g.join(d, "station_key").join(c, "station_key").withColumn("wd_time", t.tod_label("wt", clock))


def day_means(cells: DataFrame) -> DataFrame:
    """Morning and evening mean reading per station and weekday date."""
    return cells.filter("daytype = 0").groupBy("station_key", "day").agg(
        F.avg(F.when(F.col("tod").between(*AM), F.col("reading"))).alias("am"), F.avg(F.when(F.col("tod").between(*PM), F.col("reading"))).alias("pm")
    )


def ratio_interval(cells: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """95 % bootstrap interval of the evening/morning ratio; the same resampled days serve every station.

    Draws are a table of (draw, day index) made by hashing, so they are reproducible on any
    cluster. Summing per (station, draw) is a partial aggregation.
    """
    d = day_means(cells).filter("am IS NOT NULL AND pm IS NOT NULL").persist()
    days = d.select("day").distinct().withColumn("i", F.row_number().over(Window.orderBy("day")) - 1).persist()
    n = days.count()
    picks = days.select(F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), F.col("i").alias("k"))
    picks = picks.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "draw", "k"), F.lit(max(n, 1))).cast("int"))
    w = picks.groupBy("draw", "i").agg(F.count(F.lit(1)).alias("times")).join(days, "i").select("draw", "day", "times")
    j = d.join(w, "day").groupBy("station_key", "draw").agg(F.try_divide(F.sum(F.col("pm") * F.col("times")), F.sum(F.col("am") * F.col("times"))).alias("r"))
    return j.groupBy("station_key").agg(F.percentile("r", F.lit(0.025)).alias("lo"), F.percentile("r", F.lit(0.975)).alias("hi"))


def load_status(profile: DataFrame, caps: DataFrame) -> DataFrame:
    """Typical weekday peak as a share of the station's record."""
    g = profile.groupBy("station_key").agg(F.max("mean").alias("peak_mean")).join(caps.withColumnRenamed("ceiling", "station_max"), "station_key")
    return g.withColumn("pct", F.try_divide("peak_mean", "station_max") * 100).withColumn("status", load_band("pct"))


def weather_peaks(risk: DataFrame, weather: DataFrame, dry: DataFrame, caps: DataFrame, dry_mm: float = 0.5) -> DataFrame:
    """Strongest rain of every service day: network peak in the wet window, typical dry level, rank, ceiling hits, explained totals."""
    w = win.wet_window_at_peak(weather).select("day", "max_rain", "start", "last_slot")
    hit = (F.col("reading") >= F.col("ceiling")).cast("long")
    net = risk.join(dry, ["station_key", "slot"]).groupBy("day", "tod", "slot").agg(
        F.sum("reading").alias("v"), F.sum(hit).alias("at_ceiling"), F.sum("expected").alias("wet"), F.sum("expected_dry").alias("dry")
    ).persist()
    # One row per slot of the whole period: the network series is small whatever the number of stations.
    ranked = net.withColumn("net_rank", F.rank().over(Window.orderBy(F.col("v").desc())))
    x = w.join(ranked, "day").filter(F.col("slot").between(F.col("start"), F.col("last_slot")))
    dry_days = weather.groupBy("day").agg((F.sum("prcp") / 4).alias("mm")).filter(F.col("mm") < dry_mm).select("day")
    ref = net.join(dry_days, "day", "left_semi").select(F.col("day").alias("rday"), "tod", F.weekday("day").alias("wd"), F.col("v").alias("rv"))
    typ = x.select("day", "tod", F.weekday("day").alias("wd")).join(ref, ["tod", "wd"]).filter("rday <> day").groupBy("day", "tod").agg(F.median("rv").alias("typical"))
    g = x.groupBy("day", "max_rain", "start", "last_slot").agg(
        F.max_by(F.struct("slot", "tod", "v", "net_rank", "at_ceiling"), F.struct("v", -F.col("tod"))).alias("pk"),
        F.sum("v").alias("observed"), F.sum("wet").alias("with_rain"), F.sum("dry").alias("no_rain"),
    )
    g = g.select("day", "max_rain", "start", "last_slot", "observed", "with_rain", "no_rain", F.col("pk.slot").alias("peak_slot"), F.col("pk.tod").alias("tod"), F.col("pk.v").alias("peak"), F.col("pk.net_rank").alias("net_rank"), F.col("pk.at_ceiling").alias("at_ceiling"))
    return g.join(typ, ["day", "tod"], "left").withColumn("ratio", F.try_divide("peak", "typical"))


def weather_peak_flows(cells: DataFrame, outliers: DataFrame, top: int = 3) -> DataFrame:
    """Strongest stations from one hour before to two hours after the weather peak of each week."""
    h = F.hour("slot")
    o = outliers.select("week", F.to_date("slot").alias("cday"), F.explode(F.sequence(F.greatest(F.lit(0), h - 1), F.least(F.lit(24), h + 2) - 1)).alias("hr"))
    c = cells.select("station_key", F.to_date("slot").alias("cday"), F.hour("slot").alias("hr"), "reading")
    g = c.join(o, ["cday", "hr"]).groupBy("week", "station_key").agg(F.sum("reading").alias("total"))
    w = Window.partitionBy("week").orderBy(F.col("total").desc(), "station_key")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def disruption_response(risk: DataFrame, closures: DataFrame, suspensions: DataFrame, edges: DataFrame, stations: DataFrame, walk_km: float = 1.2, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Pooled response by role: adjacent and walkable stations of closures, ends and interiors of suspensions."""
    c = closures.filter("kind = 'station'").select("closure_id", "start", "end", F.col("stations")[0].alias("k"))
    e = undirected(edges)
    adj = c.join(e.toDF("k", "station_key"), "k").select("closure_id", "start", "end", "station_key", F.lit("adjacent").alias("role"))
    s = stations.select(F.col("station_key").alias("k"), "lat", "lon")
    near = within_km(s, stations.select("station_key", "lat", "lon"), walk_km).filter("k <> station_key").select("k", "station_key")
    near = near.join(e.toDF("k", "station_key"), ["k", "station_key"], "left_anti")
    walk = c.join(near, "k").select("closure_id", "start", "end", "station_key", F.lit("walkable").alias("role"))
    roles = section_roles(suspensions).join(suspensions.select("closure_id", "start", "end"), "closure_id")
    roles = roles.select("closure_id", "start", "end", "station_key", F.concat(F.lit("susp_"), "role").alias("role"))
    all_ = adj.unionByName(walk).unionByName(roles)
    x = window_spine(all_.withColumn("s0", F.col("start")), clock, inclusive=False).filter(F.col("slot") >= F.col("s0"))
    j = x.select("role", "station_key", "slot").join(risk.select("station_key", "slot", "reading", "expected"), ["station_key", "slot"])
    g = j.groupBy("role").agg(F.sum(F.col("reading") - F.col("expected")).alias("extra"), F.sum("expected").alias("expected"), F.sum(F.col("expected") * F.col("expected")).alias("v"))
    return g.withColumn("change", F.col("extra") / F.greatest("expected", F.lit(1.0))).withColumn("z", F.col("extra") / F.sqrt(F.greatest("v", F.lit(1.0)))).drop("v")


def closure_groups(risk: DataFrame, suspensions: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Observed and expected totals by group of stations over each suspension."""
    r = section_roles(suspensions).join(suspensions.select("closure_id", "start", "end"), "closure_id")
    x = window_spine(r.withColumn("s0", F.col("start")), clock, inclusive=False).filter(F.col("slot") >= F.col("s0"))
    j = x.select("closure_id", "role", "station_key", "slot").join(risk.select("station_key", "slot", "reading", "expected"), ["station_key", "slot"])
    g = j.groupBy("closure_id", "role").agg(F.countDistinct("station_key").alias("stations"), F.sum("reading").alias("observed"), F.sum("expected").alias("expected"))
    return g.withColumn("change_pct", (F.col("observed") / F.greatest("expected", F.lit(1.0)) - 1) * 100)


def feedback_rollup(log: DataFrame) -> DataFrame:
    """Ratings per kind: (kind, rating up/down, time, comment)."""
    return log.groupBy("kind").agg(
        F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"),
        F.avg((F.col("rating") == "up").cast("double")).alias("up_share"), F.max_by("comment", F.struct("time", "comment")).alias("last_comment"),
    )


def last_comments(log: DataFrame, k: int = 10) -> DataFrame:
    return log.filter("comment IS NOT NULL").orderBy(F.col("time").desc()).limit(k)


# What counts as near an event, how long before and after it, and its size classes.
NEAR_EVENT_KM, BEFORE_EVENT_MIN, AFTER_EVENT_MIN = 1.5, 90, 60
LARGE_CROWD, MEDIUM_CROWD = 1500, 800


def peak_confounders(peaks: DataFrame, events: DataFrame, venues: DataFrame, stations: DataFrame, closures: DataFrame, line_closures: DataFrame | None = None, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """What else may explain a peak (station_key, cday, slot): events in walking distance around its slot, closures of the station or of a line it is on.

    ``line_closures`` holds (closure_id, line, start, end). Returns the peaks with ``events`` and ``closures`` (numbers), ``event_names`` (sorted) and ``crowd``
    (high, medium or low by the largest attendance, null without events). Events and closures are exploded into slots and meet the peaks by station and slot.
    """
    near = within_km(venues, stations.select("station_key", "lat", "lon"), NEAR_EVENT_KM).select("venue_key", "station_key")
    w = events.select("crowd_id", "event_name", "attendance", "venue_key", (F.col("start") - t.minutes(BEFORE_EVENT_MIN)).alias("start"), (F.col("end") + t.minutes(AFTER_EVENT_MIN)).alias("end"))
    at = window_spine(w, clock).filter(F.col("slot") >= F.col("start")).select("crowd_id", "event_name", "attendance", "venue_key", "slot").join(near, "venue_key")
    key = ["station_key", "slot"]
    e = peaks.select(*key).distinct().join(at, key).groupBy(*key).agg(F.count_distinct("crowd_id").alias("events"), F.array_sort(F.collect_set("event_name")).alias("event_names"), F.max("attendance").alias("_most"))
    shut = closed_slots(closures, clock).select("station_key", "slot", F.col("closure_id").cast("string").alias("id"))
    if line_closures is not None:
        on = stations.select("station_key", F.explode("lines").alias("line"))
        lc = line_closures.select(F.concat(F.lit("line "), F.col("closure_id").cast("string")).alias("id"), "line", "start", "end").join(on, "line")
        shut = shut.unionByName(window_spine(lc, clock, inclusive=False).filter(F.col("slot") >= F.col("start")).select("station_key", "slot", "id"))
    c = peaks.select(*key).distinct().join(shut, key).groupBy(*key).agg(F.count_distinct("id").alias("closures"))
    out = peaks.join(e, key, "left").join(c, key, "left").na.fill(0, ["events", "closures"])
    crowd = F.when(F.col("_most") >= LARGE_CROWD, "high").when(F.col("_most") >= MEDIUM_CROWD, "medium").when(F.col("_most").isNotNull(), "low")
    return out.withColumn("event_names", F.coalesce("event_names", F.array().cast("array<string>"))).withColumn("crowd", crowd).drop("_most")
