"""Anomaly detectors for ranges of days and their ranked union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock
from flowspark.functions import time as t
from flowspark.functions.noise import expected_reading
from flowspark.operators import windows as win
from flowspark.operators.events import event_checks, shows
from flowspark.operators.grid import window_spine
from flowspark.operators.joins import nearest, within_km

SCHEMA = ["day", "type", "where", "observed", "normal", "score", "cause"]


def spikes(risk: DataFrame, factor: float = 8.0, min_level: float = 3.0) -> DataFrame:
    """Isolated readings far above the expected level, counted per day."""
    s = risk.withColumn("s", (F.col("reading") > factor * F.col("lam")) & (F.col("lam") > min_level))
    return s.groupBy("day").agg(F.count_if("s").alias("spikes"))


def spill_over(risk: DataFrame, events: DataFrame, shares: DataFrame, venues: DataFrame, stations: DataFrame, radius_km: float = 2.5, min_z: float = 5.0, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Strong excess after an event at stations outside every split of that day, given to the nearest event."""
    s = shows(events).withColumn("day", t.service_day("start", clock))
    near = within_km(venues, stations.select("station_key", "lat", "lon"), radius_km).select("venue_key", "station_key", "km")
    split = s.select("day", "venue_key").distinct().join(shares, "venue_key").select("day", "station_key").distinct()
    cand = s.join(near, "venue_key").join(split, ["day", "station_key"], "left_anti")
    w = Window.partitionBy("day", "station_key").orderBy("km", "show_id")
    cand = cand.withColumn("r", F.rank().over(Window.partitionBy("day", "station_key").orderBy("km"))).filter("r = 1")
    x = cand.select("show_id", "day", "station_key", "km", F.col("end").alias("start"), (F.col("end") + t.minutes(105)).alias("end"))
    c = window_spine(x.withColumnRenamed("day", "eday"), clock)
    j = c.select("show_id", "eday", "station_key", "km", "slot").join(risk.select("station_key", "slot", "reading", "expected0"), ["station_key", "slot"])
    g = j.groupBy("show_id", F.col("eday").alias("day"), "station_key", "km").agg(
        F.sum("reading").alias("observed"), F.sum("expected0").alias("normal"), F.sum(F.col("expected0") * F.col("expected0")).alias("v")
    )
    return g.withColumn("z", (F.col("observed") - F.col("normal")) / F.sqrt(F.col("v") + 1)).filter(F.col("z") > min_z).drop("v")


def rain_findings(risk: DataFrame, weather: DataFrame, dry: DataFrame, min_excess: float = 0.05, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Rain episodes with the network total against a dry day and against the rain rule.

    ``dry`` holds (station_key, slot, expected_dry). The usual spread of observed over model comes
    from the same clock window on the other same weekdays.
    """
    ep = win.rain_episodes(weather)
    net = risk.groupBy("slot").agg(F.sum("reading").alias("o"), F.sum("expected").alias("m"))
    d = dry.groupBy("slot").agg(F.sum("expected_dry").alias("d"))
    net = net.join(d, "slot", "left").persist()
    key = ["day", "island"]
    base = ep.select(*key, "max_rain", "mm", "start", F.col("last_slot").alias("end"), F.col("day").alias("eday"))
    own = window_spine(base.drop("day"), clock).withColumnRenamed("day", "_d").join(net, "slot")
    g = own.groupBy("eday", "island", "max_rain", "mm").agg(F.min("slot").alias("start"), F.max("slot").alias("last_slot"), F.sum("o").alias("observed"), F.sum("d").alias("expected_dry"), F.sum("m").alias("expected_rain"))
    lo = net.agg(F.min("slot")).scalar()
    hi = net.agg(F.max("slot")).scalar()
    weeks = (F.floor(F.datediff(hi, lo) / 7) + 1).cast("int")  # as far as the data reaches
    ref = base.drop("day").withColumn("k", F.explode(F.sequence(-weeks, weeks))).filter("k <> 0")
    ref = ref.withColumn("start", F.col("start") + t.minutes(F.col("k") * 10080)).withColumn("end", F.col("end") + t.minutes(F.col("k") * 10080))
    ref = ref.filter((F.col("start") >= lo) & (F.col("end") <= hi))
    rs = window_spine(ref, clock).join(net, "slot").groupBy("eday", "island", "k").agg(F.try_divide(F.sum("o"), F.sum("m")).alias("r"))
    rs = rs.groupBy("eday", "island").agg(F.stddev_pop("r").alias("usual_sd"))
    g = g.join(rs, ["eday", "island"], "left").withColumn("excess", F.try_divide("observed", "expected_dry") - 1)
    sd = F.coalesce(F.nullif("usual_sd", F.lit(0.0)), F.lit(0.03))
    g = g.withColumn("explained", F.when(F.col("observed") > F.col("expected_dry"), (F.col("expected_rain") - F.col("expected_dry")) / (F.col("observed") - F.col("expected_dry"))))
    return g.withColumn("is_finding", F.col("excess") > F.greatest(F.lit(min_excess), 2 * sd)).withColumnRenamed("eday", "day")


def station_day_findings(daily: DataFrame, closures: DataFrame, events: DataFrame, shares: DataFrame, min_ref: int = 5, min_z: float = 3.0, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Unusual whole days per station against the same weekday, closure days and event stations left out.

    Sums over the group minus the day's own value give each day's reference without a self-join.
    """
    shut = closures.filter((F.col("kind") == "station") & (F.size("stations") > 0)).select(
        F.col("stations")[0].alias("station_key"), t.service_day("start", clock).alias("day")
    ).distinct().withColumn("shut", F.lit(True))
    split = shows(events).select("venue_key", t.service_day("start", clock).alias("day")).distinct().join(shares, "venue_key").select("station_key", "day").distinct().withColumn("split", F.lit(True))
    d = daily.select("station_key", "day", F.col("total").cast("double").alias("v"), F.weekday("day").alias("wd"))
    d = d.join(shut, ["station_key", "day"], "left").join(split, ["station_key", "day"], "left").na.fill(False, ["shut", "split"])
    w = Window.partitionBy("station_key", "wd")
    ok = (~F.col("shut")).cast("int")
    n = F.sum(ok).over(w) - ok
    s = F.sum(F.col("v") * ok).over(w) - F.col("v") * ok
    q = F.sum(F.col("v") * F.col("v") * ok).over(w) - F.col("v") * F.col("v") * ok
    d = d.withColumn("n", n).withColumn("s", s).withColumn("q", q).filter(F.col("n") >= min_ref)
    d = d.withColumn("mean", F.col("s") / F.col("n")).withColumn("var", (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    d = d.filter("var > 0 AND NOT shut AND NOT split").withColumn("z", (F.col("v") - F.col("mean")) / F.sqrt("var"))
    return d.filter(F.abs("z") >= min_z).select("station_key", "day", F.col("v").alias("observed"), F.col("mean").alias("normal"), "n", "z")


def unexplained(risk: DataFrame, top: int = 8) -> DataFrame:
    """Best one-hour window per station and day: one-slot spikes told apart from lasting excess."""
    base = risk.withColumn("model_reading", F.col("expected")).withColumn("expected", F.col("expected0"))
    w = Window.partitionBy("station_key", "day").orderBy("tod").rowsBetween(-3, 0)
    ex = F.col("reading") - F.col("expected")
    b = base.withColumn("max_exc", F.max(ex).over(w)).withColumn("high", F.sum((F.col("reading") > 3 * F.greatest(F.col("expected"), F.lit(1.0))).cast("int")).over(w))
    vm = F.sum(F.col("model_reading") * F.col("model_reading")).over(w)
    b = b.withColumn("zm", (F.sum("reading").over(w) - F.sum("model_reading").over(w)) / F.sqrt(vm + 1))
    z = win.best_window(win.rolling_z(b), top).withColumn("excess", F.col("obs4") - F.col("exp4"))
    kind = F.when(F.col("excess") <= 0, "none").when(F.col("max_exc") / F.col("excess") > 0.6, "spike").when((F.col("zm") > 5) & (F.col("high") >= 2), "unexplained").otherwise("none")
    return z.withColumn("kind", kind)


def anomaly_scan(event_rows: DataFrame, rain: DataFrame, days: DataFrame, hours: DataFrame) -> DataFrame:
    """Ranked findings per day from the detectors above; the two waves of one event count once."""
    e = event_rows.filter("z >= 3 AND extra > 0")
    e = e.groupBy("day", "show_id", "venue_key").agg(F.sum("observed").alias("observed"), F.sum("normal").alias("normal"), (F.max("z") + 100).alias("score"))
    e = e.select("day", F.lit("event crowd").alias("type"), F.col("venue_key").alias("where"), "observed", "normal", "score", F.col("show_id").cast("string").alias("cause"))
    r = rain.filter("is_finding").select("day", F.lit("weather").alias("type"), F.lit("network").alias("where"), "observed", F.col("expected_dry").alias("normal"), F.lit(50.0).alias("score"), F.lit("rain").alias("cause"))
    d = days.select("day", F.lit("station-day").alias("type"), F.col("station_key").alias("where"), "observed", "normal", (F.abs("z") + 30).alias("score"), F.lit("none known").alias("cause"))
    h = hours.filter("kind = 'unexplained'").select("day", F.lit("unexplained").alias("type"), F.col("station_key").alias("where"), F.col("obs4").alias("observed"), F.col("exp4").alias("normal"), (F.col("zm") + 10).alias("score"), F.lit("none known").alias("cause"))
    u = e
    for x in (r, d, h):
        u = u.unionByName(x)
    w = Window.partitionBy("day").orderBy(F.col("score").desc(), "type", "where", "cause")
    return u.withColumn("rank", F.row_number().over(w))


def energy_residual_z(days: DataFrame, model: DataFrame) -> DataFrame:
    """Residual of daily energy per line in units of its usual spread."""
    j = days.join(model, "line")
    return j.withColumn("z", F.try_divide(F.col("mwh") - (F.col("b0") + F.col("b1") * F.col("riders")), F.col("sd")))
