"""Reports assembled from the operators, for many days or stations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock
from flowspark.functions import time as t
from flowspark.operators import windows as win
from flowspark.operators.events import shows
from flowspark.operators.graph import cut_sets, undirected
from flowspark.operators.grid import window_spine
from flowspark.operators.joins import within_km


# -- value of early warning -------------------------------------------------------------------


def causes(risk: DataFrame, closures: DataFrame, back: int = 2, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Cells whose alert an event crowd, rain or a reopening explains, looking ``back`` operating slots back."""
    ev = F.col("event_load") > F.greatest(F.lit(20.0), 0.3 * F.col("lam0"))
    c = closures.filter("kind = 'station'").select(F.col("stations")[0].alias("station_key"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"), t.slot_ceil("end", clock).alias("e"))
    reb = c.select("station_key", (F.col("e") + t.minutes(F.col("r") * clock.slot_minutes)).alias("slot")).distinct().withColumn("reb", F.lit(True))
    x = risk.join(reb, ["station_key", "slot"], "left")
    x = x.withColumn("cause", ev | (F.col("prcp") >= 0.5) | F.coalesce("reb", F.lit(False))).withColumn("op", win.op_index(clock))
    w = Window.partitionBy("station_key").orderBy("op").rowsBetween(-back, 0)
    return x.select("station_key", "slot", "day", "tod", F.max("cause").over(w).alias("explained"))


def early_warning(fired: DataFrame, explained: DataFrame, events: DataFrame, shares: DataFrame, n_days, min_attendance: float = 1000, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Score of each alert rule: alerts a day, share explained, events detected within two hours, median delay."""
    ep = win.episodes(fired, clock=clock)
    a = ep.join(explained.select("station_key", "slot", "explained"), ["station_key", "slot"], "left").groupBy("rule").agg(
        F.count(F.lit(1)).alias("alerts"), F.avg(F.coalesce(F.col("explained"), F.lit(False)).cast("double")).alias("share_explained")
    )
    big = shows(events).filter(F.col("attendance") >= min_attendance)
    main = shares.filter("share >= 0.2").select("venue_key", "station_key")
    big = big.join(main.select("venue_key").distinct(), "venue_key", "left_semi")
    n = big.agg(F.count(F.lit(1)).alias("n"))
    w = big.select("show_id", "venue_key", t.slot_floor("end", clock).alias("e0"), t.slot_floor("end", clock).alias("start"), (t.slot_floor("end", clock) + t.minutes(120)).alias("end"))
    cells = window_spine(w, clock, inclusive=False)
    cells = cells.withColumn("step", F.row_number().over(Window.partitionBy("show_id").orderBy("slot")) - 1).join(main, "venue_key")
    hit = cells.join(fired.select("rule", "station_key", "slot"), ["station_key", "slot"]).groupBy("rule", "show_id").agg((F.min("step") * clock.slot_minutes).alias("delay"))
    d = hit.groupBy("rule").agg(F.count(F.lit(1)).alias("detected"), F.median("delay").alias("median_delay"))
    out = a.join(d, "rule", "left").na.fill(0, ["detected"])
    out = out.withColumn("alerts_per_day", F.col("alerts") / n_days).withColumn("events_detected", F.col("detected") / F.greatest(n.scalar(), F.lit(1)))
    return out.withColumn("score", F.col("share_explained") * F.col("events_detected"))


def planning_coverage(risk: DataFrame, windows: DataFrame, fired: DataFrame) -> DataFrame:
    """How many event-related ceiling readings lay in flagged windows, and how many flagged windows the readings confirmed.

    ``windows`` are watch windows with a ``reason``; only event windows count.
    """
    cause = F.col("event_load") > F.greatest(F.lit(20.0), 0.3 * F.col("lam0"))
    w = windows.filter("reason IN ('arrivals', 'departures')")
    cells = w.withColumn("tod", F.explode(F.sequence(F.greatest(F.col("tod_from") - 1, F.lit(0)), F.col("tod_to") + 1))).select("day", "station_key", "rank", "tod")
    r1 = fired.filter("rule = 'R1'").select("station_key", "day", "tod", F.lit(True).alias("r1"))
    j = cells.join(risk.select("station_key", "day", "tod", "reading", "ceiling"), ["station_key", "day", "tod"]).join(r1, ["station_key", "day", "tod"], "left")
    conf = j.groupBy("day", "rank").agg(F.max((F.col("reading") >= 0.9 * F.col("ceiling")) | F.coalesce("r1", F.lit(False))).alias("ok"))
    hits = risk.filter(cause & (F.col("reading") >= F.col("ceiling"))).select("station_key", "day", "tod")
    covered = hits.join(cells.select("station_key", "day", "tod").distinct(), ["station_key", "day", "tod"], "left_semi")
    out = hits.agg(F.count(F.lit(1)).alias("event_ceiling_readings"))
    out = out.withColumn("flagged_in_advance", covered.agg(F.count(F.lit(1))).scalar())
    return out.withColumn("event_windows", conf.agg(F.count(F.lit(1))).scalar()).withColumn("confirmed", conf.agg(F.count_if("ok")).scalar())


def reinforcement_value(plan: DataFrame) -> DataFrame:
    """Demand above capacity beyond a normal day, absorbed by mode and left over, per day."""
    h = F.col("hours")
    modes = {
        "trains": F.col("trains_absorb") * h, "rail": F.col("rail_absorb") * h, "ground": (F.col("ground1") + F.col("ground2")) * h,
        "bike": F.col("bike_absorb") * h, "taxi": F.col("taxi_absorb") * h,
    }
    p = plan.select("day", "extra_total", "residual_total", *[F.least(v, F.greatest("extra_total", F.lit(0.0))).alias(k) for k, v in modes.items()])
    g = p.groupBy("day").agg(F.sum("extra_total").alias("extra"), F.sum("residual_total").alias("residual"), *[F.sum(k).alias(k) for k in modes])
    tot = F.col("trains") + F.col("rail") + F.col("ground") + F.col("bike") + F.col("taxi")
    return g.filter("extra > 0").withColumn("absorbed", F.least(tot, F.col("extra"))).withColumn("share_absorbed", F.col("absorbed") / F.col("extra"))


# -- daily reports ----------------------------------------------------------------------------


def section_rows(df: DataFrame, section: str, day, order, payload: list[str]) -> DataFrame:
    """One report section as (day, section, rank, payload JSON)."""
    w = Window.partitionBy(day).orderBy(*order)
    return df.select(F.col(day).alias("day"), F.lit(section).alias("section"), F.row_number().over(w).alias("rank"), F.to_json(F.struct(*payload)).alias("payload"))


def weather_lines(weather: DataFrame) -> DataFrame:
    return weather.groupBy("day").agg(F.min("temp").alias("temp_min"), F.max("temp").alias("temp_max"), (F.sum("prcp") / 4).alias("rain_mm"), F.max("prcp").alias("max_rain"))


def network_lines(risk: DataFrame) -> DataFrame:
    return risk.groupBy("day").agg(F.round(F.sum("expected")).alias("expected"), F.round(F.sum("expected0")).alias("normal"), F.sum("reading").alias("recorded"))


def daily_brief(risk, weather, events, closures, watch, roster, plan, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Situation, risks, staff and reinforcement of every day as one table of sections."""
    e = events.withColumn("day", t.service_day(F.col("start") - F.expr("INTERVAL 0 HOURS"), clock))
    c = closures.withColumn("day", t.service_day("start", clock))
    parts = [
        section_rows(weather_lines(weather), "weather", "day", ["day"], ["temp_min", "temp_max", "rain_mm", "max_rain"]),
        section_rows(network_lines(risk), "network", "day", ["day"], ["expected", "normal", "recorded"]),
        section_rows(e, "event", "day", ["start", "crowd_id"], ["event_name", "venue_key", "start", "end", "attendance"]),
        section_rows(c, "closure", "day", ["start", "closure_id"], ["description", "start", "end"]),
        section_rows(watch, "watch", "day", [F.col("rank")], ["station_key", "tod_from", "tod_to", "p_max"]),
        section_rows(roster, "staff", "day", ["tod_from", "station_key"], ["station_key", "tod_from", "tod_to", "staff"]),
        section_rows(plan, "reinforcement", "day", [F.col("rank")], ["station_key", "tod_from", "tod_to", "df", "extra_total", "residual_total"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def incident_report(brief: DataFrame, findings: DataFrame, replay: DataFrame, event_totals: DataFrame, closure_facts: DataFrame) -> DataFrame:
    """The daily brief plus anomalies, alert replay, recorded impacts and lessons."""
    f = section_rows(findings, "anomaly", "day", [F.col("rank")], ["type", "where", "observed", "normal", "score"])
    r = section_rows(replay, "replay", "day", [F.col("rank")], ["station_key", "surge_fired", "plan_fired", "near_fired"])
    e = section_rows(event_totals, "event impact", "day", ["show_id"], ["show_id", "venue_key", "extra", "extra_share"])
    c = section_rows(closure_facts, "closure impact", "day", ["closure_id"], ["closure_id", "station_key", "lost", "recorded"])
    lesson = (
        F.when(F.col("near_fired").isNotNull() & (F.col("surge_fired") <= F.col("near_fired")), F.lit("surge alert came before the platform filled"))
        .when(F.col("near_fired").isNotNull(), F.lit("platform filled without an earlier surge alert"))
        .when(F.col("surge_fired").isNotNull(), F.lit("larger crowd than normal, below capacity"))
    )
    ls = section_rows(replay.withColumn("lesson", lesson).filter("lesson IS NOT NULL"), "lesson", "day", [F.col("rank")], ["station_key", "lesson"])
    out = brief
    for p in (f, r, e, c, ls):
        out = out.unionByName(p)
    return out


def closure_losses(risk: DataFrame, closures: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Passengers expected without the closure, recorded inside it and in the three slots after it."""
    from flowspark.operators.joins import after_reopening, closed_slots

    c = closed_slots(closures, clock).join(risk.select("station_key", "slot", "reading", "open_expected"), ["station_key", "slot"])
    g = c.groupBy("closure_id", "station_key").agg(F.sum("open_expected").alias("lost"), F.sum("reading").alias("recorded"), F.min("day").alias("day"))
    a = after_reopening(closures, 3, clock).join(risk.select("station_key", "slot", "reading"), ["station_key", "slot"])
    a = a.groupBy("closure_id", "station_key").agg(F.sum("reading").alias("recorded_after"))
    return g.join(a, ["closure_id", "station_key"], "left")


# -- station contingency ----------------------------------------------------------------------


def contingency_table(stations: DataFrame, edges: DataFrame, labels: DataFrame, fragmentation: DataFrame, levels: DataFrame, caps: DataFrame, closures: DataFrame, walk_km: float = 1.2, rail_km: float = 1.0) -> DataFrame:
    """What to do if a station closes, for every station: own and cut-off passengers, neighbours, walking and rail alternatives, past closures."""
    s = stations.select("station_key", "lat", "lon", "lines")
    o = stations.select(F.col("station_key").alias("other"), "lat", "lon", F.col("lines").alias("ol"))
    near = within_km(s, o, walk_km).filter("station_key <> other")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("station_key").orderBy("km", "other")))
    walk = near.filter("r <= 5").groupBy("station_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x.other).alias("walk_to"),
        F.min_by("other", F.when(F.size(F.array_except("ol", "lines")) > 0, F.col("r"))).alias("other_line_walk"),
    )
    hub = stations.filter("is_rail").select(F.col("station_key").alias("rail"), "lat", "lon")
    rail = within_km(s, hub, rail_km).groupBy("station_key").agg(F.min_by("rail", F.struct("km", "rail")).alias("rail"))
    adj = undirected(edges).groupBy(F.col("src").alias("station_key")).agg(F.array_sort(F.collect_set("dst")).alias("adjacent"))
    past = closures.select(F.explode("stations").alias("station_key")).groupBy("station_key").agg(F.count(F.lit(1)).alias("past_closures"))
    out = stations.select("station_key", "lines", "is_rail").join(levels, "station_key", "left").join(caps, "station_key", "left").join(fragmentation.drop("lost_share"), "station_key", "left")
    for x in (adj, walk, rail, past):
        out = out.join(x, "station_key", "left")
    return out.na.fill(0, ["past_closures"])


def station_info(stations: DataFrame, edges: DataFrame, levels: DataFrame, caps: DataFrame, profile: DataFrame, venues: DataFrame, shares: DataFrame, closures: DataFrame, radius_km: float = 1.0) -> DataFrame:
    """Facts about every station: lines, neighbours, walkable stations, ceiling, typical day, peaks, nearby venues, closures."""
    s = stations.select("station_key", "lat", "lon")
    o = stations.select(F.col("station_key").alias("other"), "lat", "lon")
    walk = within_km(s, o, radius_km).filter("station_key <> other").groupBy("station_key").agg(F.count(F.lit(1)).alias("walkable"))
    adj = undirected(edges).groupBy(F.col("src").alias("station_key")).agg(F.array_sort(F.collect_set("dst")).alias("adjacent"))
    v = within_km(venues, s, max(radius_km, 1.5)).select("venue_key", "station_key", "km").join(shares, ["venue_key", "station_key"], "left")
    v = v.groupBy("station_key").agg(F.count(F.lit(1)).alias("venues_nearby"), F.max(F.coalesce("share", F.lit(0.0))).alias("largest_share"))
    key = lambda c: F.struct("mean", -F.col("tod"))
    am, pm = F.col("tod").between(4, 20), F.col("tod").between(40, 60)
    pk = profile.groupBy("station_key").agg(
        F.max_by("tod", F.when(am, key(0))).alias("am_tod"), F.max(F.when(am, F.col("mean"))).alias("am_peak"),
        F.max_by("tod", F.when(pm, key(0))).alias("pm_tod"), F.max(F.when(pm, F.col("mean"))).alias("pm_peak"),
    )
    c = closures.select(F.explode("stations").alias("station_key")).groupBy("station_key").agg(F.count(F.lit(1)).alias("closures"))
    out = stations.select("station_key", "name", "lines").join(levels, "station_key", "left").join(caps, "station_key", "left")
    for x in (adj, walk, v, pk, c):
        out = out.join(x, "station_key", "left")
    return out.na.fill(0, ["walkable", "venues_nearby", "closures"]).na.fill(0.0, ["largest_share"])
