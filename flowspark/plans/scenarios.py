"""What-if scenarios evaluated together: weather, diversion and line suspension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, DEFAULT_PARAMS, Clock, ModelParams
from flowspark.functions import time as t
from flowspark.functions.noise import any_of, expected_reading, over_capacity, p_ceiling
from flowspark.model.expect import base_lambda
from flowspark.model.fit import Fit, rule_shares
from flowspark.operators.closures import section_roles, walk_alternatives
from flowspark.operators.events import shows
from flowspark.operators.grid import window_spine
from flowspark.operators.joins import kernel_load, within_km


def resolve_weather(cells: DataFrame, weather: DataFrame, default_tmean: float = 16.0, default_prcp: float = 0.0) -> DataFrame:
    """Recorded weather where it exists, else a default dry day: cells with tmean, prcp and in_data."""
    from flowspark.operators.weather import daily_temperature

    c = cells.join(weather.select("slot", "prcp"), "slot", "left").join(daily_temperature(weather), "day", "left")
    known = F.col("prcp").isNotNull() & F.col("tday").isNotNull()
    c = c.withColumn("in_data", known).withColumn("tmean", F.when(known, F.col("tday")).otherwise(F.lit(default_tmean)))
    return c.withColumn("prcp", F.when(known, F.col("prcp")).otherwise(F.lit(default_prcp))).drop("tday")


def scenario_cells(cells: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every cell under every scenario (scenario_id, tmean, prcp): the scenario list travels as one array."""
    arr = scenarios.agg(F.array_sort(F.collect_list(F.struct("scenario_id", "tmean", "prcp")))).scalar()
    c = cells.withColumn("_s", F.explode(arr))
    return c.select("*", "_s.*").drop("_s")


def scenario_events(events: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Recorded events repeated under every scenario; add scenario-only events with unionByName."""
    ids = scenarios.agg(F.collect_list("scenario_id")).scalar()
    return events.withColumn("scenario_id", F.explode(ids))


def scenario_summary(risk: DataFrame) -> DataFrame:
    """Per scenario and day: expected passengers, demand above capacity, stations likely at the ceiling."""
    per = risk.groupBy("scenario_id", "day", "station_key").agg(F.sum("expected").alias("e"), F.sum("over").alias("o"), F.max("p").alias("p"))
    return per.groupBy("scenario_id", "day").agg(
        F.sum("e").alias("expected_passengers"), F.sum("o").alias("above_capacity"), F.count_if(F.col("p") >= 0.5).alias("stations_likely_at_ceiling")
    )


def compare_scenarios(risk: DataFrame, base_id: str, top: int = 10) -> DataFrame:
    """Stations that change most against one scenario, per day and scenario."""
    per = risk.groupBy("scenario_id", "day", "station_key").agg(F.sum("expected").alias("e"), F.sum("over").alias("o"), F.max("p").alias("p"))
    b = per.filter(F.col("scenario_id") == base_id).select("day", "station_key", F.col("e").alias("e0"), F.col("o").alias("o0"), F.col("p").alias("p0"))
    j = per.filter(F.col("scenario_id") != base_id).join(b, ["day", "station_key"])
    j = j.withColumn("passengers_change", F.col("e") - F.col("e0")).withColumn("above_capacity_change", F.col("o") - F.col("o0"))
    score = F.round(F.abs("above_capacity_change") + 0.02 * F.abs("passengers_change"), 6)
    w = Window.partitionBy("scenario_id", "day").orderBy(score.desc(), "station_key")
    j = j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    j = j.filter((F.abs("passengers_change") >= 1) | (F.abs("above_capacity_change") >= 1))
    return j.select("scenario_id", "day", "rank", "station_key", "passengers_change", "above_capacity_change", F.col("p0").alias("p_base"), F.col("p").alias("p_scenario"))


# -- diversion --------------------------------------------------------------------------------


def diversion_stations(venues: DataFrame, stations: DataFrame, shares: DataFrame, max_km: float = 2.6) -> DataFrame:
    """Per venue up to two nearest stations of the closest line that shares none with the venue's main stations."""
    st = stations.select("station_key", "lat", "lon", "lines")
    main = shares.filter("share >= 0.1").join(st.select("station_key", F.explode("lines").alias("line")), "station_key").select("venue_key", "line").distinct()
    near = within_km(venues, st, max_km).select("venue_key", "station_key", "km", F.explode("lines").alias("line"))
    home = shares.select("venue_key", "station_key")
    hit = near.join(main, ["venue_key", "line"], "left_semi").select("venue_key", "station_key").distinct()
    cand = near.join(home, ["venue_key", "station_key"], "left_anti").join(hit, ["venue_key", "station_key"], "left_anti")
    best = cand.groupBy("venue_key").agg(F.min_by("line", F.struct("km", "line")).alias("line"))
    c = cand.join(best, ["venue_key", "line"])
    w = Window.partitionBy("venue_key").orderBy("km", "station_key")
    return c.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("venue_key", "station_key", "km", "line")


def diversion(fit: Fit, events: DataFrame, venues: DataFrame, stations: DataFrame, weather: DataFrame, max_km: float = 2.6, params: ModelParams = DEFAULT_PARAMS, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Peak demand over ceiling in the exit wave of every show for diverted shares 0, 5 ... 60 %.

    Part of the crowd uses the stations around the middle of the alternatives instead of the
    venue's own. Rows: (show_id, station_key, is_alternative, share_pct, peak_ratio).
    """
    alts = diversion_stations(venues, stations, fit.shares, max_km)
    pos = alts.join(stations.select("station_key", "lat", "lon"), "station_key").groupBy("venue_key").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    away = rule_shares(pos, stations, params).select("venue_key", "station_key", F.col("share").alias("away"))
    split = fit.shares.join(away, ["venue_key", "station_key"], "full").na.fill(0.0, ["share", "away"])
    watch = fit.shares.select("venue_key", "station_key").unionByName(alts.select("venue_key", "station_key")).distinct()
    split = watch.join(split, ["venue_key", "station_key"], "left").na.fill(0.0, ["share", "away"])
    split = split.join(alts.select("venue_key", "station_key", F.lit(True).alias("is_alternative")), ["venue_key", "station_key"], "left").na.fill(False, ["is_alternative"])
    s = shows(events)
    s = s.join(alts.select("venue_key").distinct(), "venue_key", "left_semi")
    load = kernel_load(s.withColumnRenamed("show_id", "crowd_id"), params, clock).groupBy(F.col("crowd_id").alias("show_id"), "slot").agg(F.sum("load").alias("load"))
    w = s.select("show_id", "venue_key", (F.col("end") - t.minutes(15)).alias("start"), (F.col("end") + t.minutes(120)).alias("end"))
    cells = window_spine(w, clock).join(weather.select("slot"), "slot", "left_semi").join(split, "venue_key")
    b = base_lambda(fit, cells, weather).join(load, ["show_id", "slot"], "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
    b = b.withColumn("share_pct", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(5))))
    x = F.col("share_pct") / 100
    lam = F.col("base") + F.col("load") * ((1 - x) * F.col("share") + x * F.col("away"))
    return b.withColumn("lam", lam).groupBy("show_id", "station_key", "is_alternative", "share_pct").agg(F.round(F.max(F.try_divide("lam", "ceiling")), 2).alias("peak_ratio"))


def capacity_limited_share(table: DataFrame) -> DataFrame:
    """Largest diverted share that keeps every alternative at or below its ceiling (0 if none does)."""
    ok = table.filter("is_alternative").groupBy("show_id", "share_pct").agg(F.max("peak_ratio").alias("worst"))
    return ok.groupBy("show_id").agg(F.coalesce(F.max(F.when(F.col("worst") <= 1.0, F.col("share_pct"))), F.lit(0)).alias("share_pct"))


# -- suspension -------------------------------------------------------------------------------


def displacement(parsed: DataFrame, stations: DataFrame, walk_km: float = 1.2) -> DataFrame:
    """(closure_id, donor, receiver, weight): interior stations left without a line walk to up to four alternatives."""
    roles = section_roles(parsed).filter("role = 'interior'").join(stations.select("station_key", "lines"), "station_key")
    donors = roles.filter(F.size(F.array_except("lines", F.array("line"))) == 0).select("closure_id", "station_key")
    alt = walk_alternatives(parsed, stations, walk_km).join(donors, ["closure_id", "station_key"], "left_semi")
    wt = 1 / F.greatest(F.col("km"), F.lit(0.2))
    w = Window.partitionBy("closure_id", "station_key")
    return alt.select("closure_id", F.col("station_key").alias("donor"), F.col("other").alias("receiver"), (wt / F.sum(wt).over(w)).alias("weight"))


def suspension_scenario(risk: DataFrame, parsed: DataFrame, stations: DataFrame, minutes: int | None = None, displaced_share: float = 1.0, walk_km: float = 1.2, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Risk at section ends, kept interchanges and receivers: as in the data and with displaced passengers.

    Each suspension is judged over its own window, or over ``minutes`` from its start.
    """
    disp = displacement(parsed, stations, walk_km)
    roles = section_roles(parsed)
    donors = disp.select("closure_id", F.col("donor").alias("station_key")).distinct()
    lone = roles.filter("role = 'interior'").join(stations.select("station_key", "lines"), "station_key").filter(F.size(F.array_except("lines", F.array("line"))) == 0)
    watch = roles.join(lone.select("closure_id", "station_key"), ["closure_id", "station_key"], "left_anti").select("closure_id", "station_key")
    watch = watch.unionByName(disp.select("closure_id", F.col("receiver").alias("station_key"))).distinct()
    hi = F.col("start") + t.minutes(minutes) if minutes else F.col("end")
    win = window_spine(parsed.filter(F.size("stations") > 0).select("closure_id", "start", hi.alias("end")), clock, inclusive=minutes is not None).select("closure_id", "slot")
    lam = risk.select("station_key", "slot", "lam", "ceiling")
    own = win.join(watch, "closure_id").join(lam, ["station_key", "slot"])
    give = win.join(disp, "closure_id").join(lam.select(F.col("station_key").alias("donor"), "slot", F.col("lam").alias("dl")), ["donor", "slot"])
    give = give.groupBy("closure_id", F.col("receiver").alias("station_key"), "slot").agg((displaced_share * F.sum(F.col("weight") * F.col("dl"))).alias("moved"))
    j = own.join(give, ["closure_id", "station_key", "slot"], "left").withColumn("plan", F.col("lam") + F.coalesce("moved", F.lit(0.0)))
    return j.groupBy("closure_id", "station_key").agg(
        F.avg("lam").alias("lambda_mean"), F.max(p_ceiling("lam", "ceiling")).alias("p_max"), any_of(p_ceiling("lam", "ceiling")).alias("p_any"),
        F.avg("plan").alias("plan_mean"), F.max(p_ceiling("plan", "ceiling")).alias("plan_p_max"), any_of(p_ceiling("plan", "ceiling")).alias("plan_p_any"),
    )
