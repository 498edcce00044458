"""Expected intensity per slot and station, and the risk figures derived from it.

Everything is a lazy pipeline over long rows. Scenario columns named in ``keys`` travel with the
cells, events and closures, so many scenarios are evaluated in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, DEFAULT_PARAMS, Clock, ModelParams
from flowspark.functions import time as t
from flowspark.functions.noise import safe_corr, any_of, expected_reading, over_capacity, p_ceiling, quantile, weather_multiplier
from flowspark.model.fit import Fit
from flowspark.operators.joins import after_reopening, closed_slots, event_load
from flowspark.operators.weather import daily_temperature


def station_slots(slots: DataFrame, fit: Fit, stations: list[str] | None = None) -> DataFrame:
    """Every model station on every slot row, through an exploded station list (a model table, one entry per station)."""
    st = fit.stations.filter(F.col("station_key").isin(*stations)) if stations else fit.stations
    keys = st.agg(F.array_sort(F.collect_set("station_key")).alias("k")).scalar()
    return slots.withColumn("station_key", F.explode(keys))


def slot_weather(weather: DataFrame) -> DataFrame:
    """One row per slot: precipitation and the service day's mean temperature."""
    return weather.select("slot", "day", F.col("prcp").alias("_p")).join(daily_temperature(weather).withColumnRenamed("tday", "_t"), "day").drop("day")


def with_weather(cells: DataFrame, weather: DataFrame | None) -> DataFrame:
    """Attach tmean and prcp. Without a weather table the cells must carry both (a scenario).

    A slot the table does not cover is an error, not a guess.
    """
    if weather is None:
        return cells
    c = cells.drop("tmean", "prcp").join(slot_weather(weather), "slot", "left")
    missing = F.raise_error(F.lit("no weather for some slots: give a scenario with tmean and prcp"))
    ok = F.col("_p").isNotNull() & F.col("_t").isNotNull()
    return c.withColumn("prcp", F.when(ok, F.col("_p")).otherwise(missing.cast("double"))).withColumn("tmean", F.col("_t")).drop("_p", "_t")


def base_lambda(fit: Fit, cells: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """w * P * weather multiplier for arbitrary cells (station_key, slot, day, tod, daytype)."""
    p = fit.weather
    c = with_weather(cells.drop("ceiling"), weather).join(fit.stations, "station_key").join(fit.profile, ["daytype", "tod"])
    mult = weather_multiplier("tmean", "prcp", p["heat"], p["rain_max"], p["rain_scale"], p.get("t_ref", 18.0))
    return c.withColumn("base", F.col("w") * F.col("p") * mult).drop("w", "p")


def _intensity(fit, cells, weather, events, closures, params, clock, k) -> DataFrame:
    """Cells with base, load, closed and both rebounds (with and without event load), in one pass."""
    c = base_lambda(fit, cells, weather)
    load = event_load(events, fit.shares, params, clock, k) if events is not None else None

    def add_load(df: DataFrame) -> DataFrame:
        if load is None:
            return df.withColumn("load", F.lit(0.0))
        return df.join(load.withColumnRenamed("event_load", "load"), [*k, "station_key", "slot"], "left").withColumn("load", F.coalesce("load", F.lit(0.0)))

    c = add_load(c)
    if closures is None:
        return c.withColumn("closed", F.lit(False)).withColumn("rebound", F.lit(0.0)).withColumn("rebound0", F.lit(0.0))
    inside = closed_slots(closures, clock, k)
    if weather is None:
        scen = cells.select(*k, "slot", "tmean", "prcp").distinct()
        priced = base_lambda(fit, inside.join(scen, [*k, "slot"]))
    else:
        priced = base_lambda(fit, inside.join(weather.select("slot"), "slot", "left_semi"), weather)
    lost = add_load(priced).groupBy(*k, "closure_id", "station_key").agg(F.sum(F.col("base") + F.col("load")).alias("lost"), F.sum("base").alias("lost0"))
    frac = F.element_at(F.array(*[F.lit(float(f)) for f in params.rebound]), F.col("r") + 1)
    reb = after_reopening(closures, len(params.rebound), clock, k).join(lost, [*k, "closure_id", "station_key"])
    reb = reb.select(*k, "station_key", "slot", (frac * F.col("lost")).alias("rebound"), (frac * F.col("lost0")).alias("rebound0"), F.lit(0).alias("shut"))
    shut = inside.select(*k, "station_key", "slot", F.lit(0.0).alias("rebound"), F.lit(0.0).alias("rebound0"), F.lit(1).alias("shut"))
    eff = reb.unionByName(shut).groupBy(*k, "station_key", "slot").agg(F.sum("rebound").alias("rebound"), F.sum("rebound0").alias("rebound0"), (F.max("shut") == 1).alias("closed"))
    return c.join(eff, [*k, "station_key", "slot"], "left").na.fill(0.0, ["rebound", "rebound0"]).na.fill(False, ["closed"])


def _lam(extra) -> Column:
    return F.when(F.col("closed"), F.lit(0.0)).otherwise(F.col("base") + extra)


def expected(
    fit: Fit, cells: DataFrame, weather: DataFrame | None = None, events: DataFrame | None = None, closures: DataFrame | None = None,
    params: ModelParams = DEFAULT_PARAMS, clock: Clock = DEFAULT_CLOCK, keys=(),
) -> DataFrame:
    """Cells with base, event_load, closed and lam; ``closed`` cells have lam 0."""
    c = _intensity(fit, cells, weather, events, closures, params, clock, list(keys))
    return c.withColumn("lam", _lam(F.col("load") + F.col("rebound"))).withColumnRenamed("load", "event_load").drop("rebound", "rebound0")


def risk_table(
    fit: Fit, cells: DataFrame, weather=None, events=None, closures=None, params: ModelParams = DEFAULT_PARAMS, clock: Clock = DEFAULT_CLOCK, keys=(),
) -> DataFrame:
    """Cells with lam, lam0 (no events), p, over (demand above the ceiling), event_load (never negative) and both readings."""
    c = _intensity(fit, cells, weather, events, closures, params, clock, list(keys))
    c = c.withColumn("lam", _lam(F.col("load") + F.col("rebound"))).withColumn("lam0", _lam(F.col("rebound0"))).drop("load", "rebound", "rebound0")
    c = c.withColumn("event_load", F.greatest(F.col("lam") - F.col("lam0"), F.lit(0.0)))
    c = c.withColumn("p", p_ceiling("lam", "ceiling")).withColumn("over", over_capacity("lam", "ceiling"))
    return c.withColumn("expected", expected_reading("lam", "ceiling")).withColumn("expected0", expected_reading("lam0", "ceiling"))


def forecast(risk: DataFrame) -> DataFrame:
    """Ranges per cell: q10-q90, q5-q95, the normal q95, the chance of the ceiling, and whether the record fell inside."""
    r = risk
    for name, p in (("q10", 0.10), ("q90", 0.90), ("q05", 0.05), ("q95", 0.95)):
        r = r.withColumn(name, quantile("lam", "ceiling", p))
    r = r.withColumn("normal_q95", quantile("lam0", "ceiling", 0.95))
    if "reading" in r.columns:
        r = r.withColumn("inside_80", F.col("reading").between(F.col("q10"), F.col("q90")))
    return r


def capacity_risk(risk: DataFrame, by=("station_key",), sort_by: str | None = None, top: int | None = None) -> DataFrame:
    """Expected slots at the ceiling, chance of any, peak load ratio and demand above the ceiling."""
    ratio = F.try_divide("lam", "ceiling")
    g = risk.groupBy(*by).agg(
        F.sum("p").alias("exp_slots_at_ceiling"), any_of(F.col("p")).alias("p_any_slot_at_ceiling"), F.max(ratio).alias("peak_lambda_over_ceiling"),
        F.max_by("slot", F.struct(F.col("lam"), -t.slot_no("slot"))).alias("peak_slot"), F.sum("over").alias("exp_pax_above_ceiling"), F.first("ceiling").alias("ceiling"),
    )
    if sort_by:
        g = g.orderBy(F.col(sort_by).desc(), *by)
    return g.limit(top) if top else g


def explain(risk: DataFrame, stations: list[str] | None = None) -> DataFrame:
    """Per slot: observed, expected, base, total and chance at the ceiling, with the drivers named."""
    r = risk.filter(F.col("station_key").isin(*stations)) if stations else risk
    drivers = F.array_compact(
        F.array(
            F.when(F.col("closed"), F.lit("closure")), F.when(F.col("event_load") > 1, F.lit("event")),
            F.when(F.col("prcp") > 0.2, F.lit("rain")), F.when((~F.col("closed")) & (F.col("lam0") > F.col("base") + 1), F.lit("reopening")),
        )
    )
    return r.withColumn("drivers", drivers)


def window_table(risk: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Observed, normal and model totals with z per (window, station); ``windows`` has (key, station_key, slot)."""
    j = windows.join(risk.select("station_key", "slot", "reading", "expected", "expected0", "p"), ["station_key", "slot"])
    return z_columns(j.groupBy(key, "station_key").agg(*window_sums()))


def compare_to_model(risk: DataFrame, by: tuple[str, ...] = ("station_key", "day")) -> DataFrame:
    """Observed totals against the model with and without events, as ratios, and the part of the model's total that events make."""
    g = risk.groupBy(*by).agg(F.sum("reading").alias("observed"), F.sum("expected").alias("model"), F.sum("expected0").alias("without_events"))
    return g.select(
        "*", F.try_divide("observed", "model").alias("vs_model"), F.try_divide("observed", "without_events").alias("vs_without_events"),
        F.try_divide(F.col("model") - F.col("without_events"), F.col("model")).alias("event_part"),
    )


def window_sums() -> list:
    return [
        F.sum("reading").alias("observed"), F.sum("expected0").alias("normal"), F.sum("expected").alias("model"),
        F.sum(F.col("expected0") * F.col("expected0")).alias("var"),
    ]


def z_columns(g: DataFrame) -> DataFrame:
    g = g.withColumn("excess", F.col("observed") - F.col("normal"))
    return g.withColumn("z", F.col("excess") / F.sqrt(F.col("var") + 1)).drop("var")


def band_coverage(fc: DataFrame, min_level: float = 5.0) -> DataFrame:
    """Share of readings inside the 80 % and 90 % ranges, and above the upper 95 % bound."""
    f = fc.filter(F.col("lam") > min_level)
    d = lambda c: F.avg(c.cast("double"))
    return f.agg(
        d(F.col("reading").between(F.col("q10"), F.col("q90"))).alias("inside_80"),
        d(F.col("reading").between(F.col("q05"), F.col("q95"))).alias("inside_90"), d(F.col("reading") > F.col("q95")).alias("above_95"),
    )


def calibration_by_day(risk: DataFrame) -> DataFrame:
    g = risk.groupBy("day").agg(F.sum("reading").alias("observed"), F.sum("expected").alias("expected"))
    return g.withColumn("ratio", F.try_divide("observed", "expected"))


def calibration_by_station(risk: DataFrame) -> DataFrame:
    g = risk.groupBy("station_key").agg(F.sum("reading").alias("observed"), F.sum("expected").alias("expected"))
    return g.withColumn("ratio", F.try_divide("observed", "expected"))


def far_station_days(risk: DataFrame, min_expected: float = 2000.0, top: int = 6) -> DataFrame:
    """Station-days furthest from the model on the log scale."""
    g = risk.groupBy("station_key", "day").agg(F.sum("reading").alias("observed"), F.sum("expected").alias("expected"))
    g = g.filter((F.col("expected") > min_expected) & (F.col("observed") > 0)).withColumn("ratio", F.try_divide("observed", "expected"))
    return g.orderBy(F.abs(F.log("ratio")).desc(), "station_key", "day").limit(top)


def backtest(risk: DataFrame) -> DataFrame:
    """Fit quality in one row: ratios, ceiling hits, correlations and the daily error in percent."""
    hit = F.col("reading") >= F.col("ceiling")
    crowd = F.col("event_load") > 50
    part = lambda c: F.sum(F.when(crowd, F.col(c)))
    tot = risk.agg(
        F.try_divide(F.sum("reading"), F.sum("expected")).alias("total_ratio"), F.try_divide(part("reading"), part("expected")).alias("event_ratio"),
        F.sum("p").alias("ceiling_expected"), F.count_if(hit).alias("ceiling_observed"),
    )
    hr = risk.groupBy(F.hour("slot").alias("h")).agg(F.try_divide(F.sum("reading"), F.sum("expected")).alias("r")).filter("h > 0")
    hr = hr.agg(F.min("r").alias("hour_ratio_min"), F.max("r").alias("hour_ratio_max"))
    stn = risk.groupBy("station_key").agg(F.sum("p").alias("e"), F.count_if(hit).alias("o")).agg(safe_corr("e", "o").alias("ceiling_corr"))
    day = calibration_by_day(risk).agg(
        safe_corr("observed", "expected").alias("daily_corr"), (F.avg(F.try_divide(F.abs(F.col("observed") - F.col("expected")), F.col("observed"))) * 100).alias("daily_error_pct")
    )
    for other in (hr, stn, day):
        for c in other.columns:
            tot = tot.withColumn(c, other.select(c).scalar())
    return tot


def replay_frames(risk: DataFrame, marker: tuple = (6.0, 18.0, 600.0)) -> DataFrame:
    """Per cell: log2 of recorded over normal clipped to [-2, 3], marker size and the chance of the ceiling."""
    ratio = F.log2((F.col("reading") + 1) / (F.col("expected0") + 1))
    lo, span, ref = marker
    return risk.withColumn("log_ratio", F.greatest(F.lit(-2.0), F.least(F.lit(3.0), ratio))).withColumn(
        "size", lo + span * F.sqrt(F.greatest(F.col("reading"), F.lit(0)) / ref)
    )


def event_phase(at, start="start", end="end"):
    """arrivals, in progress or departures at a moment; null outside."""
    at, s, e = (F.col(c) if isinstance(c, str) else c for c in (at, start, end))
    return (
        F.when((at >= s - t.minutes(90)) & (at <= s + t.minutes(15)), "arrivals").when((at > s) & (at < e), "in progress")
        .when((at >= e) & (at <= e + t.minutes(120)), "departures")
    )


def snapshot(risk: DataFrame, top: int = 10) -> DataFrame:
    """Largest deviations from normal in each slot of ``risk`` (filter the slots first)."""
    r = risk.withColumn("above_normal", F.col("reading") - F.round("expected0")).withColumn(
        "ratio", F.round(F.col("reading") / F.greatest(F.round("expected0"), F.lit(1.0)), 1)
    )
    w = Window.partitionBy("slot").orderBy(F.col("above_normal").desc(), "station_key")
    return r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def snapshot_phases(slots: DataFrame, events: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Events in a phase at each requested slot: events are exploded into the slots they can touch."""
    from flowspark.operators.grid import window_spine

    e = events.withColumn("s0", F.col("start")).withColumn("e0", F.col("end"))
    e = e.withColumn("start", F.col("s0") - t.minutes(90)).withColumn("end", F.col("e0") + t.minutes(120))
    x = window_spine(e, clock).join(slots.select("slot").distinct(), "slot", "left_semi")
    return x.withColumn("phase", event_phase("slot", "s0", "e0")).filter("phase IS NOT NULL").select("slot", "crowd_id", "venue_key", "attendance", "phase")
