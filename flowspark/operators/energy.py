"""Energy per line against ridership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock
from flowspark.functions import time as t
from flowspark.functions.geo import haversine_km

RULES = ("equal_split", "first_line", "full_count")


def line_weights(stations: DataFrame) -> DataFrame:
    """(rule, station_key, line, weight) for the three ways to assign an interchange."""
    s = stations.select("station_key", F.posexplode("lines").alias("pos", "line"), F.size("lines").alias("n"))
    w = F.array(
        F.struct(F.lit("equal_split").alias("rule"), (1 / F.col("n")).alias("weight")),
        F.struct(F.lit("first_line").alias("rule"), (F.col("pos") == 0).cast("double").alias("weight")),
        F.struct(F.lit("full_count").alias("rule"), F.lit(1.0).alias("weight")),
    )
    return s.select("station_key", "line", F.explode(w).alias("x")).select("x.rule", "station_key", "line", "x.weight").filter("weight > 0")


def line_riders(daily: DataFrame, stations: DataFrame, rule: str = "full_count") -> DataFrame:
    """Daily riders per line under one allocation rule."""
    w = line_weights(stations).filter(F.col("rule") == rule)
    return daily.join(w, "station_key").groupBy("day", "line").agg(F.sum(F.col("riders") * F.col("weight")).alias("riders"))


def usable_days(daily: DataFrame, energy: DataFrame, min_stations: int) -> DataFrame:
    """Days with enough counters that also have energy readings."""
    d = daily.groupBy("day").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_stations).select("day")
    return d.join(energy.select("day").distinct(), "day")


def efficiency_ranking(daily: DataFrame, energy: DataFrame, stations: DataFrame, min_stations: int = 1) -> DataFrame:
    """MWh per 1000 riders per line under all three rules, in one job, with ranks and the gap to the next line."""
    days = usable_days(daily, energy, min_stations)
    d = daily.join(days, "day", "left_semi").groupBy("station_key").agg(F.sum("riders").alias("riders"))
    pax = d.join(line_weights(stations), "station_key").groupBy("rule", "line").agg(
        F.sum(F.col("riders") * F.col("weight")).alias("pax"), F.count(F.lit(1)).alias("stations")
    )
    e = energy.join(days, "day", "left_semi").groupBy("line").agg(F.sum("mwh").alias("mwh"))
    r = pax.join(e, "line").filter("pax > 0").withColumn("mwh_per_1000", F.col("mwh") / (F.col("pax") / 1000))
    w = Window.partitionBy("rule").orderBy(F.col("mwh_per_1000").desc(), "line")
    return r.withColumn("rank", F.row_number().over(w)).withColumn(
        "gap_pct", (F.col("mwh_per_1000") / F.lead("mwh_per_1000").over(w) - 1) * 100
    )


def line_days(daily: DataFrame, energy: DataFrame, stations: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """(day, line, mwh, riders, daytype): energy joined to full-count ridership."""
    return energy.join(line_riders(daily, stations), ["day", "line"]).withColumn("daytype", t.day_type("day", clock))


def energy_model(days: DataFrame, min_days: int = 5) -> DataFrame:
    """Least squares of daily MWh on ridership per line: b0, b1 and the residual spread (ddof 0)."""
    m = days.groupBy("line").agg(
        F.regr_slope("mwh", "riders").alias("b1"), F.regr_intercept("mwh", "riders").alias("b0"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") > min_days)
    r = days.join(m, "line").withColumn("resid", F.col("mwh") - (F.col("b0") + F.col("b1") * F.col("riders")))
    return r.groupBy("line").agg(
        F.first("b0").alias("b0"), F.first("b1").alias("b1"), F.first("n").alias("n"), F.stddev_pop("resid").alias("sd")
    )


def energy_stats(days: DataFrame, model: DataFrame, day_class: str = "all", date_from=None, date_to=None) -> DataFrame:
    """Totals, extremes and the most unusual day per line."""
    d = days.filter(t.day_mask("day", "daytype", day_class, date_from, date_to)).join(model, "line")
    d = d.withColumn("resid", F.col("mwh") - (F.col("b0") + F.col("b1") * F.col("riders"))).withColumn("o", F.unix_date("day"))
    return d.groupBy("line").agg(
        F.count(F.lit(1)).alias("days"), F.sum("mwh").alias("total_mwh"), F.avg("mwh").alias("mean_mwh"), F.sum("riders").alias("riders"),
        (F.sum("mwh") * 1000 / F.sum("riders")).alias("kwh_per_passenger"),
        F.max_by("day", F.struct("mwh", -F.col("o"))).alias("highest_day"), F.min_by("day", F.struct("mwh", "o")).alias("lowest_day"),
        F.avg("resid").alias("mean_gap"), F.max_by("day", F.struct(F.abs("resid"), -F.col("o"))).alias("unusual_day"), F.first("sd").alias("sd"),
    )


def line_lengths(line_stops: DataFrame, stations: DataFrame) -> DataFrame:
    """Straight-line length of each line along its stops."""
    s = line_stops.join(stations.select("station_key", "lat", "lon"), "station_key")
    w = Window.partitionBy("line").orderBy("seq")
    s = s.withColumn("plat", F.lag("lat").over(w)).withColumn("plon", F.lag("lon").over(w))
    return s.groupBy("line").agg(F.sum(haversine_km("plat", "plon", "lat", "lon")).alias("km"), F.count(F.lit(1)).alias("stations"))


def energy_efficiency(days: DataFrame, split: DataFrame, lengths: DataFrame) -> DataFrame:
    """Fixed and per-passenger energy, density, weekday and weekend figures per line.

    ``split`` holds the ridership under equal split (day, line, riders).
    """
    wk, we = F.col("daytype") == 0, F.col("daytype") > 0
    kwh = lambda c: F.sum(F.when(c, F.col("mwh"))) * 1000 / F.sum(F.when(c, F.col("riders")))
    sp = split.select("day", "line", F.col("riders").alias("split_riders"))
    g = days.join(sp, ["day", "line"]).groupBy("line").agg(
        (F.sum("mwh") * 1000 / F.sum("riders")).alias("kwh_per_passenger"),
        (F.sum("mwh") * 1000 / F.sum("split_riders")).alias("kwh_split"),
        F.avg("mwh").alias("mwh_day"), F.avg("riders").alias("riders_day"),
        F.regr_intercept("mwh", "riders").alias("fixed_mwh"), (F.regr_slope("mwh", "riders") * 1e6).alias("marginal_wh"),
        kwh(wk).alias("kwh_weekday"), kwh(we).alias("kwh_weekend"),
        (F.avg(F.when(we, F.col("riders"))) / F.avg(F.when(wk, F.col("riders")))).alias("weekend_ratio"),
        F.sum("mwh").alias("mwh"), F.sum("riders").alias("riders"), F.count(F.lit(1)).alias("n"), F.count_if(we).alias("n_weekend"),
    )
    g = g.join(lengths, "line")
    return (
        g.withColumn("riders_per_km", F.col("riders_day") / F.col("km")).withColumn("mwh_per_km", F.col("mwh_day") / F.col("km"))
        .withColumn("fixed_share", F.col("fixed_mwh") / F.col("mwh_day"))
    )


def efficiency_correlations(eff: DataFrame) -> DataFrame:
    return eff.agg(
        F.corr("kwh_per_passenger", "riders_per_km").alias("kwh_vs_density"), F.corr("fixed_mwh", "km").alias("fixed_vs_length")
    )


def interventions(eff: DataFrame) -> DataFrame:
    """Four what-if measures on the line with the highest energy per passenger, one row each."""
    med = eff.agg(F.median("riders_per_km").alias("m"))
    w = eff.orderBy(F.col("kwh_per_passenger").desc(), "line").limit(1)
    b0, b1 = F.col("fixed_mwh"), F.col("marginal_wh") / 1e6
    base = F.col("mwh") / F.col("riders")
    x = med.scalar() * F.col("km") / F.col("riders_day") - 1
    after = {
        "cut_fixed_energy_10pct": (F.col("mwh") - 0.1 * b0 * F.col("n")) / F.col("riders"),
        "ridership_plus_10pct": (F.col("mwh") + 0.1 * b1 * F.col("riders")) / (F.col("riders") * 1.1),
        "weekend_service_matched": (F.col("mwh") - b0 * (1 - F.col("weekend_ratio")) * F.col("n_weekend")) / F.col("riders"),
        "reach_median_density": (F.col("mwh") + b1 * F.col("riders") * x) / (F.col("riders") * (1 + x)),
    }
    arr = F.array(*[F.struct(F.lit(k).alias("measure"), (v * 1000).alias("kwh_after"), ((v / base - 1) * 100).alias("change_pct")) for k, v in after.items()])
    return w.select("line", (base * 1000).alias("kwh_before"), F.explode(arr).alias("m")).select("line", "kwh_before", "m.*")
