"""Weather summaries and the measured effect of rain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions import time as t
from flowspark.functions.noise import weather_multiplier
from flowspark.operators.stats import calendar, first_argmax, full_calendar_days

# Labels of the public weather condition codes.
CONDITIONS = {
    1: "Clear sky", 2: "Partly cloudy", 3: "Cloudy", 4: "Overcast", 5: "Fog", 6: "Freezing fog", 7: "Light rain",
    8: "Rain", 9: "Heavy rain", 10: "Freezing rain", 11: "Heavy freezing rain", 12: "Sleet", 13: "Heavy sleet",
    14: "Light snowfall", 15: "Snowfall", 16: "Heavy snowfall", 17: "Rain shower", 18: "Heavy rain shower",
    19: "Sleet shower", 20: "Heavy sleet shower", 21: "Snow shower", 22: "Heavy snow shower", 23: "Lightning",
    24: "Hail", 25: "Thunderstorm", 26: "Heavy thunderstorm", 27: "Storm",
}
RAIN_CLASSES = (("light", 0.1, 2.5), ("moderate", 2.5, 10.0), ("heavy", 10.0, float("inf")))


def condition_label(code) -> Column:
    m = F.create_map(*[x for k, v in CONDITIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.round(code).cast("int")), F.lit("Unknown"))


def daily_temperature(weather: DataFrame) -> DataFrame:
    """Mean of the on-the-hour temperatures per service day."""
    return weather.filter(F.minute("slot") == 0).groupBy("day").agg(F.avg("temp").alias("tday"))


def weather_table(weather: DataFrame, params: dict, by: str = "day") -> DataFrame:
    """Weather per service day or hour with the flow multiplier the model attributes to it."""
    w = weather.join(daily_temperature(weather), "day")
    w = w.withColumn("multiplier", weather_multiplier("tday", "prcp", params["heat"], params["rain_max"], params["rain_scale"]))
    if by == "hour":
        return w.groupBy(t.hour_floor("slot").alias("hour")).agg(
            F.avg("temp").alias("temp"), F.avg("prcp").alias("rain_mm_h"), F.avg("wspd").alias("wind_kmh"),
            F.max("coco").alias("condition_code"), F.avg("multiplier").alias("multiplier"),
        )
    return w.groupBy("day").agg(
        F.avg("temp").alias("temp_mean"), F.min("temp").alias("temp_min"), F.max("temp").alias("temp_max"),
        (F.sum("prcp") / 4).alias("rain_mm"), F.max("prcp").alias("max_rain_mm_h"), F.max("wspd").alias("wind_max"),
        F.max("coco").alias("condition_code"), F.avg("multiplier").alias("multiplier"),
    )


def weather_window(weather: DataFrame, hour_from=0, hour_to=24) -> DataFrame:
    """Calendar-day summary in an hour window, with the most frequent condition (smallest on ties)."""
    c = weather.withColumn("cday", F.to_date("slot")).filter(t.hour_window("slot", hour_from, hour_to))
    c = c.withColumn("code", F.round("coco").cast("int"))
    counts = c.groupBy("cday", "code").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy("cday").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("code"))
    a = c.groupBy("cday").agg(
        F.avg("temp").alias("temp_mean"), F.min("temp").alias("temp_min"), F.max("temp").alias("temp_max"),
        (F.sum("prcp") / 4).alias("rain_mm"), F.max("prcp").alias("max_rate"), F.avg("wspd").alias("wind_mean"),
    )
    return a.join(mode, "cday").withColumn("condition", condition_label("code"))


def weather_outliers(weather: DataFrame, metric: str = "prcp") -> DataFrame:
    """Strongest value of a metric in each Monday week, with its z-score against the whole series."""
    if metric not in ("prcp", "temp", "wspd"):
        raise ValueError("metric must be prcp, temp or wspd")
    w = weather.withColumn("week", F.date_sub(F.to_date("slot"), F.weekday("slot")))
    tot = weather.agg(F.avg(metric).alias("m"), F.stddev_samp(metric).alias("s"))
    g = w.groupBy("week").agg(F.max(metric).alias("value"), first_argmax("slot", metric, t.slot_no("slot")).alias("slot"), F.avg(metric).alias("week_mean"))
    mean, sd = tot.select("m").scalar(), tot.select("s").scalar()
    return g.withColumn("z", F.when(sd > 0, (F.col("value") - mean) / sd).otherwise(F.lit(0.0)))


def rain_hours(cells: DataFrame, weather: DataFrame, dry_max: float = 0.1, min_hours: int = 3) -> DataFrame:
    """Network sum of every operating hour against dry hours of the same hour and day class."""
    net = full_calendar_days(cells).groupBy(t.hour_floor("slot").alias("hour")).agg(F.sum("reading").alias("flow"))
    rate = weather.groupBy(t.hour_floor("slot").alias("hour")).agg(F.avg("prcp").alias("prcp"))
    h = net.join(rate, "hour").filter("flow > 0")
    h = h.withColumn("hr", F.hour("hour")).withColumn("weekend", F.weekday("hour") >= 5)
    base = h.filter(F.col("prcp") < dry_max).groupBy("weekend", "hr").agg(F.avg("flow").alias("expected"), F.count(F.lit(1)).alias("n"))
    h = h.join(base.filter(F.col("n") >= min_hours).drop("n"), ["weekend", "hr"])
    return h.withColumn("diff_pct", (F.col("flow") - F.col("expected")) / F.col("expected") * 100)


def rain_impact(hours: DataFrame, dry_max: float = 0.1) -> DataFrame:
    """Mean and median change per rain class, plus the dry control."""
    cls = F.when(F.col("prcp") < dry_max, "dry")
    for name, lo, hi in RAIN_CLASSES:
        cls = cls.when((F.col("prcp") >= lo) & (F.col("prcp") < hi), name)
    return hours.groupBy(cls.alias("rain_class")).agg(
        F.count(F.lit(1)).alias("hours"), F.avg("diff_pct").alias("mean_change_pct"), F.median("diff_pct").alias("median_change_pct")
    )


def wettest_hours(hours: DataFrame, top: int = 5) -> DataFrame:
    return hours.filter(F.col("prcp") >= 0.1).orderBy(F.col("prcp").desc(), "hour").limit(top)


def peak_vs_dry(cells: DataFrame, weather: DataFrame, dry_max: float = 0.1) -> DataFrame:
    """Daily peak slot of every station against the median of the same slot on other same weekdays.

    Only days whose hour was dry count; without any, all other same weekdays do.
    """
    c = calendar(cells)
    peak = c.groupBy("station_key", "cday", "wd").agg(
        F.max("reading").alias("peak"), first_argmax("slot", "reading", t.slot_no("slot")).alias("slot")
    ).withColumn("m", F.hour("slot") * 60 + F.minute("slot"))
    hourly = weather.groupBy(t.hour_floor("slot").alias("hour")).agg(F.avg("prcp").alias("rate"))
    cand = c.select("station_key", F.col("cday").alias("oday"), "wd", (F.hour("slot") * 60 + F.minute("slot")).alias("m"), "reading", t.hour_floor("slot").alias("hour"))
    cand = cand.join(hourly, "hour", "left")
    j = peak.join(cand, ["station_key", "wd", "m"]).filter("oday <> cday")
    dry = F.coalesce(F.col("rate"), F.lit(0.0)) < dry_max
    g = j.groupBy("station_key", "cday", "peak", "slot").agg(
        F.median(F.when(dry, F.col("reading"))).alias("dry_median"), F.median("reading").alias("all_median"), F.count_if(dry).alias("dry_days")
    )
    g = g.withColumn("baseline", F.coalesce("dry_median", "all_median"))
    return g.withColumn("change_pct", F.when(F.col("baseline") > 0, (F.col("peak") / F.col("baseline") - 1) * 100))
