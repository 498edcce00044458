"""Descriptive statistics over counter cells (station_key, slot, day, tod, daytype, reading).

Every aggregate is two-level where the semantics allow it: cells are first reduced per
(group, slot) or (group, day) with map-side partial sums, then summarised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock
from flowspark.functions import time as t

STATS = {"sum": F.sum, "mean": F.avg, "median": F.median, "max": F.max}


def first_argmax(label: str, value, order) -> Column:
    """Label of the largest value; ties go to the smallest numeric ``order``."""
    value = F.col(value) if isinstance(value, str) else value
    order = F.col(order) if isinstance(order, str) else order
    return F.max_by(label, F.struct(value, -order))


def first_argmin(label: str, value, order) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    order = F.col(order) if isinstance(order, str) else order
    return F.min_by(label, F.struct(value, order))


def calendar(cells: DataFrame) -> DataFrame:
    """Calendar-day columns of the tool family: cday, hr, wd (Monday 0)."""
    return (
        cells.withColumn("cday", F.to_date("slot")).withColumn("hr", F.hour("slot")).withColumn("wd", F.weekday("slot"))
    )


def full_calendar_days(cells: DataFrame, min_slots: int = 80) -> DataFrame:
    """Cells of the calendar days on which at least ``min_slots`` slots were recorded."""
    c = calendar(cells)
    full = c.select("cday", "slot").distinct().groupBy("cday").count().filter(F.col("count") >= min_slots).select("cday")
    return c.join(full, "cday", "left_semi")


def scope(cells: DataFrame, stations=None, line=None, line_stops: DataFrame | None = None) -> DataFrame:
    """Cells of a station list, of a line, or of the whole network."""
    if stations:
        return cells.filter(F.col("station_key").isin(*stations))
    if line:
        return cells.join(line_stops.filter(F.col("line") == line).select("station_key"), "station_key", "left_semi")
    return cells


def ceilings(cells: DataFrame) -> DataFrame:
    """Highest reading ever seen per station."""
    return cells.groupBy("station_key").agg(F.max("reading").alias("ceiling"))


def window_cells(cells: DataFrame, start=None, end=None) -> DataFrame:
    """Half-open absolute window; the derived day bound lets partitioned tables prune."""
    if start:
        cells = cells.filter(
            (F.col("slot") >= F.lit(start).cast("timestamp_ntz"))
            & (F.col("day") >= F.date_sub(F.lit(start).cast("timestamp_ntz").cast("date"), 1))
        )
    if end:
        cells = cells.filter(
            (F.col("slot") < F.lit(end).cast("timestamp_ntz")) & (F.col("day") <= F.lit(end).cast("timestamp_ntz").cast("date"))
        )
    return cells


def flow_window(cells: DataFrame, caps: DataFrame, start=None, end=None, by: str = "total") -> DataFrame:
    """Absolute window: totals over all cells, broken down by total, slot, hour, day or station."""
    c = window_cells(cells, start, end)
    if by == "station":
        return c.groupBy("station_key").agg(F.sum("reading").alias("total"))
    if by == "slot":
        return c.groupBy("slot").agg(F.sum("reading").alias("total"))
    if by == "hour":
        return c.groupBy(t.hour_floor("slot").alias("hour")).agg(F.sum("reading").alias("total"))
    if by == "day":
        return c.groupBy("day").agg(F.sum("reading").alias("total"))
    hit = (F.col("reading") >= F.col("ceiling")).cast("long")
    per_slot = c.join(caps, "station_key").groupBy("slot").agg(F.sum("reading").alias("total"), F.sum(hit).alias("hits"))
    return per_slot.agg(
        F.count(F.lit(1)).alias("slots"),
        F.sum("total").alias("total"),
        F.avg("total").alias("mean_per_slot"),
        F.max("total").alias("max_value"),
        first_argmax("slot", "total", t.slot_no("slot")).alias("max_slot"),
        F.sum("hits").alias("slots_at_ceiling"),
    )


def typical_day(
    cells: DataFrame, by: str = "total", stat: str = "mean", days="all", date_from=None, date_to=None, dates=None,
    time_from=None, time_to=None, clock: Clock = DEFAULT_CLOCK,
) -> DataFrame:
    """Daily window over a set of service days, summarised across the days."""
    agg = STATS[stat]
    c = cells.filter(t.day_mask("day", "daytype", days, date_from, date_to, dates) & t.time_mask("slot", time_from, time_to, clock))
    if by == "station":
        return c.groupBy("station_key", "day").agg(F.sum("reading").alias("v")).groupBy("station_key").agg(
            agg("v").alias("window_total")
        )
    per_slot = c.groupBy("slot", "day", "tod").agg(F.sum("reading").alias("v"))
    if by == "slot":
        return per_slot.groupBy("tod").agg(agg("v").alias("value")).withColumn("time", t.tod_label("tod", clock))
    if by == "hour":
        per_hour = per_slot.groupBy("day", F.hour("slot").alias("hour")).agg(F.sum("v").alias("v"))
        return per_hour.groupBy("hour").agg(agg("v").alias("value"))
    daily = per_slot.groupBy("day").agg(F.sum("v").alias("v"))
    if by == "day":
        return daily.select("day", F.col("v").alias("total"))
    return daily.agg(
        F.count(F.lit(1)).alias("service_days"),
        agg("v").alias("window_total"),
        F.min("v").alias("min_day"),
        F.max("v").alias("max_day"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )


def rank_stations(
    cells: DataFrame, caps: DataFrame, metric: str = "total", top: int | None = 10, ascending: bool = False,
    expected: DataFrame | None = None, min_days: DataFrame | None = None,
) -> DataFrame:
    """Stations ordered by one metric, with the network median; ties by station key.

    The rank window runs over one row per station, after the aggregation.
    """
    if metric == "vs_expected":
        c = cells.join(expected.select("station_key", "slot", "expected"), ["station_key", "slot"])
        g = c.groupBy("station_key").agg((F.sum("reading") / F.greatest(F.sum("expected"), F.lit(1.0))).alias("value"))
    elif metric == "slots_at_ceiling":
        g = cells.join(caps, "station_key").groupBy("station_key").agg(
            F.sum((F.col("reading") >= F.col("ceiling")).cast("long")).alias("value")
        )
    elif metric == "peak_slot":
        g = cells.groupBy("station_key").agg(
            F.max("reading").alias("value"), first_argmax("slot", "reading", t.slot_no("slot")).alias("at")
        )
    elif metric == "mean_per_day":
        n = cells.select("day").distinct().agg(F.count(F.lit(1)).alias("n"))
        g = cells.groupBy("station_key").agg(F.sum("reading").alias("s"))
        g = g.select("station_key", (F.col("s") / n.scalar()).alias("value"))
    else:
        g = cells.groupBy("station_key").agg(F.sum("reading").alias("value"))
    med = g.agg(F.median("value").alias("m"))
    order = F.col("value").asc() if ascending else F.col("value").desc()
    g = g.withColumn("network_median", med.scalar()).orderBy(order, "station_key")
    return g.limit(top) if top else g


def daily_totals(cells: DataFrame) -> DataFrame:
    """Service-day total per station, the table several reports reuse."""
    return cells.groupBy("station_key", "day", "daytype").agg(F.sum("reading").alias("total"))


def station_levels(daily: DataFrame) -> DataFrame:
    """Mean weekday and weekend-day total per station."""
    return daily.groupBy("station_key").agg(
        F.avg(F.when(F.col("daytype") == 0, F.col("total"))).alias("weekday_mean"),
        F.avg(F.when(F.col("daytype") > 0, F.col("total"))).alias("weekend_mean"),
    )


def same_weekday_weeks(cells: DataFrame, requests: DataFrame, max_weeks: int = 16) -> DataFrame:
    """Totals of each request window [start, end) and of its shifts by whole weeks.

    Returns (request_id, week, total) for weeks -max..max whose window lies inside the data;
    week 0 is the window itself. Windows are exploded into slots, so the join is an equi-join.
    """
    from flowspark.operators.grid import window_spine

    net = cells.groupBy("slot").agg(F.sum("reading").alias("v"))
    ext = net.agg(F.min("slot").alias("lo"), (F.max("slot") + t.minutes(15)).alias("hi"))
    shifted = requests.withColumn("week", F.explode(F.sequence(F.lit(-max_weeks), F.lit(max_weeks))))
    step = t.minutes(F.col("week") * 7 * 1440)
    shifted = shifted.withColumn("start", F.col("start") + step).withColumn("end", F.col("end") + step)
    shifted = shifted.withColumn("lo", ext.select("lo").scalar()).withColumn("hi", ext.select("hi").scalar())
    shifted = shifted.filter((F.col("start") >= F.col("lo")) & (F.col("end") <= F.col("hi"))).drop("lo", "hi")
    slots = window_spine(shifted, inclusive=False).select("request_id", "week", "slot")
    return slots.join(net, "slot").groupBy("request_id", "week").agg(F.sum("v").alias("total"))


def compare_to_weeks(totals: DataFrame) -> DataFrame:
    """Observed total against the same weekday of the other weeks."""
    obs = F.max(F.when(F.col("week") == 0, F.col("total")))
    per = totals.withColumn(
        "observed", F.max(F.when(F.col("week") == 0, F.col("total"))).over(Window.partitionBy("request_id"))
    ).filter("observed IS NOT NULL")
    other = F.col("week") != 0
    return per.groupBy("request_id").agg(
        obs.alias("observed"),
        F.count_if(other).alias("weeks"),
        F.avg(F.when(other, F.col("total"))).alias("mean"),
        F.min(F.when(other, F.col("total"))).alias("min"),
        F.max(F.when(other, F.col("total"))).alias("max"),
        F.avg(F.when(other, (F.col("total") > F.col("observed")).cast("double"))).alias("share_higher"),
    )


# -- tool family: calendar days ---------------------------------------------------------------


def network_summary(cells: DataFrame) -> DataFrame:
    """Per calendar day: total, mean per slot, peak slot, stations without flow."""
    c = calendar(cells)
    slots = c.groupBy("cday", "slot").agg(F.sum("reading").alias("v"))
    a = slots.groupBy("cday").agg(
        F.sum("v").alias("total"), F.avg("v").alias("mean_per_slot"), F.max("v").alias("peak_value"),
        first_argmax("slot", "v", t.slot_no("slot")).alias("peak_slot"),
    )
    z = c.groupBy("cday", "station_key").agg(F.sum("reading").alias("v")).groupBy("cday").agg(
        F.count_if(F.col("v") == 0).alias("zero_stations")
    )
    return a.join(z, "cday")


def station_extremes(cells: DataFrame, k: int = 5) -> DataFrame:
    """Top-k and bottom-k stations of every calendar day."""
    g = calendar(cells).groupBy("cday", "station_key").agg(F.sum("reading").alias("total"))
    hi = F.row_number().over(Window.partitionBy("cday").orderBy(F.col("total").desc(), "station_key"))
    lo = F.row_number().over(Window.partitionBy("cday").orderBy(F.col("total"), "station_key"))
    g = g.withColumn("hi", hi).withColumn("lo", lo)
    top = g.filter(F.col("hi") <= k).select("cday", F.lit("top").alias("side"), F.col("hi").alias("rank"), "station_key", "total")
    low = g.filter(F.col("lo") <= k).select("cday", F.lit("bottom").alias("side"), F.col("lo").alias("rank"), "station_key", "total")
    return top.unionByName(low)


def station_window(cells: DataFrame, hour_from=0, hour_to=24, cap: int = 3000) -> DataFrame:
    """Flow of every station and day in an hour window, against the same weekday's other full days."""
    c = full_calendar_days(cells).filter(t.hour_window("slot", hour_from, hour_to))
    day = c.groupBy("station_key", "cday", "wd").agg(
        F.sum("reading").alias("total"), F.avg("reading").alias("mean_per_slot"), F.max("reading").alias("peak"),
        first_argmax("slot", "reading", t.slot_no("slot")).alias("peak_slot"),
        F.count_if(F.col("reading") == 0).alias("zero_slots"), F.count_if(F.col("reading") >= cap).alias("capped_slots"),
    )
    w = Window.partitionBy("station_key", "wd")
    n, s = F.count(F.lit(1)).over(w), F.sum("total").over(w)
    base = F.when(n > 1, (s - F.col("total")) / (n - 1))
    return day.withColumn("baseline_total", base).withColumn(
        "change_pct", F.when(F.col("baseline_total") > 0, (F.col("total") / F.col("baseline_total") - 1) * 100)
    )


def peak_status(cells: DataFrame, hour_from=0, hour_to=24) -> DataFrame:
    """Highest 15-minute reading per station and its share of the station's own record."""
    g = cells.groupBy("station_key").agg(
        F.max("reading").alias("station_max"),
        F.max(F.when(t.hour_window("slot", hour_from, hour_to), F.col("reading"))).alias("peak_value"),
        F.max_by("slot", F.when(t.hour_window("slot", hour_from, hour_to), F.struct("reading", -t.slot_no("slot")))).alias("peak_slot"),
    )
    pct = F.when(F.col("station_max") > 0, F.round(F.col("peak_value") / F.col("station_max") * 100, 1)).otherwise(F.lit(0.0))
    return g.withColumn("pct_of_max", pct).withColumn("status", load_band("pct_of_max"))


def load_band(pct) -> Column:
    pct = F.col(pct) if isinstance(pct, str) else pct
    return F.when(pct >= 90, "CRITICAL").when(pct >= 70, "ELEVATED").otherwise("NORMAL")


def attendance_level(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), "unknown").when(c >= 1500, "high").when(c >= 800, "medium").otherwise("low")


def weekday_profile(cells: DataFrame) -> DataFrame:
    """Network level per weekday: mean daily total and the slot with the highest mean."""
    c = full_calendar_days(cells)
    slot = c.groupBy("cday", "wd", "slot").agg(F.sum("reading").alias("v"))
    daily = slot.groupBy("cday", "wd").agg(F.sum("v").alias("v")).groupBy("wd").agg(F.avg("v").alias("mean_daily_total"))
    prof = slot.groupBy("wd", t.hhmm("slot").alias("time")).agg(F.avg("v").alias("m"))
    peak = prof.groupBy("wd").agg(
        F.max("m").alias("peak_value"), F.max_by("time", F.struct("m", -_minutes_of("time"))).alias("peak_time")
    )
    return daily.join(peak, "wd")


def _minutes_of(label: str) -> Column:
    return F.substring(label, 1, 2).cast("int") * 60 + F.substring(label, 4, 2).cast("int")


def single_weekday_profile(cells: DataFrame, keys=("station_key",), morning=(5, 12), evening=(15, 20)) -> DataFrame:
    """Per station and weekday: peak, quietest operating slot, morning and evening peaks."""
    c = full_calendar_days(cells)
    k = [*keys, "wd"]
    prof = c.groupBy(*k, t.hhmm("slot").alias("time")).agg(F.avg("reading").alias("m"))
    h, order = F.substring("time", 1, 2).cast("int"), _minutes_of("time")
    am, pm = (h >= morning[0]) & (h < morning[1]), (h >= evening[0]) & (h < evening[1])
    key = F.struct("m", -order)
    return prof.groupBy(*k).agg(
        F.max_by("time", key).alias("peak_time"), F.max("m").alias("peak_value"),
        F.min_by("time", F.when(F.col("m") > 0, F.struct("m", order))).alias("quiet_time"),
        F.min(F.when(F.col("m") > 0, F.col("m"))).alias("quiet_value"),
        F.max_by("time", F.when(am, key)).alias("morning_time"), F.max(F.when(am, F.col("m"))).alias("morning_value"),
        F.max_by("time", F.when(pm, key)).alias("evening_time"), F.max(F.when(pm, F.col("m"))).alias("evening_value"),
    )


def weekday_hourly(cells: DataFrame) -> DataFrame:
    """Mean network total per weekday and hour."""
    c = full_calendar_days(cells)
    return c.groupBy("cday", "wd", "hr").agg(F.sum("reading").alias("v")).groupBy("wd", "hr").agg(F.avg("v").alias("mean_total"))


def busiest_by_weekday(cells: DataFrame, hour_from=None, hour_to=None, top_n: int = 5) -> DataFrame:
    """Stations with the highest mean window total, per weekday."""
    c = full_calendar_days(cells)
    if hour_from is not None:
        c = c.filter(t.hour_window("slot", hour_from, hour_to))
    day = c.groupBy("station_key", "wd", "cday").agg(F.sum("reading").alias("v"))
    g = day.groupBy("wd", "station_key").agg(F.avg("v").alias("mean_total"))
    w = Window.partitionBy("wd").orderBy(F.col("mean_total").desc(), "station_key")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, min(top_n, 50)))


def above_threshold(cells: DataFrame, threshold: float, per: str = "hour") -> DataFrame:
    """Stations whose mean hour (or slot) exceeds a threshold, with the first and last time above."""
    c = full_calendar_days(cells)
    if per == "hour":
        unit = c.groupBy("station_key", "cday", "hr").agg(F.sum("reading").alias("v"))
        unit = unit.withColumn("unit", F.col("hr") * 60)
    else:
        unit = c.select("station_key", "cday", (F.hour("slot") * 60 + F.minute("slot")).alias("unit"), F.col("reading").alias("v"))
    prof = unit.groupBy("station_key", "unit").agg(F.avg("v").alias("m"))
    hit = F.col("m") > threshold
    g = prof.groupBy("station_key").agg(
        F.max("m").alias("peak_mean"), first_argmax("unit", "m", "unit").alias("peak_minute"), F.count_if(hit).alias("units_above"),
        F.min(F.when(hit, F.col("unit"))).alias("first_minute"), F.max(F.when(hit, F.col("unit"))).alias("last_minute"),
    )
    return g.filter("units_above > 0")


def weekday_pattern(cells: DataFrame) -> DataFrame:
    """Commuter, leisure or mixed, from the weekend/weekday ratio of mean weekday levels."""
    c = full_calendar_days(cells)
    day = c.groupBy("station_key", "wd", "cday").agg(F.sum("reading").alias("v"))
    wd = day.groupBy("station_key", "wd").agg(F.avg("v").alias("m"))
    g = wd.groupBy("station_key").agg(
        F.avg(F.when(F.col("wd") < 5, F.col("m"))).alias("weekday_mean"),
        F.avg(F.when(F.col("wd") >= 5, F.col("m"))).alias("weekend_mean"),
        first_argmax("wd", "m", "wd").alias("busiest_wd"),
    )
    ratio = F.when(F.col("weekday_mean") > 0, F.col("weekend_mean") / F.col("weekday_mean")).otherwise(F.lit(0.0))
    g = g.withColumn("ratio", ratio)
    return g.withColumn(
        "pattern", F.when(F.col("ratio") <= 0.8, "commuter").when(F.col("ratio") >= 1.0, "leisure").otherwise("mixed")
    )


def weekly_summary(cells: DataFrame) -> DataFrame:
    """Monday-to-Sunday weeks: days with data, total, mean, best and worst day."""
    c = full_calendar_days(cells)
    day = c.groupBy("cday").agg(F.sum("reading").alias("v"))
    week = F.date_sub("cday", F.weekday("cday")).alias("week_start")
    order = F.unix_date("cday")
    return day.groupBy(week).agg(
        F.count(F.lit(1)).alias("days"), F.sum("v").alias("total"), F.avg("v").alias("mean_daily"),
        first_argmax("cday", "v", order).alias("peak_day"), first_argmin("cday", "v", order).alias("low_day"),
    )


def reference_days(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """Comparable recorded day for each requested date: itself, or the last full day of its class."""
    days = full_calendar_days(cells).select("cday").distinct()
    kind = lambda c: F.when(F.weekday(c) == 6, "sunday").when(F.weekday(c) == 5, "saturday").otherwise("weekday")
    last = days.groupBy(kind("cday").alias("kind")).agg(F.max("cday").alias("last_day"))
    r = requests.withColumn("kind", kind("date"))
    r = r.join(days.select(F.col("cday").alias("date"), F.lit(True).alias("inside")), "date", "left").join(last, "kind", "left")
    return r.select("date", "kind", F.when(F.col("inside"), F.col("date")).otherwise(F.col("last_day")).alias("reference_day"))


def tod_profile(cells: DataFrame, days: str = "weekday") -> DataFrame:
    """Mean, max and min per station and time of day over full calendar days."""
    c = full_calendar_days(cells)
    if days == "weekday":
        c = c.filter("wd < 5")
    elif days == "weekend":
        c = c.filter("wd >= 5")
    return c.groupBy("station_key", t.hhmm("slot").alias("time")).agg(
        F.avg("reading").alias("mean"), F.max("reading").alias("max"), F.min("reading").alias("min")
    )


def compare_to_network(cells: DataFrame, morning=(5, 12), evening=(15, 20)) -> DataFrame:
    """Morning and evening peak of every station against the mean and median of all stations."""
    prof = tod_profile(cells, "weekday")
    h, key = F.substring("time", 1, 2).cast("int"), F.struct("mean", -_minutes_of("time"))
    am, pm = (h >= morning[0]) & (h < morning[1]), (h >= evening[0]) & (h < evening[1])
    g = prof.groupBy("station_key").agg(
        F.max(F.when(am, F.col("mean"))).alias("am"), F.max_by("time", F.when(am, key)).alias("am_time"),
        F.max(F.when(pm, F.col("mean"))).alias("pm"), F.max_by("time", F.when(pm, key)).alias("pm_time"),
    )
    net = g.agg(F.avg("am").alias("net_am"), F.median("am").alias("med_am"), F.avg("pm").alias("net_pm"))
    g = g.withColumn("net_am", net.select("net_am").scalar()).withColumn("med_am", net.select("med_am").scalar())
    g = g.withColumn("net_pm", net.select("net_pm").scalar())
    return (
        g.withColumn("am_rank", F.rank().over(Window.orderBy(F.col("am").desc())))
        .withColumn("pm_rank", F.rank().over(Window.orderBy(F.col("pm").desc())))
        .withColumn("am_diff_pct", (F.col("am") / F.col("net_am") - 1) * 100)
        .withColumn("higher_peak", F.when(F.col("pm") > F.col("am"), "evening").otherwise("morning"))
    )


def data_extents(cells: DataFrame) -> DataFrame:
    """First and last full day, and the last full weekday, Saturday and Sunday."""
    d = full_calendar_days(cells).select("cday", "wd").distinct()
    return d.agg(
        F.min("cday").alias("first_full_day"), F.max("cday").alias("last_full_day"),
        F.max(F.when(F.col("wd") < 5, F.col("cday"))).alias("last_weekday"),
        F.max(F.when(F.col("wd") == 5, F.col("cday"))).alias("last_saturday"),
        F.max(F.when(F.col("wd") == 6, F.col("cday"))).alias("last_sunday"),
        F.count(F.lit(1)).alias("full_days"),
    )


def temporal_context(ts: DataFrame, col: str = "ts") -> DataFrame:
    """Label each timestamp: peak class, weekend, service running."""
    m = F.hour(col) * 60 + F.minute(col)
    weekend = F.weekday(col) >= 5
    label = (
        F.when((m >= 22 * 60) | (m < 285), "night").when(weekend, "off_peak")
        .when((m >= 420) & (m < 540), "morning_peak").when((m >= 960) & (m < 1140), "evening_peak").otherwise("off_peak")
    )
    return ts.withColumn("context", label).withColumn("weekend", weekend).withColumn("service_running", t.service_running(col))


def peak_hours(cells: DataFrame) -> DataFrame:
    """Measured weekday level per hour and the share of the day inside the rule windows 7-9 and 16-19."""
    c = full_calendar_days(cells).filter("wd < 5")
    h = c.groupBy("cday", "hr").agg(F.sum("reading").alias("v")).groupBy("hr").agg(F.avg("v").alias("mean_total"))
    inside = ((F.col("hr") >= 7) & (F.col("hr") < 9)) | ((F.col("hr") >= 16) & (F.col("hr") < 19))
    tot = h.agg(
        (F.sum(F.when(inside, F.col("mean_total"))) / F.sum("mean_total") * 100).alias("share"),
    )
    return h.withColumn("in_rule_window", inside).withColumn("rule_share_pct", tot.scalar())


def day_anomalies(cells: DataFrame, threshold: float = 2.0, min_days: int = 2) -> DataFrame:
    """Station-days whose total is far from the other full days of the same weekday.

    The target is excluded from its own baseline by subtracting it from group sums, so all
    days are tested in one pass instead of one query per day.
    """
    c = full_calendar_days(cells)
    day = c.groupBy("station_key", "wd", "cday").agg(F.sum("reading").cast("double").alias("v"))
    w = Window.partitionBy("station_key", "wd")
    n = F.count(F.lit(1)).over(w) - 1
    s, s2 = F.sum("v").over(w) - F.col("v"), F.sum(F.col("v") * F.col("v")).over(w) - F.col("v") * F.col("v")
    d = day.withColumn("n", n).withColumn("s", s).withColumn("s2", s2).filter(F.col("n") >= min_days)
    d = d.withColumn("mean", F.col("s") / F.col("n"))
    d = d.withColumn("sd", F.sqrt((F.col("s2") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))
    d = d.withColumn("z", F.when(F.col("sd") > 0, (F.col("v") - F.col("mean")) / F.col("sd")))
    return d.filter(F.abs("z") >= threshold)


def network_counts(stations: DataFrame) -> DataFrame:
    """Stations per line, with the network totals on every row."""
    tot = stations.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("d"))
    per = stations.select(F.explode("lines").alias("line"), "station_key").groupBy("line").agg(F.count(F.lit(1)).alias("stations"))
    return per.withColumn("network_stations", tot.select("n").scalar()).withColumn("distinct_names", tot.select("d").scalar())
