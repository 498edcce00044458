"""Crowd events: listings, phases, reports and venue patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock
from flowspark.functions import time as t
from flowspark.model.expect import window_sums, z_columns
from flowspark.operators.grid import window_spine
from flowspark.operators.joins import nearest, nearest_k
from flowspark.operators.stats import full_calendar_days, load_band


def shows(events: DataFrame) -> DataFrame:
    """Listings of the same venue and times added up; show_id is the smallest listing id."""
    return events.groupBy("venue_key", "start", "end").agg(
        F.min("crowd_id").alias("show_id"), F.sum("attendance").alias("attendance"), F.count(F.lit(1)).alias("listings")
    )


def list_events(events: DataFrame, shares: DataFrame, date_from=None, date_to=None, text=None, near: DataFrame | None = None, min_attendance: float = 0, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Events grouped by venue and start with their top stations. ``near`` (venue_key) restricts to venues."""
    e = events.withColumn("day", t.service_day("start", clock))
    if date_from:
        e = e.filter(F.col("day") >= F.lit(date_from).cast("date"))
    if date_to:
        e = e.filter(F.col("day") <= F.lit(date_to).cast("date"))
    if text:
        q = text.lower()
        cond = F.lit(False)
        for c in ("event_name", "venue_name", "address", "venue_key"):
            if c in events.columns:
                cond = cond | F.coalesce(F.lower(c).contains(q), F.lit(False))
        e = e.filter(cond)
    if near is not None:
        e = e.join(near.select("venue_key"), "venue_key", "left_semi")
    g = e.groupBy("venue_key", "start").agg(
        F.max("end").alias("end"), F.sum("attendance").alias("attendance"), F.count(F.lit(1)).alias("listings"), F.slice(F.array_sort(F.collect_set("event_name")), 1, 3).alias("names")
    ).filter(F.col("attendance") >= min_attendance)
    return g.join(top_shares(shares), "venue_key", "left")


def top_shares(shares: DataFrame, k: int = 4) -> DataFrame:
    """Top stations of each venue as a map station -> share (two digits)."""
    r = F.row_number().over(Window.partitionBy("venue_key").orderBy(F.col("share").desc(), "station_key"))
    s = shares.withColumn("r", r).filter(F.col("r") <= k)
    m = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("r", "station_key", "share"))), lambda x: F.struct(x.station_key, F.round(x.share, 2))))
    return s.groupBy("venue_key").agg(m.alias("stations"))


def phases(events: DataFrame) -> DataFrame:
    """Arrival (90 min before to the slot of the start) and departure (two hours after the end), half-open, per event."""
    a = F.struct(F.lit("arrival").alias("phase"), (F.col("start") - t.minutes(90)).alias("lo"), (F.col("start") + t.minutes(15)).alias("hi"))
    d = F.struct(F.lit("departure").alias("phase"), F.col("end").alias("lo"), (F.col("end") + t.minutes(120)).alias("hi"))
    x = events.select("*", F.explode(F.array(a, d)).alias("x"))
    return x.select(*[c for c in events.columns if c not in ("start", "end")], "x.phase", F.col("x.lo").alias("start"), F.col("x.hi").alias("end"))


def event_report(risk: DataFrame, events: DataFrame, shares: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Observed, normal and model totals of every show, phase and station of its split, in one job."""
    p = phases(shows(events))
    cells = window_spine(p, clock, inclusive=False).join(shares, "venue_key")
    j = cells.select("show_id", "venue_key", "phase", "attendance", "station_key", "slot").join(
        risk.select("station_key", "slot", "reading", "expected", "expected0", "ceiling"), ["station_key", "slot"]
    )
    hits = F.count_if(F.col("reading") >= F.col("ceiling")).alias("ceiling_hits")
    return z_columns(j.groupBy("show_id", "venue_key", "phase", "attendance", "station_key").agg(*window_sums(), hits))


def phase_totals(report: DataFrame) -> DataFrame:
    """Show and phase totals with the extra as a share of the attendance."""
    g = report.groupBy("show_id", "venue_key", "phase", "attendance").agg(
        F.sum("observed").alias("observed"), F.sum("normal").alias("normal"), F.sum("model").alias("model"), F.sum("ceiling_hits").alias("ceiling_hits")
    )
    g = g.withColumn("extra", F.col("observed") - F.col("normal"))
    return g.withColumn("extra_share", F.col("extra") / F.greatest(F.col("attendance"), F.lit(1)))


def event_checks(risk: DataFrame, events: DataFrame, shares: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Per show and phase: totals over its stations and the strength z of the excess."""
    p = phases(shows(events))
    cells = window_spine(p, clock, inclusive=False).join(shares.select("venue_key", "station_key"), "venue_key")
    j = cells.select("show_id", "venue_key", "phase", "attendance", "station_key", "slot", "day").join(risk.select("station_key", "slot", "reading", "expected", "expected0"), ["station_key", "slot"])
    g = j.groupBy("show_id", "venue_key", "phase", "attendance").agg(
        F.min("day").alias("day"), F.sum("reading").alias("observed"), F.sum("expected0").alias("normal"), F.sum("expected").alias("model"),
        F.sqrt(F.sum(F.col("expected0") * F.col("expected0"))).alias("sd"),
    )
    g = g.withColumn("extra", F.col("observed") - F.col("normal"))
    return g.withColumn("z", F.col("extra") / F.greatest(F.col("sd"), F.lit(1.0))).drop("sd")


def other_dates(report: DataFrame) -> DataFrame:
    """Departure extra of each show next to the mean of the other shows at the venue."""
    d = report.filter("phase = 'departure'").groupBy("venue_key", "show_id", "attendance").agg(F.sum("excess").alias("extra"))
    w = Window.partitionBy("venue_key")
    n, s = F.count(F.lit(1)).over(w), F.sum("extra").over(w)
    return d.withColumn("others", n - 1).withColumn("mean_other_extra", F.when(n > 1, (s - F.col("extra")) / (n - 1)))


def venue_patterns(cells: DataFrame, events: DataFrame, venues: DataFrame, stations: DataFrame, before_min: int = 90, after_min: int = 120) -> DataFrame:
    """Mean peak at a venue's nearest station on event days against the same window on event-free days of the weekday.

    One window per venue and day (earliest start to latest end). The reference days of a window
    are joined on the weekday, then to the station's cells by time of day.
    """
    near = nearest(venues, stations.select("station_key", "lat", "lon"), "venue_key", "station_key").select("venue_key", "station_key", "km")
    d = events.withColumn("cday", F.to_date("start")).groupBy("venue_key", "cday").agg(
        (F.min("start") - t.minutes(before_min)).alias("lo"), (F.max("end") + t.minutes(after_min)).alias("hi")
    )
    full = full_calendar_days(cells).select("station_key", "slot", "cday", "reading")
    days = full.select("cday").distinct()
    lo = t.slot_no("lo") - F.unix_date("cday").cast("long") * 96
    hi = t.slot_no(F.col("hi") - F.expr("INTERVAL 1 MICROSECOND")) - F.unix_date("cday").cast("long") * 96
    w = d.join(days, "cday").join(near, "venue_key").withColumn("wd", F.weekday("cday")).withColumn("o", F.explode(F.sequence(lo, hi)))
    w = w.select("venue_key", "station_key", "cday", "wd", "o")
    busy = d.select("venue_key", F.col("cday").alias("rday")).distinct()
    ref = w.join(days.select(F.col("cday").alias("rday"), F.weekday("cday").alias("wd")), "wd").join(busy, ["venue_key", "rday"], "left_anti")
    keyed = cells.select("station_key", t.slot_no("slot").alias("n"), "reading")
    own = w.withColumn("n", F.unix_date("cday").cast("long") * 96 + F.col("o")).join(keyed, ["station_key", "n"])
    own = own.groupBy("venue_key", "cday").agg(F.max("reading").alias("peak")).groupBy("venue_key").agg(F.avg("peak").alias("event_peak"), F.count(F.lit(1)).alias("event_days"))
    oth = ref.withColumn("n", F.unix_date("rday").cast("long") * 96 + F.col("o")).join(keyed, ["station_key", "n"])
    oth = oth.groupBy("venue_key", "cday", "rday").agg(F.max("reading").alias("peak")).groupBy("venue_key").agg(F.avg("peak").alias("normal_peak"))
    g = events.groupBy("venue_key").agg(F.count(F.lit(1)).alias("past_events"), F.avg("attendance").alias("avg_attendance"))
    g = g.join(near, "venue_key").join(own, "venue_key", "left").join(oth, "venue_key", "left")
    return g.withColumn("uplift_pct", F.when(F.col("normal_peak") > 0, (F.col("event_peak") / F.col("normal_peak") - 1) * 100))


def station_picks(events: DataFrame, venues: DataFrame, stations: DataFrame, radius_km: float = 1.5, per_day: int = 3) -> DataFrame:
    """Up to three stations a day around its events, taken in turns: every event's nearest first, larger events first."""
    near = nearest_k(venues, stations.select("station_key", "lat", "lon"), "venue_key", "station_key", radius_km, per_day)
    e = events.withColumn("cday", F.to_date("start")).select("crowd_id", "venue_key", "cday", "attendance", "start", "end").join(near, "venue_key")
    order = [F.col("rank"), F.col("attendance").desc(), F.col("crowd_id")]
    first = F.row_number().over(Window.partitionBy("cday", "station_key").orderBy(*order))
    e = e.withColumn("f", first).filter("f = 1").drop("f")
    # Places are filled turn by turn; a station named twice uses no second place.
    pick = F.row_number().over(Window.partitionBy("cday").orderBy(*order))
    return e.withColumn("pick", pick).filter(F.col("pick") <= per_day).withColumnRenamed("rank", "depth")


def phase_peaks(cells: DataFrame, picks: DataFrame) -> DataFrame:
    """Highest reading in the two hours before the start and after the end hour, with its load band."""
    s, e = F.hour("start"), F.hour("end")
    e = F.when(e < s, 24).otherwise(e)
    a = F.struct(F.lit("arrival").alias("phase"), F.greatest(F.lit(0), s - 2).alias("h0"), s.alias("h1"))
    d = F.struct(F.lit("departure").alias("phase"), e.alias("h0"), F.least(F.lit(24), e + 2).alias("h1"))
    x = picks.select("crowd_id", "cday", "station_key", F.explode(F.array(a, d)).alias("x")).select("crowd_id", "cday", "station_key", "x.*").filter("h0 < h1")
    x = x.withColumn("hr", F.explode(F.sequence("h0", F.col("h1") - 1)))
    c = cells.select("station_key", F.to_date("slot").alias("cday"), F.hour("slot").alias("hr"), "slot", "reading")
    top = cells.groupBy("station_key").agg(F.max("reading").alias("station_max"))
    g = x.join(c, ["station_key", "cday", "hr"]).groupBy("crowd_id", "cday", "station_key", "phase").agg(
        F.max("reading").alias("peak"), F.max_by("slot", F.struct("reading", -t.slot_no("slot"))).alias("slot")
    )
    g = g.join(top, "station_key").withColumn("pct", F.when(F.col("station_max") > 0, F.round(F.col("peak") / F.col("station_max") * 100, 1)).otherwise(F.lit(0.0)))
    return g.withColumn("status", load_band("pct"))


def hotspot_venues(events: DataFrame, segment: str = "Music", top: int = 3) -> DataFrame:
    """Venues with the most events of a segment, with their largest one."""
    e = events.filter(F.col("segment") == segment)
    g = e.groupBy("venue_key").agg(
        F.count(F.lit(1)).alias("n"), F.max("attendance").alias("largest"), F.max_by("event_name", F.struct("attendance", -F.col("crowd_id"))).alias("largest_name")
    )
    return g.orderBy(F.col("n").desc(), "venue_key").limit(top)


def events_matching(events: DataFrame, text: str) -> DataFrame:
    return events.filter(F.lower("event_name").contains(text.lower()))
