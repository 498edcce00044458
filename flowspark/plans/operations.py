"""Plans for many service days at once: staff, watch windows, reinforcement."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock
from flowspark.functions import time as t
from flowspark.functions.lineage import cut
from flowspark.functions.noise import expected_reading, over_capacity, quantile
from flowspark.operators import windows as win
from flowspark.operators.joins import nearest_k, within_km
from flowspark.operators.service import trains_per_hour


# -- staff ------------------------------------------------------------------------------------


def staff_value(risk: DataFrame, reference: DataFrame) -> DataFrame:
    """Value of staffing a cell: demand above capacity beyond a normal dry day plus part of event crowds.

    ``reference`` holds (station_key, slot, over_ref).
    """
    j = risk.join(reference, ["station_key", "slot"])
    extra = F.greatest(F.col("over") - F.col("over_ref"), F.lit(0.0))
    return j.withColumn("extra", extra).withColumn("value", F.col("extra") + 0.3 * F.col("event_load"))


def staff_picks(values: DataFrame, staff: int = 10, block_hours: float = 2.0) -> DataFrame:
    """Greedy placement of ``staff`` people per day; a second person on the same place and time counts half.

    A pick changes only its own station and a station's successive picks never gain value, so the
    network-wide greedy order is the merge of the stations' own greedy orders: each (day, station)
    group of at most one service day of slots yields its first picks, and the best ``staff`` of a
    day are kept.
    """
    width = max(int(block_hours * 4), 1)

    def picks(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("tod")
        tod, val = pdf["tod"].to_numpy(), pdf["value"].to_numpy(dtype=float)
        cover, out = np.zeros(len(val)), []
        for k in range(int(staff)):
            c = np.concatenate([[0.0], np.cumsum(val * 0.5**cover)])
            if len(val) < width:
                break
            block = c[width:] - c[:-width]
            i = int(np.argmax(block))
            if block[i] <= 1e-12:
                break
            out.append((pdf["day"].iloc[0], pdf["station_key"].iloc[0], k + 1, int(tod[i]), float(block[i])))
            cover[i : i + width] += 1
        return pd.DataFrame(out, columns=["day", "station_key", "pick", "tod_from", "block_value"])

    v = values.filter("value > 0").select("day", "station_key").distinct()
    cells = values.select("day", "station_key", "tod", "value").join(v, ["day", "station_key"], "left_semi")
    own = cells.groupBy("day", "station_key").applyInPandas(picks, "day date, station_key string, pick int, tod_from int, block_value double")
    w = Window.partitionBy("day").orderBy(F.round("block_value", 6).desc(), "tod_from", "station_key", "pick")
    return own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= staff).withColumn("tod_to", F.col("tod_from") + width)


def staff_roster(picks: DataFrame, values: DataFrame) -> DataFrame:
    """Overlapping picks of a station merged into shifts, with what the shift covers."""
    s = win.merge_intervals(picks.select("day", "station_key", F.col("tod_from").alias("start"), F.col("tod_to").alias("end")), ["day", "station_key"])
    x = s.withColumn("tod", F.explode(F.sequence("start", F.col("end") - 1)))
    j = x.join(values.select("day", "station_key", "tod", "extra", "event_load", "p"), ["day", "station_key", "tod"])
    return j.groupBy("day", "station_key", F.col("start").alias("tod_from"), F.col("end").alias("tod_to"), F.col("n").alias("staff")).agg(
        F.sum("extra").alias("extra_above_capacity"), F.sum("event_load").alias("event_crowd"), F.max("p").alias("peak_chance")
    )


# -- watch windows ----------------------------------------------------------------------------


def watch_windows(risk: DataFrame, top: int = 8, per_station: int = 2) -> DataFrame:
    """Station windows to watch per day, best first."""
    flag = (F.col("p") >= 0.15) | (F.col("event_load") >= F.greatest(F.lit(30.0), 0.3 * F.col("lam0")))
    return win.top_per_station(win.flagged_windows(risk.withColumn("flag", flag)), per_station, top)


def window_cells(windows: DataFrame, risk: DataFrame, last_tod: int = 79) -> DataFrame:
    """Cells of each watch window with one slot of margin and its thresholds."""
    w = windows.withColumn("tod", F.explode(F.sequence(F.greatest(F.col("tod_from") - 1, F.lit(0)), F.least(F.col("tod_to") + 1, F.lit(last_tod)))))
    c = w.select("day", "station_key", "rank", "tod").join(risk.drop("rank"), ["day", "station_key", "tod"])
    c = c.withColumn("q95", quantile("lam", "ceiling", 0.95)).withColumn("normal_q95", quantile("lam0", "ceiling", 0.95))
    return c.withColumn("near", 0.9 * F.col("ceiling"))


def action_plan(windows: DataFrame, cells: DataFrame) -> DataFrame:
    """Per watch window: thresholds and, on recorded days, when each trigger would have fired first."""
    w = Window.partitionBy("day", "rank").orderBy("tod")
    twice = lambda q: (F.col("reading") > F.col(q)) & (F.lag("reading").over(w) > F.lag(q).over(w))
    c = cells.withColumn("surge", twice("normal_q95")).withColumn("above", twice("q95")).withColumn("cap_hit", F.col("reading") >= F.col("near"))
    g = c.groupBy("day", "rank").agg(
        F.min("normal_q95").alias("surge_min"), F.max("normal_q95").alias("surge_max"), F.min("q95").alias("plan_min"), F.max("q95").alias("plan_max"),
        F.max("near").alias("near_capacity"), F.max_by("slot", F.struct("lam", -F.col("tod"))).alias("peak_slot"), F.max("ceiling").alias("ceiling"),
        F.min(F.when(F.col("surge"), F.col("slot"))).alias("surge_fired"), F.min(F.when(F.col("above"), F.col("slot"))).alias("plan_fired"),
        F.min(F.when(F.col("cap_hit"), F.col("slot"))).alias("near_fired"),
    )
    return windows.join(g, ["day", "rank"])


def event_reasons(windows: DataFrame, events: DataFrame, shares: DataFrame, tod_col: str = "tod_event_peak", clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Reason of each window: the first event in its arrival or departure phase at the decisive slot, else the peak hour."""
    from flowspark.operators.grid import window_spine

    e = events.select("crowd_id", "venue_key", "attendance", F.col("start").alias("s0"), F.col("end").alias("e0"))
    e = e.withColumn("start", F.col("s0") - t.minutes(90)).withColumn("end", F.col("e0") + t.minutes(120))
    from flowspark.model.expect import event_phase

    x = window_spine(e, clock).withColumn("phase", event_phase("slot", "s0", "e0")).filter("phase IN ('arrivals', 'departures')")
    x = x.join(shares.select("venue_key", "station_key"), "venue_key").groupBy("station_key", "day", "tod").agg(F.min(F.struct("crowd_id", "phase", "attendance")).alias("ev"))
    j = windows.join(x.withColumnRenamed("tod", tod_col), ["station_key", "day", tod_col], "left")
    return j.withColumn("reason", F.coalesce("ev.phase", F.lit("peak hour"))).withColumn("reason_event", F.col("ev.crowd_id")).drop("ev")


# -- reinforcement ----------------------------------------------------------------------------


@dataclass(frozen=True)
class ModeAssumptions:
    """Planning assumptions about other modes; every value is a parameter."""

    trains: tuple = ((5, 6, 6), (6, 9, 15), (9, 15, 12), (15, 19, 15), (19, 21, 12), (21, 29, 6))
    max_trains: int = 20
    rail_walk_km: float = 1.0
    rail_extra_max: int = 4
    rail_spare: int = 400
    bus_capacity: int = 90
    bus_speed_kmh: float = 15.0
    bus_loading_min: float = 10.0
    bus_max_km: float = 2.6
    buses_max: int = 20
    taxi_pax: int = 4
    taxis_max: int = 40
    bike_pax: int = 1
    bikes_max: int = 80
    bike_max_rain: float = 0.2
    target_reduction: float = 0.9
    min_extra_slot: float = 5.0
    min_extra_window: float = 60.0
    walk_max_km: float = 0.8

    def trains_at(self, hour: Column) -> Column:
        h = F.when(hour < 5, hour + 24).otherwise(hour)
        out = F.lit(6)
        for a, b, f in reversed(self.trains):
            out = F.when((h >= a) & (h < b), F.lit(f)).otherwise(out)
        return out


def overload_windows(values: DataFrame, a: ModeAssumptions, top: int | None = 6) -> DataFrame:
    """Windows whose extra demand is large enough, best of each day."""
    f = win.islands(values.filter(F.col("extra") >= a.min_extra_slot), ["station_key", "day"], "tod", 2)
    g = f.groupBy("station_key", "day", "island").agg(F.min("tod").alias("tod_from"), F.max("tod").alias("tod_to"))
    x = g.withColumn("tod", F.explode(F.sequence("tod_from", "tod_to"))).join(values.select("station_key", "day", "tod", "extra"), ["station_key", "day", "tod"])
    s = x.groupBy("station_key", "day", "tod_from", "tod_to").agg(F.sum("extra").alias("score"), F.max_by("tod", F.struct("extra", -F.col("tod"))).alias("tod_event_peak"))
    s = s.filter(F.col("score") >= a.min_extra_window)
    w = Window.partitionBy("day").orderBy(F.round("score", 6).desc(), F.col("station_key").desc(), F.col("tod_from").desc())
    s = s.withColumn("rank", F.row_number().over(w))
    return s.filter(F.col("rank") <= top) if top else s


def reinforcement_plan(values: DataFrame, stations: DataFrame, weather: DataFrame | None = None, a: ModeAssumptions = ModeAssumptions(), top: int | None = 6, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Per overload window: extra trains, then what rail, walk or bus, bike and taxi absorb per hour, and the rest to meter.

    All windows of all days are planned together: the train increments are exploded and the
    smallest sufficient one kept; the later modes are a fixed sequence of column steps.
    """
    # A few windows per day feed every later step: fix them once.
    wins = cut(overload_windows(values, a, top))
    cells = wins.withColumn("tod", F.explode(F.sequence("tod_from", "tod_to"))).join(values.drop("score", "rank"), ["station_key", "day", "tod"])
    key = ["day", "rank", "station_key", "tod_from", "tod_to", "score"]
    first_hour = F.hour(F.min("slot"))
    base = cells.groupBy(*key).agg(
        F.sum("over").alias("ov"), F.sum("over_ref").alias("oref"), first_hour.alias("h0"), F.first("ceiling").alias("cap"), F.max(F.try_divide("lam", "ceiling")).alias("peak_ratio"), F.count(F.lit(1)).alias("slots")
    )
    base = base.withColumn("hours", F.col("slots") / 4).withColumn("f0", a.trains_at(F.col("h0")))
    base = base.withColumn("fmax", F.greatest(F.lit(a.max_trains), F.col("f0"))).withColumn("target", F.col("oref") + (1 - a.target_reduction) * (F.col("ov") - F.col("oref")))
    steps = base.select("day", "rank", "f0", "fmax", "target", F.explode(F.sequence(F.lit(0), F.col("fmax") - F.col("f0"))).alias("df"))
    left = steps.join(cells.select("day", "rank", "lam", "ceiling"), ["day", "rank"]).groupBy("day", "rank", "df", "target", "fmax", "f0").agg(
        F.sum(over_capacity("lam", F.col("ceiling") * (1 + F.col("df") / F.col("f0")))).alias("left")
    )
    good = F.when(F.col("left") <= F.col("target"), F.col("df"))
    pick = left.groupBy("day", "rank").agg(F.coalesce(F.min(good), F.max("df")).alias("df"))
    left = left.join(pick, ["day", "rank", "df"]).select("day", "rank", "df", "left")
    p = cut(base.join(left, ["day", "rank"])).withColumn("trains_absorb", (F.col("ov") - F.col("left")) / F.col("hours"))
    p = p.withColumn("resid", F.greatest(F.col("left") - F.col("oref"), F.lit(0.0)) / F.col("hours"))
    p = p.join(_rail(stations, a), "station_key", "left")
    take = F.when(F.col("rail").isNotNull(), F.least("resid", F.lit(float(a.rail_extra_max * a.rail_spare)))).otherwise(F.lit(0.0))
    p = p.withColumn("rail_absorb", take).withColumn("rail_trains", F.ceil(F.col("rail_absorb") / a.rail_spare)).withColumn("resid", F.col("resid") - F.col("rail_absorb"))
    p = _ground(p, wins, cells, values, stations, a)
    rain = F.lit(0.0)
    if weather is not None:
        r = cells.select("day", "rank", "slot").join(weather.select("slot", F.col("prcp").alias("_wx")), "slot").groupBy("day", "rank").agg(F.max("_wx").alias("rain"))
        p = p.join(r, ["day", "rank"], "left").withColumn("rain", F.coalesce("rain", F.lit(0.0)))
        rain = F.col("rain")
    night = (F.col("h0") >= 23) | (F.col("h0") < 5)
    bikes = F.when(~night & (rain <= a.bike_max_rain), F.least(F.ceil(F.col("resid") / a.bike_pax).cast("double"), F.lit(float(a.bikes_max)))).otherwise(F.lit(0.0))
    p = p.withColumn("bikes", bikes).withColumn("bike_absorb", F.least("resid", F.col("bikes") * a.bike_pax)).withColumn("resid", F.col("resid") - F.col("bike_absorb"))
    p = p.withColumn("taxis", F.least(F.ceil(F.col("resid") / a.taxi_pax).cast("double"), F.lit(float(a.taxis_max))))
    p = p.withColumn("taxi_absorb", F.least("resid", F.col("taxis") * a.taxi_pax)).withColumn("resid", F.col("resid") - F.col("taxi_absorb"))
    p = p.withColumn("extra_total", F.col("ov") - F.col("oref")).withColumn("residual_total", F.greatest("resid", F.lit(0.0)) * F.col("hours"))
    return p.withColumnRenamed("resid", "meter_per_hour").drop("target", "fmax", "slots", "rail")


def _rail(stations: DataFrame, a: ModeAssumptions) -> DataFrame:
    """Stations that are rail interchanges themselves or have one within walking distance."""
    s = stations.select("station_key", "lat", "lon")
    hub = stations.filter("is_rail").select(F.col("station_key").alias("rail"), "lat", "lon")
    return within_km(s, hub, a.rail_walk_km).groupBy("station_key").agg(F.min_by("rail", F.struct("km", "rail")).alias("rail"))


def _ground(p: DataFrame, wins: DataFrame, cells: DataFrame, values: DataFrame, stations: DataFrame, a: ModeAssumptions) -> DataFrame:
    """Walk or shuttle bus to the two nearest stations on other lines that have room and need no help themselves."""
    s = stations.select("station_key", "lat", "lon", "lines")
    o = stations.select(F.col("station_key").alias("alt"), "lat", "lon", F.col("lines").alias("alt_lines"))
    near = within_km(s, o, a.bus_max_km).filter(~F.arrays_overlap("lines", "alt_lines") & (F.col("station_key") != F.col("alt")))
    near = near.withColumn("turn", F.row_number().over(Window.partitionBy("station_key").orderBy("km", "alt"))).filter("turn <= 2").select("station_key", "alt", "km", "turn")
    c = wins.select("day", "rank", "station_key", "tod_from", "tod_to").join(near, "station_key")
    busy = wins.select("day", F.col("station_key").alias("alt"), F.col("tod_from").alias("b0"), F.col("tod_to").alias("b1"))
    clash = c.join(busy, ["day", "alt"]).filter("b1 >= tod_from AND b0 <= tod_to").select("day", "rank", "alt").distinct()
    c = c.join(clash, ["day", "rank", "alt"], "left_anti")
    room = values.select("day", F.col("station_key").alias("alt"), "tod", "ceiling", "expected")
    r = c.withColumn("tod", F.explode(F.sequence("tod_from", "tod_to"))).join(room, ["day", "alt", "tod"])
    r = r.groupBy("day", "rank", "alt", "km", "turn").agg((F.greatest(F.avg(0.8 * F.col("ceiling") - F.col("expected")), F.lit(0.0)) * 4).alias("spare")).filter("spare >= 20")
    cycle = 2 * F.col("km") / a.bus_speed_kmh * 60 + a.bus_loading_min
    r = r.withColumn("walk", F.col("km") <= a.walk_max_km).withColumn("per_bus", a.bus_capacity * 60 / cycle)
    for i in (1, 2):
        x = r.filter(F.col("turn") == i).select("day", "rank", F.col("alt").alias(f"alt{i}"), F.col("spare").alias("sp"), F.col("walk").alias("wk"), F.col("per_bus").alias("pb"))
        p = p.join(x, ["day", "rank"], "left")
        want = F.least("resid", F.coalesce("sp", F.lit(0.0)))
        buses = F.when(F.col("wk"), F.lit(0.0)).otherwise(F.coalesce(F.least(F.ceil(want / F.col("pb")).cast("double"), F.lit(float(a.buses_max))), F.lit(0.0)))
        p = p.withColumn(f"buses{i}", buses)
        p = p.withColumn(f"ground{i}", F.when(F.col("wk"), want).otherwise(F.coalesce(F.least(want, F.col(f"buses{i}") * F.col("pb")), F.lit(0.0))))
        p = p.withColumn("resid", F.col("resid") - F.col(f"ground{i}")).drop("sp", "wk", "pb")
    return p


def line_needs(plan: DataFrame, stations: DataFrame) -> DataFrame:
    """Extra trains per line and day: overlapping windows merged with the largest increment."""
    x = plan.filter("df > 0").join(stations.select("station_key", F.explode("lines").alias("line")), "station_key")
    x = x.select("day", "line", F.col("tod_from").alias("start"), (F.col("tod_to") + 1).alias("end"), "df")
    w = Window.partitionBy("day", "line").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    x = x.withColumn("i", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("day", "line", "i").agg(F.min("start").alias("tod_from"), F.max("end").alias("tod_to"), F.max("df").alias("trains")).drop("i")
