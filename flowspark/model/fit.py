"""Fitting the censored-exponential demand model with Spark aggregations.

A reading is min(ceiling, floor(lambda * Exp(1))) with lambda = w[station] * P[day type, tod] * M[slot]
plus event load. The three factors are estimated by alternating updates. Only the station sum of an
update needs the station weights, so one pass over the cells per iteration yields a slot table
(one row per slot), from which P and M follow without touching the cells again; a second pass
updates w. The cell grid is hash-partitioned by slot and persisted once, so the first pass and the
join of M back to the cells need no shuffle; the station update shuffles one partial row per
station and task.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, DEFAULT_PARAMS, Clock, ModelParams
from flowspark.functions.lineage import broadcast_if_small, cut
from flowspark.functions.noise import expected_reading
from flowspark.operators.joins import closed_cells, event_load, kernel_load, nearest, within_km
from flowspark.operators.stats import ceilings
from flowspark.operators.weather import daily_temperature


@dataclass(frozen=True)
class Fit:
    """Fitted model tables: every one is small next to the cells it came from."""

    stations: DataFrame  # station_key, w, ceiling
    profile: DataFrame  # daytype, tod, p
    slots: DataFrame | None  # slot, m
    weather: dict  # heat, rain_max, rain_scale, t_ref
    shares: DataFrame  # venue_key, station_key, share
    learned: DataFrame | None = None  # venue_key, station_key, share, method


def fit_grid(cells: DataFrame, closures: DataFrame, params: ModelParams = DEFAULT_PARAMS, clock: Clock = DEFAULT_CLOCK, event_cells: DataFrame | None = None) -> DataFrame:
    """Cells with the columns the updates need: xc (half-open reading), use, unc, morning."""
    g = closed_cells(cells, closures, clock, params.rebound_mask_slots).join(ceilings(cells), "station_key")
    # A station that never counted anything has no level to fit; its weight is zero.
    use = ~F.col("closed") & ~F.col("after") & (F.col("ceiling") > 0)
    if event_cells is not None:
        g = g.join(event_cells.select("station_key", "slot", F.lit(True).alias("_ev")), ["station_key", "slot"], "left")
        use = use & F.col("_ev").isNull()
    h = F.hour("slot")
    return g.select(
        "station_key", "slot", "day", "tod", "daytype", "ceiling",
        F.least(F.col("reading") + 0.5, F.col("ceiling").cast("double")).alias("xc"),
        use.alias("use"),
        (use & (F.col("reading") < F.col("ceiling"))).cast("int").alias("unc"),
        ((h >= clock.service_start_hour) & (h < 13)).alias("morning"),
    )


def fit_core(grid: DataFrame, iters: int = 25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alternating updates; returns w (station_key, w), P (daytype, tod, p) and M (slot, m)."""
    spark = grid.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    used = grid.filter("use").repartition(parts, "slot").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        w = cut(used.groupBy("station_key").agg(F.avg("xc").alias("w")))
        m, p = None, None
        for _ in range(iters):
            s = used.join(broadcast_if_small(w), "station_key").groupBy("slot", "daytype", "tod").agg(F.sum(F.col("xc") / F.col("w")).alias("s"), F.sum("unc").alias("u"))
            s = s.withColumn("m0", F.lit(1.0)) if m is None else s.join(m.select("slot", F.col("m").alias("m0")), "slot")
            p = s.groupBy("daytype", "tod").agg((F.sum(F.col("s") / F.col("m0")) / F.greatest(F.sum("u"), F.lit(1))).alias("p"))
            # P has one row per day type and time of day, whatever the data.
            m = cut(s.join(F.broadcast(p), ["daytype", "tod"]).select("slot", "daytype", "tod", "p", (F.col("s") / F.col("p") / F.greatest("u", F.lit(1))).alias("m")))
            a = used.filter("morning").join(m.select("slot", "p", "m"), "slot")
            w = cut(
                a.groupBy("station_key").agg(
                    (F.sum(F.col("xc") / (F.col("p") * F.col("m"))) / F.greatest(F.sum("unc"), F.lit(1))).alias("w")
                )
            )
        p = cut(m.groupBy("daytype", "tod").agg(F.first("p").alias("p")))
        return w, p, m.select("slot", "m")
    finally:
        used.unpersist()


# -- weather rule -----------------------------------------------------------------------------

LOWER, UPPER = np.array([-1.0, -0.2, 0.0]), np.array([1.0, 0.2, 1.0])
SCALE_BOUNDS = (0.05, 5.0)


def _bounded_lsq(A: np.ndarray, b: np.ndarray, yy: float) -> tuple[np.ndarray, float]:
    """Minimise y'y - 2 b'x + x'Ax inside the bounds by trying every set of active bounds (27 cases)."""
    best = (None, np.inf)
    for state in itertools.product((0, 1, 2), repeat=3):
        x = np.where(np.array(state) == 1, LOWER, UPPER)
        free = np.array(state) == 0
        if free.any():
            rhs = b[free] - A[np.ix_(free, ~free)] @ x[~free]
            x = x.astype(float)
            x[free] = np.linalg.lstsq(A[np.ix_(free, free)], rhs, rcond=None)[0]
        if (x < LOWER - 1e-9).any() or (x > UPPER + 1e-9).any():
            continue
        sse = float(yy - 2 * b @ x + x @ A @ x)
        if sse < best[1]:
            best = (x, sse)
    return best


def fit_weather(slot_mult: DataFrame, weather: DataFrame, levels: int = 3, points: int = 24, t_ref: float = 18.0) -> dict:
    """ln M = a + b (T - t_ref) + c (1 - exp(-prcp / d)) by bounded least squares.

    For fixed d the problem is linear; its moments for a whole grid of d values come from one
    aggregation. The grid is refined around the best d. Only the moments (one row per grid
    point) reach the driver.
    """
    rows = (
        slot_mult.join(weather.select("slot", "day", "prcp"), "slot").join(daily_temperature(weather), "day")
        .filter((F.hour("slot") >= 6) & (F.hour("slot") <= 21) & F.col("prcp").isNotNull() & (F.col("m") > 0))
    )
    y = F.log("m")
    obs = rows.groupBy((F.col("tday") - t_ref).alias("x"), "prcp").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"))
    obs = obs.persist()
    lo, hi = SCALE_BOUNDS
    best = None
    for _ in range(levels):
        ds = np.geomspace(lo, hi, points)
        g = 1 - F.exp(-F.col("prcp") / F.col("d"))
        e = obs.withColumn("d", F.explode(F.array(*[F.lit(float(v)) for v in ds]))).withColumn("g", g)
        n, x, gg, yv = F.col("n"), F.col("x"), F.col("g"), F.col("y")
        mom = e.groupBy("d").agg(
            F.sum(n), F.sum(n * x), F.sum(n * gg), F.sum(n * x * x), F.sum(n * x * gg), F.sum(n * gg * gg),
            F.sum(yv), F.sum(yv * x), F.sum(yv * gg), F.sum("yy"),
        ).collect()
        for r in sorted(mom, key=lambda r: r[0]):
            d, n_, sx, sg, sxx, sxg, sgg, sy, sxy, sgy, syy = (float(v) for v in r)
            A = np.array([[n_, sx, sg], [sx, sxx, sxg], [sg, sxg, sgg]])
            p, sse = _bounded_lsq(A, np.array([sy, sxy, sgy]), syy)
            if p is not None and (best is None or sse < best[0] - 1e-12):
                best = (sse, d, p, n_)
        i = int(np.argmin(abs(ds - best[1])))
        lo, hi = ds[max(i - 1, 0)], ds[min(i + 1, points - 1)]
    obs.unpersist()
    sse, d, (a, b, c), n_ = best
    return {"a0": float(a), "heat": float(b), "rain_max": float(c), "rain_scale": float(d), "t_ref": t_ref, "resid_sd": float(np.sqrt(max(sse, 0) / n_))}


# -- venue shares -----------------------------------------------------------------------------


def rule_shares(venues: DataFrame, stations: DataFrame, params: ModelParams = DEFAULT_PARAMS) -> DataFrame:
    """Distance rule: Gaussian weights within the radius, else the two nearest stations; tiny shares dropped.

    Shares are normalised before the drop and kept as they are.
    """
    st = stations.select("station_key", "lat", "lon")
    near = within_km(venues, st, params.venue_radius_km).select("venue_key", "station_key", "km")
    lonely = venues.join(near.select("venue_key").distinct(), "venue_key", "left_anti")
    far = nearest(lonely, st, "venue_key", "station_key", 4 * params.venue_radius_km, k=2).select("venue_key", "station_key", "km")
    g = near.unionByName(far).withColumn("g", F.exp(-F.col("km") * F.col("km") / (2 * params.venue_sigma_km**2)))
    share = F.col("g") / F.sum("g").over(Window.partitionBy("venue_key"))
    return g.select("venue_key", "station_key", share.alias("share")).filter(F.col("share") > params.min_share)


def guard_split(learned: DataFrame, rule: DataFrame, min_rule: float = 0.2, keep: float = 0.5) -> DataFrame:
    """Keep part of a large rule share the data could not confirm, then renormalise."""
    venues = learned.select("venue_key").distinct()
    missing = rule.filter(F.col("share") >= min_rule).join(venues, "venue_key", "left_semi")
    missing = missing.join(learned.select("venue_key", "station_key"), ["venue_key", "station_key"], "left_anti")
    u = learned.select("venue_key", "station_key", "share").unionByName(missing.select("venue_key", "station_key", (F.col("share") * keep).alias("share")))
    return u.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy("venue_key")))


def departure_excess(cells: DataFrame, events: DataFrame, venues: DataFrame, stations: DataFrame, params: ModelParams = DEFAULT_PARAMS, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Excess in the two hours after each distinct (start, end) of a venue, per candidate station.

    ``cells`` needs reading, expected, ceiling. Event windows are exploded into slots and meet the
    cells in an equi-join on (station, slot).
    """
    from flowspark.operators.grid import window_spine

    shows = events.groupBy("venue_key", "start", "end").agg(F.sum("attendance").alias("attendance"))
    cand = within_km(venues, stations.select("station_key", "lat", "lon"), params.learn_radius_km).select("venue_key", "station_key")
    w = shows.select("venue_key", F.col("start").alias("s0"), F.col("end").alias("e0"), "attendance", F.col("end").alias("start"), (F.col("end") + F.expr("INTERVAL 2 HOURS")).alias("end"))
    slots = window_spine(w, clock, inclusive=False).filter(F.col("slot") >= F.col("e0"))
    j = slots.join(cand, "venue_key").join(cells.select("station_key", "slot", "reading", "expected", "ceiling"), ["station_key", "slot"])
    per_show = j.groupBy("venue_key", "station_key", "s0", "e0").agg(
        F.sum(F.col("reading") - F.col("expected")).alias("excess"), (F.sum(F.col("expected") * F.col("expected")) + 1).alias("var"),
        F.first("attendance").alias("attendance"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("reading") >= F.col("ceiling")).alias("capped"),
    )
    return per_show.groupBy("venue_key", "station_key").agg(
        F.sum("excess").alias("excess"), F.sum("var").alias("var"), F.sum("attendance").alias("attendance"), F.count(F.lit(1)).alias("shows"),
        F.sum("capped").alias("capped"), F.sum("n").alias("n"), (F.sum("excess") / F.sqrt(F.greatest(F.sum("var"), F.lit(1.0)))).alias("z"),
    )


def learn_by_excess(excess: DataFrame, min_z=6.0, keep_z=3.0, min_slots=2, capped_mle=0.15, ratio=(0.25, 1.0)) -> DataFrame:
    """Shares from departure excess where it is clear, a plausible part of the crowd, and readings are rarely at the ceiling."""
    v = Window.partitionBy("venue_key")
    x = excess.withColumn("max_z", F.max("z").over(v)).withColumn("capped_share", F.sum("capped").over(v) / F.sum("n").over(v))
    x = x.filter((F.col("shows") >= min_slots) & (F.col("attendance") > 0) & (F.col("capped_share") <= capped_mle))
    x = x.filter((F.col("z") >= keep_z) & (F.col("excess") > 0))
    x = x.withColumn("tot", F.sum("excess").over(v)).withColumn("ratio", F.col("tot") / F.greatest(F.max("attendance").over(v), F.lit(1)))
    x = x.filter((F.col("max_z") >= min_z) & F.col("ratio").between(*ratio))
    return x.select("venue_key", "station_key", (F.col("excess") / F.col("tot")).alias("share"), F.lit("excess").alias("method"))


def share_likelihood(load_cells: DataFrame, rounds: int = 3, points: int = 31, upper: float = 1.5) -> DataFrame:
    """Censored maximum likelihood of each (venue, station) share on a refined grid.

    ``load_cells`` holds (venue_key, station_key, reading, base, u, ceiling) with u the crowd a
    single station would see. Every round evaluates all grid points of all pairs in one
    aggregation; partial sums leave one row per pair and point to shuffle.
    """
    c = load_cells.filter("u > 0").select(
        "venue_key", "station_key", F.greatest("base", F.lit(0.5)).alias("b"), "u", "ceiling",
        (F.col("reading") >= F.col("ceiling")).alias("cens"), F.least(F.col("reading") + 0.5, F.col("ceiling").cast("double")).alias("xc"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    lam = F.col("b") + F.col("s") * F.col("u")
    nll = F.when(F.col("cens"), F.col("ceiling") / lam).otherwise(F.log(lam) + F.col("xc") / lam)
    rng = c.select("venue_key", "station_key").distinct().withColumn("lo", F.lit(0.0)).withColumn("hi", F.lit(upper))
    zero = c.withColumn("s", F.lit(0.0)).groupBy("venue_key", "station_key").agg(F.sum(nll).alias("nll0"), F.avg(F.col("cens").cast("double")).alias("capped"))
    zero = cut(zero)
    for _ in range(rounds):
        step = (F.col("hi") - F.col("lo")) / (points - 1)
        grid = rng.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select("venue_key", "station_key", (F.col("lo") + F.col("i") * step).alias("s"), step.alias("step"))
        g = c.join(grid, ["venue_key", "station_key"]).groupBy("venue_key", "station_key", "s", "step").agg(F.sum(nll).alias("nll"))
        best = cut(g.groupBy("venue_key", "station_key").agg(F.min_by("s", F.struct("nll", "s")).alias("share"), F.min("nll").alias("nll"), F.max("step").alias("step")))
        rng = best.select("venue_key", "station_key", F.greatest(F.col("share") - F.col("step"), F.lit(0.0)).alias("lo"), F.least(F.col("share") + F.col("step"), F.lit(upper)).alias("hi"))
    c.unpersist()
    return best.join(zero, ["venue_key", "station_key"]).select("venue_key", "station_key", "share", (2 * (F.col("nll0") - F.col("nll"))).alias("lr"), "capped")


def learn_by_likelihood(est: DataFrame, min_lr=4.0, min_share=0.03) -> DataFrame:
    x = est.filter((F.col("lr") >= min_lr) & (F.col("share") >= min_share))
    return x.select("venue_key", "station_key", (F.col("share") / F.sum("share").over(Window.partitionBy("venue_key"))).alias("share"), F.lit("censored likelihood").alias("method"))


def crowd_cells(cells: DataFrame, events: DataFrame, venues: DataFrame, stations: DataFrame, params: ModelParams = DEFAULT_PARAMS, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Cells of candidate stations that carry crowd load: input of the likelihood."""
    u = kernel_load(events, params, clock).groupBy("venue_key", "slot").agg(F.sum("load").alias("u"))
    cand = within_km(venues, stations.select("station_key", "lat", "lon"), params.learn_radius_km).select("venue_key", "station_key")
    return u.join(cand, "venue_key").join(cells.select("station_key", "slot", "reading", F.col("lam").alias("base"), "ceiling"), ["station_key", "slot"])


def learn_shares(normal: DataFrame, events: DataFrame, venues: DataFrame, stations: DataFrame, rule: DataFrame, params: ModelParams = DEFAULT_PARAMS, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Learned split per venue: excess method, or likelihood where crowds often meet the ceiling."""
    cells = normal.withColumn("expected", expected_reading("lam", "ceiling"))
    ex = departure_excess(cells, events, venues, stations, params, clock).persist()
    by_excess = learn_by_excess(ex)
    v = ex.groupBy("venue_key").agg((F.sum("capped") / F.sum("n")).alias("c"), F.max("shows").alias("shows"))
    hot = v.filter("c > 0.15 AND shows >= 2").select("venue_key")
    cc = crowd_cells(cells, events.join(hot, "venue_key", "left_semi"), venues, stations, params, clock)
    by_mle = learn_by_likelihood(share_likelihood(cc))
    learned = by_excess.unionByName(by_mle)
    split = guard_split(learned, rule)
    out = cut(split.join(learned.select("venue_key", "method").distinct(), "venue_key"))
    ex.unpersist()
    return out


def merge_shares(rule: DataFrame, learned: DataFrame | None) -> DataFrame:
    if learned is None:
        return rule
    rest = rule.join(learned.select("venue_key").distinct(), "venue_key", "left_anti")
    return learned.select("venue_key", "station_key", "share").unionByName(rest)


# -- whole fit --------------------------------------------------------------------------------


def station_table(cells: DataFrame, w: DataFrame) -> DataFrame:
    """Weight and ceiling of every station."""
    return ceilings(cells).join(w, "station_key", "left").na.fill(0.0, ["w"]).select("station_key", "w", "ceiling")


def fit_given_weather(cells, closures, venues, stations, weather_params: dict, iters=1, params=DEFAULT_PARAMS, clock=DEFAULT_CLOCK) -> Fit:
    """One round of updates with a known weather rule and the distance-rule shares."""
    w, p, m = fit_core(fit_grid(cells, closures, params, clock), iters)
    st = station_table(cells, w)
    return Fit(broadcast_if_small(cut(st)), F.broadcast(p), m, weather_params, cut(rule_shares(venues, stations, params)))


def fit(cells, closures, weather, events, venues, stations, iters=25, rounds=2, params: ModelParams = DEFAULT_PARAMS, clock: Clock = DEFAULT_CLOCK) -> Fit:
    """Full fit: factors, weather rule, learned shares; later rounds drop cells carrying event load."""
    from flowspark.model.expect import expected

    rule = cut(rule_shares(venues, stations, params))
    out, event_cells = None, None
    for _ in range(rounds):
        w, p, m = fit_core(fit_grid(cells, closures, params, clock, event_cells), iters)
        wx = fit_weather(m, weather, t_ref=params.t_ref)
        scale = float(np.exp(wx["a0"]))
        p = p.withColumn("p", F.col("p") * scale)
        m = m.withColumn("m", F.col("m") / scale)
        out = Fit(broadcast_if_small(cut(station_table(cells, w))), F.broadcast(cut(p)), m, wx, rule)
        normal = expected(out, cells, weather, None, closures, params, clock)
        learned = learn_shares(normal, events, venues, stations, rule, params, clock)
        out = replace(out, shares=cut(merge_shares(rule, learned)), learned=learned)
        event_cells = event_load(events, out.shares, params, clock).filter("event_load > 1.0").select("station_key", "slot")
    return out
