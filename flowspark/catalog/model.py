"""Demand model, expectation and risk on the bound tables."""

from pyspark.sql import functions as F

from flowspark.catalog.ctes import cte
from flowspark.catalog.registry import register
from flowspark.catalog.weather_energy import PARAMS
from flowspark.functions import time as t
from flowspark.model import expect as ex
from flowspark.model import fit as ft
from flowspark.operators import joins as jn
from flowspark.operators import stats as st
from flowspark.operators.weather import daily_temperature

CEIL15 = "CASE WHEN time_bucket(INTERVAL 15 MINUTE,\"end\")=\"end\" THEN \"end\" ELSE time_bucket(INTERVAL 15 MINUTE,\"end\")+INTERVAL 15 MINUTE END"
cte("ccells", "spine closures", 'SELECT closure_id, station_key, slot, day, tod, daytype FROM closures c JOIN spine s ON s.slot>=c.start AND s.slot<c."end"')
cte("reopen", "closures", f"SELECT closure_id, station_key, {CEIL15}+to_minutes(CAST(15*r AS BIGINT)) AS slot, r FROM closures, range(4) t(r)")
cte("gridc", "dense caps ccells reopen", """SELECT d.*, ceiling, least(reading+0.5::DOUBLE, ceiling) AS xc, CASE WHEN reading<ceiling THEN 1 ELSE 0 END AS unc, hour(slot)>=5 AND hour(slot)<13 AS morning FROM dense d JOIN caps USING(station_key)
WHERE ceiling>0 AND NOT EXISTS (SELECT 1 FROM ccells c WHERE c.station_key=d.station_key AND c.slot=d.slot) AND NOT EXISTS (SELECT 1 FROM reopen r WHERE r.station_key=d.station_key AND r.slot=d.slot)""")
cte("fw0", "gridc", "SELECT station_key, avg(xc) AS w FROM gridc GROUP BY 1")
cte("fm0", "gridc", "SELECT DISTINCT slot, 1.0::DOUBLE AS m FROM gridc")
N_ITERS = 3
for i in range(1, N_ITERS + 1):
    cte(f"fs{i}", f"gridc fw{i-1}", f"SELECT slot, daytype, tod, sum(xc/w) AS s, sum(unc) AS u FROM gridc JOIN fw{i-1} USING(station_key) GROUP BY 1,2,3")
    cte(f"fp{i}", f"fs{i} fm{i-1}", f"SELECT daytype, tod, sum(s/m)/greatest(sum(u),1) AS p FROM fs{i} JOIN fm{i-1} USING(slot) GROUP BY 1,2")
    cte(f"fm{i}", f"fs{i} fp{i}", f"SELECT slot, p, s/p/greatest(u,1) AS m FROM fs{i} JOIN fp{i} USING(daytype,tod)")
    cte(f"fw{i}", f"gridc fm{i}", f"SELECT station_key, sum(xc/(p*m))/greatest(sum(unc),1) AS w FROM gridc JOIN fm{i} USING(slot) WHERE morning GROUP BY 1")
cte("base", "dense fw1 fp1 caps wxm", "SELECT d.*, ceiling, coalesce(w,0)*p*multiplier AS base, prcp, tday FROM dense d LEFT JOIN fw1 USING(station_key) JOIN fp1 USING(daytype,tod) JOIN caps USING(station_key) JOIN (SELECT slot, multiplier, prcp, tday FROM wxm) x USING(slot)")
cte("ccd", "ccells", "SELECT DISTINCT station_key, slot FROM ccells")


def _lam(name, load, base="base"):
    cte(f"lost_{name}", f"ccells {base} eload", f"SELECT closure_id, c.station_key, sum(base+{load}) AS lost FROM ccells c JOIN {base} b ON b.station_key=c.station_key AND b.slot=c.slot LEFT JOIN eload e ON e.station_key=c.station_key AND e.slot=c.slot GROUP BY 1,2")
    cte(f"reb_{name}", f"reopen lost_{name}", f"SELECT r.station_key, r.slot, sum(lost*([0.39,0.12,0.05]::DOUBLE[])[r.r+1]) AS rebound FROM reopen r JOIN lost_{name} l ON l.closure_id=r.closure_id AND l.station_key=r.station_key WHERE r.r<3 GROUP BY 1,2")
    cte(f"lam_{name}", f"{base} eload ccd reb_{name}", f"SELECT b.*, {load} AS load, c.slot IS NOT NULL AS closed, CASE WHEN c.slot IS NOT NULL THEN 0::DOUBLE ELSE base+{load}+coalesce(rebound,0) END AS lam FROM {base} b LEFT JOIN eload e ON e.station_key=b.station_key AND e.slot=b.slot LEFT JOIN ccd c ON c.station_key=b.station_key AND c.slot=b.slot LEFT JOIN reb_{name} r ON r.station_key=b.station_key AND r.slot=b.slot")


_lam("full", "coalesce(event_load,0)")
_lam("none", "0::DOUBLE")
cte("base18", "base", "SELECT * REPLACE (base/exp(-0.0185::DOUBLE*(tday-18)+0.29::DOUBLE*(1-exp(-prcp/0.6::DOUBLE))) AS base) FROM base")
cte("basedry", "base", "SELECT * REPLACE (base/exp(0.29::DOUBLE*(1-exp(-prcp/0.6::DOUBLE))) AS base) FROM base")
_lam("n18", "0::DOUBLE", "base18")
_lam("ndry", "0::DOUBLE", "basedry")


def er(lam):
    return f"CASE WHEN {lam}>0 THEN greatest({lam}*(1-exp(-ceiling/{lam}))-0.5::DOUBLE,0) ELSE 0 END"


def qt(lam, p):
    return f"CASE WHEN {lam}>0 THEN least(floor(-{lam}*ln({1-p:.2f}::DOUBLE)),ceiling) ELSE 0 END"


cte("risk", "lam_full lam_none", f"SELECT *, CASE WHEN lam>0 THEN exp(-ceiling/lam) ELSE 0 END AS p, lam*CASE WHEN lam>0 THEN exp(-ceiling/lam) ELSE 0 END AS \"over\", greatest(lam-lam0,0) AS event_load, {er('lam')} AS expected, {er('lam0')} AS expected0 FROM (SELECT f.*, n.lam AS lam0 FROM lam_full f JOIN (SELECT station_key, slot, lam FROM lam_none) n USING(station_key, slot))")
cte("fc", "risk", f"SELECT *, {qt('lam',0.1)} AS q10, {qt('lam',0.9)} AS q90, {qt('lam',0.05)} AS q05, {qt('lam',0.95)} AS q95, {qt('lam0',0.95)} AS normal_q95 FROM risk")


def quick_fit(n):
    return ft.fit_given_weather(n.dense, n.closures, n.venues, n.stations, dict(PARAMS, t_ref=18.0), 1, n.params, n.clock)


def risk(n, fit=None):
    return ex.risk_table(fit or quick_fit(n), n.dense, n.weather, n.crowd_events, n.closures, n.params, n.clock)


@register("m1_ceilings", "station_key ceiling:i", ctes="caps", sql="SELECT * FROM caps")
def _(n):
    return st.ceilings(n.dense)


@register("m2_closure_mask", "closure_id:i closed_slots:i after_slots:i", ctes="ccells reopen", sql="SELECT closure_id, count(c.slot) closed_slots, any_value(a.n) after_slots FROM ccells c JOIN (SELECT closure_id, count(*) n FROM reopen GROUP BY 1) a USING(closure_id) GROUP BY 1")
def _(n):
    lo, hi = n.spine.agg(F.min("slot")).scalar(), n.spine.agg(F.max("slot")).scalar()
    c = jn.closed_slots(n.closures, n.clock).filter((F.col("slot") >= lo) & (F.col("slot") <= hi))
    c = c.groupBy("closure_id").agg(F.count(F.lit(1)).alias("closed_slots"))
    return c.join(jn.after_reopening(n.closures, 4, n.clock).groupBy("closure_id").agg(F.count(F.lit(1)).alias("after_slots")), "closure_id")


@register("m3_station_weights", "station_key w:f", ctes="fw3", sql="SELECT * FROM fw3")
def _(n):
    return ft.fit_core(ft.fit_grid(n.dense, n.closures, n.params, n.clock), N_ITERS)[0]


@register("a4_compare_to_model", "station_key day:d observed:i model:f2 without_events:f2 vs_model:f vs_without_events:f event_part:f", ctes="risk", sql="""
SELECT station_key, day, sum(reading) observed, sum(expected) model, sum(expected0) without_events, sum(reading)/nullif(sum(expected),0) vs_model, sum(reading)/nullif(sum(expected0),0) vs_without_events, (sum(expected)-sum(expected0))/nullif(sum(expected),0) event_part FROM risk GROUP BY 1,2""")
def _(n):
    return ex.compare_to_model(risk(n))


@register("m3_fitted_products", "day:d products:f n:i", ctes="gridc fw2 fm2", sql="SELECT day, avg(w*p*m) products, count(*) n FROM gridc JOIN fw2 USING(station_key) JOIN fm2 USING(slot) GROUP BY 1")
def _(n):
    grid = ft.fit_grid(n.dense, n.closures, n.params, n.clock)
    w, p, m = ft.fit_core(grid, 2)
    j = grid.filter("use").join(w, "station_key").join(p, ["daytype", "tod"]).join(m, "slot")
    return j.groupBy("day").agg(F.avg(F.col("w") * F.col("p") * F.col("m")).alias("products"), F.count(F.lit(1)).alias("n"))


@register("m4_weather_rule", "heat:f rain_max:f rain_scale:f resid_sd:f")
def _(n):
    """Bounded least squares on a refined grid; checked against brute force in the tests."""
    _, _, m = ft.fit_core(ft.fit_grid(n.dense, n.closures, n.params, n.clock), 1)
    wx = ft.fit_weather(m, n.weather)
    return n.spark.createDataFrame([(wx["heat"], wx["rain_max"], wx["rain_scale"], wx["resid_sd"])], "heat double, rain_max double, rain_scale double, resid_sd double")


@register("m5_daily_temperature", "day:d tday:f", ctes="tday", sql="SELECT * FROM tday")
def _(n):
    return daily_temperature(n.weather)


cte("shows", "crowd", 'SELECT venue_key, start, "end", sum(attendance) AS attendance FROM crowd GROUP BY 1,2,3')
cte("vexcess", "shows risk vkm", """SELECT venue_key, station_key, sum(excess) excess, sum(v) v, sum(attendance) attendance, count(*) shows, sum(capped) capped, sum(n) n, sum(excess)/sqrt(greatest(sum(v),1)) z FROM (
SELECT s.venue_key, k.station_key, s.start, s."end", any_value(s.attendance) attendance, sum(reading-expected0) excess, sum(expected0*expected0)+1 v, count_if(reading>=ceiling) capped, count(*) n
FROM shows s JOIN vkm k ON k.venue_key=s.venue_key AND k.km<=1.8 JOIN risk r ON r.station_key=k.station_key AND r.slot>=s."end" AND r.slot<s."end"+INTERVAL 2 HOUR GROUP BY 1,2,3,4) GROUP BY 1,2""")


@register("m6_departure_excess", "venue_key station_key excess:f2 attendance:i shows:i capped:i n:i z:f", ctes="vexcess", sql="SELECT * FROM vexcess")
def _(n):
    r = risk(n).withColumn("expected", F.col("expected0"))
    return ft.departure_excess(r, n.crowd_events, n.venues, n.stations, n.params, n.clock)


@register("m7_share_likelihood", "venue_key station_key share:f lr:f capped:f")
def _(n):
    """Refined-grid likelihood; checked against brute force in the tests."""
    r = risk(n)
    cc = ft.crowd_cells(r.select("station_key", "slot", "reading", F.col("lam0").alias("lam"), "ceiling"), n.crowd_events, n.venues, n.stations, n.params, n.clock)
    return ft.share_likelihood(cc)


@register("m8_rule_shares", "venue_key station_key share:f crowd:f", ctes="vshare crowd", sql="SELECT venue_key, station_key, share, share*a AS crowd FROM vshare JOIN (SELECT venue_key, sum(attendance) a FROM crowd GROUP BY 1) USING(venue_key)")
def _(n):
    a = n.crowd_events.groupBy("venue_key").agg(F.sum("attendance").alias("a"))
    return ft.rule_shares(n.venues, n.stations, n.params).join(a, "venue_key").withColumn("crowd", F.col("share") * F.col("a"))


@register("m9_guard_split", "venue_key station_key share:f", ctes="vshare vexcess", sql="""
WITH l AS (SELECT venue_key, station_key, excess/sum(excess) OVER (PARTITION BY venue_key) share FROM (SELECT * FROM vexcess WHERE excess>0 QUALIFY row_number() OVER (PARTITION BY venue_key ORDER BY excess DESC)=1)),
u AS (SELECT * FROM l UNION ALL SELECT venue_key, station_key, share*0.5::DOUBLE FROM vshare v WHERE share>=0.2 AND venue_key IN (SELECT venue_key FROM l) AND NOT EXISTS (SELECT 1 FROM l WHERE l.venue_key=v.venue_key AND l.station_key=v.station_key))
SELECT venue_key, station_key, share/sum(share) OVER (PARTITION BY venue_key) share FROM u""")
def _(n):
    from pyspark.sql import Window

    r = risk(n).withColumn("expected", F.col("expected0"))
    x = ft.departure_excess(r, n.crowd_events, n.venues, n.stations, n.params, n.clock).filter("excess > 0")
    top = x.withColumn("r", F.row_number().over(Window.partitionBy("venue_key").orderBy(F.col("excess").desc()))).filter("r = 1")
    return ft.guard_split(top.select("venue_key", "station_key", F.lit(1.0).alias("share")), ft.rule_shares(n.venues, n.stations, n.params))


@register("r1_base_lambda", "station_key day:d base:f2", ctes="base", sql="SELECT station_key, day, sum(base) AS base FROM base GROUP BY 1,2")
def _(n):
    return ex.base_lambda(quick_fit(n), n.dense, n.weather).groupBy("station_key", "day").agg(F.sum("base").alias("base"))


@register("r2_event_load", "station_key slot:t event_load:f", ctes="eload", sql="SELECT * FROM eload")
def _(n):
    return jn.event_load(n.crowd_events, ft.rule_shares(n.venues, n.stations, n.params), n.params, n.clock)


@register("r3_closure_effect", "station_key closed_cells:i lam:f2 before:f2", ctes="lam_full", sql="SELECT station_key, count_if(closed) closed_cells, sum(lam) lam, sum(base+load) AS before FROM lam_full GROUP BY 1")
def _(n):
    e = ex.expected(quick_fit(n), n.dense, n.weather, n.crowd_events, n.closures, n.params, n.clock)
    return e.groupBy("station_key").agg(F.count_if("closed").alias("closed_cells"), F.sum("lam").alias("lam"), F.sum(F.col("base") + F.col("event_load")).alias("before"))


@register("r4_expected", "station_key day:d lam:f2 lam0:f2 expected:f2 expected0:f2", ctes="risk", sql="SELECT station_key, day, sum(lam) lam, sum(lam0) lam0, sum(expected) expected, sum(expected0) expected0 FROM risk GROUP BY 1,2")
def _(n):
    return risk(n).groupBy("station_key", "day").agg(*[F.sum(c).alias(c) for c in ("lam", "lam0", "expected", "expected0")])


@register("r4b_forecast", "station_key tod:i q10:f2 q90:f2 q05:f2 q95:f2 normal_q95:f2 p:f inside_80:i", ctes="fc", sql="SELECT station_key, tod, sum(q10) q10, sum(q90) q90, sum(q05) q05, sum(q95) q95, sum(normal_q95) normal_q95, avg(p) p, count_if(reading BETWEEN q10 AND q90) inside_80 FROM fc GROUP BY 1,2")
def _(n):
    f = ex.forecast(risk(n))
    return f.groupBy("station_key", "tod").agg(*[F.sum(c).alias(c) for c in ("q10", "q90", "q05", "q95", "normal_q95")], F.avg("p").alias("p"), F.count_if("inside_80").alias("inside_80"))


@register("r4d_explain", "station_key day:d driver n:i lam:f2", ctes="risk", sql="""
SELECT station_key, day, driver, count(*) n, sum(lam) lam FROM (SELECT station_key, day, lam, unnest(list_filter([CASE WHEN closed THEN 'closure' END, CASE WHEN event_load>1 THEN 'event' END, CASE WHEN prcp>0.2 THEN 'rain' END, CASE WHEN NOT closed AND lam0>base+1 THEN 'reopening' END], lambda x: x IS NOT NULL)) driver FROM risk) GROUP BY 1,2,3""")
def _(n):
    e = ex.explain(risk(n)).withColumn("driver", F.explode("drivers"))
    return e.groupBy("station_key", "day", "driver").agg(F.count(F.lit(1)).alias("n"), F.sum("lam").alias("lam"))


@register("r4e_capacity_risk", "station_key day:d exp_slots_at_ceiling:f p_any_slot_at_ceiling:f peak_lambda_over_ceiling:f peak_slot:t exp_pax_above_ceiling:f", ctes="risk", sql="""
SELECT station_key, day, sum(p) exp_slots_at_ceiling, 1-exp(sum(ln(1-p))) p_any_slot_at_ceiling, max(lam/nullif(ceiling,0)) peak_lambda_over_ceiling, first(slot ORDER BY lam DESC, slot) peak_slot, sum("over") exp_pax_above_ceiling FROM risk GROUP BY 1,2""")
def _(n):
    return ex.capacity_risk(risk(n), ("station_key", "day"))


@register("r4e_top_by_volume", "station_key exp_pax_above_ceiling:f2 ceiling:i", ctes="risk", sql='SELECT station_key, sum("over") exp_pax_above_ceiling, any_value(ceiling) ceiling FROM risk GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10')
def _(n):
    return ex.capacity_risk(risk(n), sort_by="exp_pax_above_ceiling", top=10)


@register("r4f_event_impact", "crowd_id:i station_key extra:f baseline:f p_max:f slots:i", ctes="crowd kload vshare base", sql="""
WITH w AS (SELECT c.crowd_id, c.venue_key, s.station_key, s.share, b.slot, b.base, b.ceiling FROM crowd c JOIN vshare s USING(venue_key) JOIN base b ON b.station_key=s.station_key AND b.slot>=c.start-INTERVAL 90 MINUTE AND b.slot<=c."end"+INTERVAL 135 MINUTE),
l AS (SELECT crowd_id, slot, sum(load) load FROM kload GROUP BY 1,2)
SELECT w.crowd_id, station_key, sum(coalesce(load,0)*share) extra, sum(base) baseline, max(exp(-ceiling/(base+coalesce(load,0)*share))) p_max, count(*) slots FROM w LEFT JOIN l ON l.crowd_id=w.crowd_id AND l.slot=w.slot GROUP BY 1,2""")
def _(n):
    from flowspark.plans.events import event_impact

    return event_impact(quick_fit(n), n.crowd_events, n.weather, n.params, n.clock)


@register("r4g_snapshot", "slot:t station_key reading:i above_normal:f ratio:f rank:i", ctes="risk", sql="""
SELECT slot, station_key, reading, reading-round(expected0) above_normal, round(reading/greatest(round(expected0),1),1) ratio, row_number() OVER (PARTITION BY slot ORDER BY reading-round(expected0) DESC, station_key) rank FROM risk WHERE tod IN (12,52) QUALIFY row_number() OVER (PARTITION BY slot ORDER BY reading-round(expected0) DESC, station_key)<=5""")
def _(n):
    return ex.snapshot(risk(n).filter(F.col("tod").isin(12, 52)), 5)


@register("r4g_snapshot_phases", "slot:t crowd_id:i venue_key attendance:i phase", ctes="spine crowd", sql="""
SELECT slot, crowd_id, venue_key, attendance, CASE WHEN slot>=start-INTERVAL 90 MINUTE AND slot<=start+INTERVAL 15 MINUTE THEN 'arrivals' WHEN slot>start AND slot<"end" THEN 'in progress' ELSE 'departures' END phase FROM spine JOIN crowd ON slot>=start-INTERVAL 90 MINUTE AND slot<="end"+INTERVAL 120 MINUTE""")
def _(n):
    return ex.snapshot_phases(n.spine, n.crowd_events, n.clock)


@register("a3_rank_vs_expected", "station_key value:f network_median:f", ctes="risk", sql="SELECT station_key, value, median(value) OVER () AS network_median FROM (SELECT station_key, sum(reading)/greatest(sum(expected),1) AS value FROM risk GROUP BY 1) ORDER BY value DESC, station_key LIMIT 25")
def _(n):
    return st.rank_stations(n.dense, None, "vs_expected", top=25, expected=risk(n))


@register("a31_calibration_days", "day:d observed:i expected:f2 ratio:f", ctes="risk", sql="SELECT day, sum(reading) observed, sum(expected) expected, sum(reading)/sum(expected) ratio FROM risk GROUP BY 1")
def _(n):
    return ex.calibration_by_day(risk(n))


@register("a31_far_station_days", "station_key day:d observed:i ratio:f", ctes="risk", sql="SELECT station_key, day, sum(reading) observed, sum(reading)/sum(expected) ratio FROM risk GROUP BY 1,2 HAVING sum(expected)>2000 AND sum(reading)>0 ORDER BY abs(ln(sum(reading)/sum(expected))) DESC, 1, 2 LIMIT 6")
def _(n):
    return ex.far_station_days(risk(n))


@register("a32_backtest", "total_ratio:f event_ratio:f ceiling_expected:f ceiling_observed:i hour_ratio_min:f hour_ratio_max:f ceiling_corr:f daily_corr:f daily_error_pct:f", ctes="risk", sql="""
WITH h AS (SELECT hour(slot) h, sum(reading)/sum(expected) r FROM risk WHERE hour(slot)>0 GROUP BY 1), s AS (SELECT station_key, sum(p) e, count_if(reading>=ceiling) o FROM risk GROUP BY 1), d AS (SELECT day, sum(reading) o, sum(expected) e FROM risk GROUP BY 1)
SELECT sum(reading)/sum(expected) total_ratio, sum(reading) FILTER (event_load>50)/sum(expected) FILTER (event_load>50) event_ratio, sum(p) ceiling_expected, count_if(reading>=ceiling) ceiling_observed, (SELECT min(r) FROM h) hour_ratio_min, (SELECT max(r) FROM h) hour_ratio_max,
(SELECT covar_pop(e,o)/nullif(stddev_pop(e)*stddev_pop(o),0) FROM s) ceiling_corr, (SELECT corr(o,e) FROM d) daily_corr, (SELECT avg(abs(o-e)/o)*100 FROM d) daily_error_pct FROM risk""")
def _(n):
    return ex.backtest(risk(n))


@register("a33_band_coverage", "inside_80:f inside_90:f above_95:f", ctes="fc", sql="""
SELECT avg(CASE WHEN reading BETWEEN q10 AND q90 THEN 1.0 ELSE 0 END) inside_80, avg(CASE WHEN reading BETWEEN q05 AND q95 THEN 1.0 ELSE 0 END) inside_90, avg(CASE WHEN reading>q95 THEN 1.0 ELSE 0 END) above_95 FROM fc WHERE lam>5""")
def _(n):
    return ex.band_coverage(ex.forecast(risk(n)))


@register("r12_replay_frames", "slot:t log_ratio:f size:f p:f", ctes="risk", sql="SELECT slot, sum(greatest(-2,least(3,log2((reading+1)/(expected0+1))))) log_ratio, sum(6+18*sqrt(reading/600)) size, max(p) p FROM risk GROUP BY 1")
def _(n):
    f = ex.replay_frames(risk(n))
    return f.groupBy("slot").agg(F.sum("log_ratio").alias("log_ratio"), F.sum("size").alias("size"), F.max("p").alias("p"))
