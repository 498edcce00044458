"""Events, closures, anomalies and plans on the bound tables."""

from pyspark.sql import functions as F

from flowspark.catalog.ctes import cte, hav
from flowspark.catalog.model import er, quick_fit
from flowspark.catalog.model import risk as lazy_risk
from flowspark.catalog.network import levels
from flowspark.catalog.registry import register
from flowspark.functions.lineage import cut
from flowspark.functions import time as t
from flowspark.functions.noise import expected_reading, over_capacity, quantile
from flowspark.model import expect as ex
from flowspark.model import fit as ft
from flowspark.operators import anomalies as an
from flowspark.operators import closures as cl
from flowspark.operators import energy as en
from flowspark.operators import events as ev
from flowspark.operators import graph as g
from flowspark.operators import joins as jn
from flowspark.operators import peaks as pk
from flowspark.operators import stats as st
from flowspark.operators import weather as wx
from flowspark.operators import windows as win
from flowspark.plans import messages as msg
from flowspark.plans import operations as op
from flowspark.plans import reports as rp
from flowspark.plans import scenarios as sc


def risk(n, fit=None):
    """Risk table, written once to the checkpoint folder because the reports read it several times."""
    return cut(lazy_risk(n, fit))


def shares(n):
    return ft.rule_shares(n.venues, n.stations, n.params)


def parsed_suspensions(n):
    return cl.parse_closures(n.suspensions, n.stations, n.line_stops)


# -- events -----------------------------------------------------------------------------------
cte("gigs", "crowd", 'SELECT venue_key, start, "end", min(crowd_id) AS show_id, sum(attendance) AS attendance, count(*) AS listings FROM crowd GROUP BY 1,2,3')
cte("phase", "gigs", """SELECT show_id, venue_key, attendance, 'arrival' AS phase, start-INTERVAL 90 MINUTE AS lo, start+INTERVAL 15 MINUTE AS hi FROM gigs UNION ALL SELECT show_id, venue_key, attendance, 'departure', "end", "end"+INTERVAL 120 MINUTE FROM gigs""")
cte("evrep", "phase vshare risk", """SELECT show_id, p.venue_key, phase, attendance, r.station_key, sum(reading) AS observed, sum(expected0) AS normal, sum(expected) AS model, sum(reading)-sum(expected0) AS excess, (sum(reading)-sum(expected0))/sqrt(sum(expected0*expected0)+1) AS z, count_if(reading>=ceiling) AS ceiling_hits
FROM phase p JOIN vshare v USING(venue_key) JOIN risk r ON r.station_key=v.station_key AND r.slot>=p.lo AND r.slot<p.hi GROUP BY 1,2,3,4,5""")


@register("e1_e2_event_report", "show_id:i venue_key phase station_key observed:i normal:f2 model:f2 excess:f2 z:f ceiling_hits:i", ctes="evrep", sql="SELECT * FROM evrep")
def _(n):
    return ev.event_report(risk(n), n.crowd_events, shares(n), n.clock)


@register("e2_phase_totals", "show_id:i phase observed:i extra:f2 extra_share:f", ctes="evrep", sql="SELECT show_id, phase, sum(observed) observed, sum(excess) extra, sum(excess)/greatest(any_value(attendance),1) extra_share FROM evrep GROUP BY 1,2")
def _(n):
    return ev.phase_totals(ev.event_report(risk(n), n.crowd_events, shares(n), n.clock))


@register("e2_other_dates", "venue_key show_id:i extra:f2 others:i mean_other_extra:f2", ctes="evrep", sql="""
WITH d AS (SELECT venue_key, show_id, sum(excess) extra FROM evrep WHERE phase='departure' GROUP BY 1,2) SELECT a.venue_key, a.show_id, a.extra, count(b.show_id) others, avg(b.extra) mean_other_extra FROM d a LEFT JOIN d b ON b.venue_key=a.venue_key AND b.show_id<>a.show_id GROUP BY 1,2,3""")
def _(n):
    return ev.other_dates(ev.event_report(risk(n), n.crowd_events, shares(n), n.clock))


@register("e3_list_events", "venue_key start:t end:t attendance:i listings:i names:a", ctes="crowd", sql="""
SELECT venue_key, start, max("end") AS "end", sum(attendance) attendance, count(*) listings, list_slice(list_sort(list(DISTINCT event_name)),1,3) AS names FROM crowd WHERE CAST(start-INTERVAL 5 HOUR AS DATE)>=DATE '2024-01-03' GROUP BY 1,2 HAVING sum(attendance)>=1600""")
def _(n):
    return ev.list_events(n.crowd_events, shares(n), date_from="2024-01-03", min_attendance=1600)


@register("e3_top_shares", "venue_key station_key share:f2 attendance:i", ctes="vshare crowd", sql="""
SELECT venue_key, station_key, round(share,2) share, attendance FROM (SELECT *, row_number() OVER (PARTITION BY venue_key ORDER BY share DESC, station_key) r FROM vshare) JOIN (SELECT venue_key, sum(attendance) attendance FROM crowd GROUP BY 1) USING(venue_key) WHERE r<=4""")
def _(n):
    a = n.crowd_events.groupBy("venue_key").agg(F.sum("attendance").alias("attendance"))
    return ev.top_shares(shares(n)).select("venue_key", F.explode("stations").alias("station_key", "share")).join(a, "venue_key")


cte("vnear", "vkm", "SELECT venue_key, station_key, km FROM vkm QUALIFY row_number() OVER (PARTITION BY venue_key ORDER BY km, station_key)=1")


@register("e4_venue_patterns", "venue_key station_key km:f past_events:i avg_attendance:f event_days:i event_peak:f normal_peak:f uplift_pct:f", ctes="vnear crowd fulld dense", sql="""
WITH d AS (SELECT venue_key, CAST(start AS DATE) cday, min(start)-INTERVAL 90 MINUTE lo, max("end")+INTERVAL 120 MINUTE hi FROM crowd GROUP BY 1,2), days AS (SELECT DISTINCT cday FROM fulld),
o AS (SELECT d.venue_key, d.cday, max(reading) peak FROM d JOIN days USING(cday) JOIN vnear v USING(venue_key) JOIN dense c ON c.station_key=v.station_key AND c.slot>=d.lo AND c.slot<d.hi GROUP BY 1,2),
q AS (SELECT d.venue_key, d.cday, r.cday rday, max(reading) peak FROM d JOIN days USING(cday) JOIN vnear v USING(venue_key) JOIN days r ON isodow(r.cday)=isodow(d.cday) JOIN dense c ON c.station_key=v.station_key AND c.slot>=d.lo+(r.cday-d.cday)*INTERVAL 1 DAY AND c.slot<d.hi+(r.cday-d.cday)*INTERVAL 1 DAY WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.venue_key=d.venue_key AND x.cday=r.cday) GROUP BY 1,2,3)
SELECT g.*, event_days, event_peak, normal_peak, CASE WHEN normal_peak>0 THEN (event_peak/normal_peak-1)*100 END uplift_pct FROM (SELECT venue_key, station_key, km, count(*) past_events, avg(attendance) avg_attendance FROM crowd JOIN vnear USING(venue_key) GROUP BY 1,2,3) g
LEFT JOIN (SELECT venue_key, count(*) event_days, avg(peak) event_peak FROM o GROUP BY 1) USING(venue_key) LEFT JOIN (SELECT venue_key, avg(peak) normal_peak FROM q GROUP BY 1) USING(venue_key)""")
def _(n):
    return ev.venue_patterns(n.dense, n.crowd_events, n.venues, n.stations)


cte("picks", "crowd vkm", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cday ORDER BY depth, attendance DESC, crowd_id) AS pick FROM (SELECT * FROM (SELECT crowd_id, c.venue_key, CAST(start AS DATE) AS cday, attendance, start, "end", station_key, km, depth FROM crowd c JOIN (SELECT *, row_number() OVER (PARTITION BY venue_key ORDER BY km, station_key) AS depth FROM vkm WHERE km<=1.5) v ON v.venue_key=c.venue_key WHERE depth<=3) QUALIFY row_number() OVER (PARTITION BY cday, station_key ORDER BY depth, attendance DESC, crowd_id)=1)) WHERE pick<=3""")


@register("e5_phase_peaks", "crowd_id:i cday:d station_key phase peak:i slot:t pct:f status", ctes="picks dense caps", sql="""
WITH h AS (SELECT crowd_id, cday, station_key, hour(start) s, CASE WHEN hour("end")<hour(start) THEN 24 ELSE hour("end") END e FROM picks), p AS (SELECT crowd_id, cday, station_key, 'arrival' phase, greatest(0,s-2) h0, s h1 FROM h UNION ALL SELECT crowd_id, cday, station_key, 'departure', e, least(24,e+2) FROM h)
SELECT *, CASE WHEN pct>=90 THEN 'CRITICAL' WHEN pct>=70 THEN 'ELEVATED' ELSE 'NORMAL' END status FROM (SELECT crowd_id, cday, p.station_key, phase, max(reading) peak, first(slot ORDER BY reading DESC, slot) slot, round(max(reading)/any_value(ceiling)*100,1) pct
FROM p JOIN dense d ON d.station_key=p.station_key AND CAST(d.slot AS DATE)=p.cday AND hour(d.slot)>=h0 AND hour(d.slot)<h1 JOIN caps ON caps.station_key=p.station_key GROUP BY 1,2,3,4)""")
def _(n):
    return ev.phase_peaks(n.dense, ev.station_picks(n.crowd_events, n.venues, n.stations))


@register("e6_weather_peaks", "day:d start:t last_slot:t max_rain:f peak_slot:t peak:i typical:f ratio:f net_rank:i at_ceiling:i observed:i no_rain:f2 with_rain:f2", ctes="dense caps weather lam_full risk ccd eload reb_full base", sql=f"""
WITH gi AS (SELECT *, sum(nw) OVER (PARTITION BY day ORDER BY slot) g FROM (SELECT *, CASE WHEN slot-lag(slot) OVER (PARTITION BY day ORDER BY slot)<=INTERVAL 15 MINUTE THEN 0 ELSE 1 END nw FROM weather WHERE prcp>0)), b AS (SELECT day, max(prcp) max_rain, first(g ORDER BY prcp DESC, slot) g FROM gi GROUP BY 1),
w AS (SELECT day, max_rain, min(slot) s0, max(slot) s1 FROM gi JOIN b USING(day, g) GROUP BY 1,2), net AS (SELECT day, tod, slot, sum(reading) v FROM dense GROUP BY 1,2,3), rk AS (SELECT *, rank() OVER (ORDER BY v DESC) net_rank FROM net),
dry AS (SELECT day FROM weather GROUP BY 1 HAVING sum(prcp)/4<14), ty AS (SELECT w.day, n.tod, median(o.v) typical FROM w JOIN net n ON n.day=w.day AND n.slot BETWEEN s0 AND s1 JOIN net o ON o.tod=n.tod AND o.day<>w.day AND isodow(o.day)=isodow(w.day) AND o.day IN (SELECT day FROM dry) GROUP BY 1,2),
pk AS (SELECT w.day, first(r.slot ORDER BY r.v DESC, r.slot) peak_slot FROM w JOIN rk r ON r.day=w.day AND r.slot BETWEEN s0 AND s1 GROUP BY 1),
dlam AS (SELECT b.station_key, b.slot, b.ceiling, CASE WHEN c.slot IS NOT NULL THEN 0::DOUBLE ELSE b.base/exp(0.29::DOUBLE*(1-exp(-b.prcp/0.6::DOUBLE)))+coalesce(event_load,0) END AS lam FROM base b LEFT JOIN eload e USING(station_key, slot) LEFT JOIN ccd c USING(station_key, slot)),
tot AS (SELECT w.day, sum(r.reading) observed, sum(r.expected) with_rain, sum({er('dl.lam').replace('ceiling','dl.ceiling')}) no_rain FROM w JOIN risk r ON r.day=w.day AND r.slot BETWEEN s0 AND s1 JOIN dlam dl ON dl.station_key=r.station_key AND dl.slot=r.slot GROUP BY 1),
cc AS (SELECT slot, count_if(reading>=ceiling) at_ceiling FROM dense JOIN caps USING(station_key) GROUP BY 1)
SELECT w.day, s0 AS start, s1 last_slot, max_rain, peak_slot, v peak, typical, v/typical ratio, net_rank, at_ceiling, observed, no_rain, with_rain FROM w JOIN pk USING(day) JOIN rk ON rk.slot=pk.peak_slot LEFT JOIN ty ON ty.day=w.day AND ty.tod=rk.tod JOIN tot ON tot.day=w.day JOIN cc ON cc.slot=pk.peak_slot""")
def _(n):
    f = quick_fit(n)
    dry = ex.base_lambda(f, n.dense, n.weather.withColumn("prcp", F.lit(0.0)))
    load = jn.event_load(n.crowd_events, f.shares, n.params, n.clock)
    shut = jn.closed_slots(n.closures, n.clock).select("station_key", "slot").distinct().withColumn("x", F.lit(1))
    dry = dry.join(load, ["station_key", "slot"], "left").join(shut, ["station_key", "slot"], "left")
    lam = F.when(F.col("x").isNotNull(), F.lit(0.0)).otherwise(F.col("base") + F.coalesce("event_load", F.lit(0.0)))
    dry = dry.select("station_key", "slot", expected_reading(lam, "ceiling").alias("expected_dry"))
    return pk.weather_peaks(risk(n, f), n.weather, dry, st.ceilings(n.dense), dry_mm=14.0)


@register("e7_weather_peak_flows", "week:d station_key total:i rank:i", ctes="dense weather", sql="""
WITH k AS (SELECT CAST(date_trunc('week',slot) AS DATE) AS week, first(slot ORDER BY prcp DESC, slot) p FROM weather GROUP BY 1), h AS (SELECT week, CAST(p AS DATE) d, greatest(0,hour(p)-1) h0, least(24,hour(p)+2) h1 FROM k),
s AS (SELECT week, station_key, sum(reading) total FROM h JOIN dense ON CAST(slot AS DATE)=d AND hour(slot)>=h0 AND hour(slot)<h1 GROUP BY 1,2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY total DESC, station_key) rank FROM s) WHERE rank<=3""")
def _(n):
    return pk.weather_peak_flows(n.dense, wx.weather_outliers(n.weather, "prcp"))


# -- closures ---------------------------------------------------------------------------------
@register("e8_list_closures", "closure_id:i kind minutes:i duration reason", ctes="closures", sql="""
SELECT closure_id, 'station' kind, m AS "minutes", CAST(m//60 AS VARCHAR)||' h '||lpad(CAST(m%60 AS VARCHAR),2,'0')||' min' duration, regexp_extract(description,'due to (.+?)\\.?$',1) reason FROM (SELECT *, CAST(floor(epoch("end"-start)/60) AS BIGINT) m FROM closures) WHERE CAST(start-INTERVAL 5 HOUR AS DATE)>=DATE '2024-01-04'""")
def _(n):
    return cl.list_closures(n.closures, date_from="2024-01-04")


@register("f3_parse_closures", "closure_id:i kind line stations:a issues:i", ctes="closures suspensions line_stops", sql="""
SELECT closure_id, 'station' kind, NULL AS line, [station_key] AS stations, 0 issues FROM closures UNION ALL
SELECT closure_id, 'line', s.line, list(l.station_key ORDER BY l.seq), 0 FROM suspensions s JOIN line_stops l ON l.line=s.line AND l.seq BETWEEN sa AND sb GROUP BY 1,2,3""")
def _(n):
    texts = n.closures.select("closure_id", "start", "end", "description").unionByName(n.suspensions)
    return cl.parse_closures(texts, n.stations, n.line_stops, n.edges).withColumn("issues", F.size("issues"))


@register("a7_closed_and_silent", "closure_id:i station_key slots:i zero_slots:i is_closed:b", ctes="ccells dense", sql="SELECT closure_id, c.station_key, count(*) slots, count_if(reading=0) zero_slots, bool_and(reading=0) is_closed FROM ccells c JOIN dense d ON d.station_key=c.station_key AND d.slot=c.slot GROUP BY 1,2")
def _(n):
    return cl.closed_and_silent(n.dense, n.closures, n.clock)


@register("a26_closures_summary", "dimension value n:i hours:f2", ctes="closures suspensions", sql="""
WITH c AS (SELECT 'station' kind, '-' AS line, description, epoch("end"-start)/3600 h FROM closures UNION ALL SELECT 'line', line, description, epoch("end"-start)/3600 FROM suspensions),
d AS (SELECT 'kind' dimension, kind AS value, h FROM c UNION ALL SELECT 'line', line, h FROM c UNION ALL SELECT 'cause', CASE WHEN description LIKE '%due to track maintenance.' THEN 'Gleisbau' ELSE 'Unbekannt' END, h FROM c)
SELECT dimension, value, count(*) n, sum(h) AS hours FROM d GROUP BY 1,2""")
def _(n):
    a = n.closures.withColumn("line", F.lit(None).cast("string")).select("kind", "line", "description", "start", "end")
    return cl.closures_summary(a.unionByName(parsed_suspensions(n).select("kind", "line", "description", "start", "end")))


@register("a27_disruptions_per_line", "line n:i hours:f2", ctes="closures suspensions stations", sql="""
SELECT line, count(*) n, sum(h) AS hours FROM (SELECT unnest(lines) AS line, epoch("end"-start)/3600 h FROM closures JOIN stations USING(station_key) UNION ALL SELECT line, epoch("end"-start)/3600 FROM suspensions) GROUP BY 1""")
def _(n):
    a = n.closures.withColumn("line", F.lit(None).cast("string")).select("kind", "line", "stations", "start", "end")
    return cl.disruptions_per_line(a.unionByName(parsed_suspensions(n).select("kind", "line", "stations", "start", "end")), n.stations)


cte("srole", "suspensions line_stops", "SELECT closure_id, s.start, s.\"end\", s.line, l.station_key, CASE WHEN l.seq IN (sa,sb) THEN 'end' ELSE 'interior' END AS role FROM suspensions s JOIN line_stops l ON l.line=s.line AND l.seq BETWEEN sa AND sb")
IMPACT = """
WITH x AS (SELECT r.closure_id, r.station_key, r.role, d.slot, d.reading, (SELECT avg(o.reading) FROM fulld o WHERE o.station_key=d.station_key AND o.wd=isodow(d.slot)-1 AND o.hm=strftime(d.slot,'%H:%M') AND o.slot<>d.slot) m FROM {roles} r JOIN dense d ON d.station_key=r.station_key AND d.slot>=r.start AND d.slot<r."end")
SELECT closure_id, station_key, role, sum(reading) observed, sum(m) expected, count(*) slots, CASE WHEN sum(m)>0 THEN (sum(reading)/sum(m)-1)*100 END change_pct FROM x GROUP BY 1,2,3"""


@register("e10_closure_impact", "closure_id:i station_key role observed:i expected:f2 slots:i change_pct:f", ctes="srole fulld dense", sql=IMPACT.format(roles="srole"))
def _(n):
    p = parsed_suspensions(n)
    return cl.closure_impact(n.dense, cl.section_roles(p), p, n.clock)


cte("sband", "srole e2 nodes hops", """SELECT closure_id, start, "end", station_key, hops, CASE WHEN hops BETWEEN 1 AND 2 THEN 'near' WHEN hops>=5 THEN 'far' WHEN hops=0 THEN 'section' ELSE 'middle' END AS role FROM (SELECT closure_id, start, "end", h.node AS station_key, min(hops) AS hops FROM srole s JOIN hops h ON h.source=s.station_key GROUP BY 1,2,3,4)""")
cte("simp", "sband fulld dense", IMPACT.format(roles="sband"))
cte("rtest", "simp", "SELECT *, near_pct>far_pct AS near_rose_more FROM (SELECT closure_id, avg(change_pct) FILTER (role='near') AS near_pct, avg(change_pct) FILTER (role='far') AS far_pct FROM simp WHERE expected>0 GROUP BY 1)")


def routing(n):
    p = parsed_suspensions(n)
    bands = cl.hop_bands(cl.section_roles(p), n.edges)
    return cl.routing_test(cl.closure_impact(n.dense, bands, p, n.clock))


@register("e12_routing_test", "closure_id:i near_pct:f far_pct:f near_rose_more:b", ctes="rtest", sql="SELECT * FROM rtest")
def _(n):
    return routing(n)


@register("f11_sign_test", "k:i n:i p_value:f", ctes="rtest", sql="""
WITH s AS (SELECT count_if(near_rose_more) k, count(*) n FROM rtest WHERE near_pct IS NOT NULL AND far_pct IS NOT NULL)
SELECT k, n, least(1.0, 2*(SELECT sum(exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)-n*ln(2.0::DOUBLE))) FROM range(0, CAST(least(k,n-k)+1 AS BIGINT)) r(i))) p_value FROM s""")
def _(n):
    return cl.sign_test(routing(n))


@register("e11_disruption_response", "role extra:f2 expected:f2 change:f z:f", ctes="risk closures srole e2 stations", sql=f"""
WITH w AS (SELECT closure_id, station_key kk, start s, "end" e FROM closures), nb AS (SELECT closure_id, dst station_key, 'adjacent' role, s, e FROM w JOIN e2 ON src=kk),
wk AS (SELECT closure_id, b.station_key, 'walkable' role, s, e FROM w JOIN stations a ON a.station_key=kk JOIN stations b ON b.station_key<>kk WHERE {hav('a', 'b')}<=2.0 AND NOT EXISTS (SELECT 1 FROM e2 WHERE src=kk AND dst=b.station_key)),
r AS (SELECT * FROM nb UNION ALL SELECT * FROM wk UNION ALL SELECT closure_id, station_key, 'susp_'||role, start, "end" FROM srole)
SELECT role, sum(reading-expected) extra, sum(expected) expected, sum(reading-expected)/greatest(sum(expected),1) change, sum(reading-expected)/sqrt(greatest(sum(expected*expected),1)) z FROM r JOIN risk x ON x.station_key=r.station_key AND x.slot>=r.s AND x.slot<r.e GROUP BY 1""")
def _(n):
    return pk.disruption_response(risk(n), n.closures, parsed_suspensions(n), n.edges, n.stations, 2.0, n.clock)


@register("e9_closure_report", "closure_id:i role stations:i observed:i expected:f2 change_pct:f", ctes="risk srole", sql="""
SELECT closure_id, role, count(DISTINCT x.station_key) stations, sum(reading) observed, sum(expected) expected, (sum(reading)/greatest(sum(expected),1)-1)*100 change_pct FROM srole r JOIN risk x ON x.station_key=r.station_key AND x.slot>=r.start AND x.slot<r."end" GROUP BY 1,2""")
def _(n):
    return pk.closure_groups(risk(n), parsed_suspensions(n), n.clock)


cte("shares_out", "srole stations alts", """SELECT closure_id, start, "end", donor, other AS receiver, wt/sum(wt) OVER (PARTITION BY closure_id, donor) AS weight FROM (SELECT r.closure_id, r.start, r."end", r.station_key AS donor, other, 1/greatest(km,0.2::DOUBLE) wt, row_number() OVER (PARTITION BY r.closure_id, r.station_key ORDER BY km, other) k FROM srole r JOIN stations s ON s.station_key=r.station_key JOIN alts a ON a.station_key=r.station_key AND km<=3.0
WHERE r.role='interior' AND len(s.lines)=1 AND len(list_filter(a.lb, lambda x: x<>r.line))>0) WHERE k<=4""")


@register("r4j_suspension", "closure_id:i station_key lambda_mean:f2 p_max:f p_any:f plan_mean:f2 plan_p_any:f", ctes="shares_out srole stations risk", sql="""
WITH wt AS (SELECT DISTINCT closure_id, start, "end", station_key FROM (SELECT r.closure_id, r.start, r."end", r.station_key FROM srole r JOIN stations s USING(station_key) WHERE NOT (role='interior' AND len(s.lines)=1) UNION ALL SELECT closure_id, start, "end", receiver FROM shares_out)),
mv AS (SELECT o.closure_id, receiver station_key, r.slot, sum(weight*lam) moved FROM shares_out o JOIN risk r ON r.station_key=donor AND r.slot>=time_bucket(INTERVAL 15 MINUTE, o.start) AND r.slot<o."end" GROUP BY 1,2,3),
j AS (SELECT w.closure_id, w.station_key, r.lam, r.ceiling, r.lam+coalesce(moved,0) AS pl FROM wt w JOIN risk r ON r.station_key=w.station_key AND r.slot>=time_bucket(INTERVAL 15 MINUTE, w.start) AND r.slot<w."end" LEFT JOIN mv ON mv.closure_id=w.closure_id AND mv.station_key=w.station_key AND mv.slot=r.slot)
SELECT closure_id, station_key, avg(lam) lambda_mean, max(CASE WHEN lam>0 THEN exp(-ceiling/lam) ELSE 0 END) p_max, 1-exp(sum(ln(1-CASE WHEN lam>0 THEN exp(-ceiling/lam) ELSE 0 END))) p_any, avg(pl) plan_mean, 1-exp(sum(ln(1-CASE WHEN pl>0 THEN exp(-ceiling/pl) ELSE 0 END))) plan_p_any FROM j GROUP BY 1,2""")
def _(n):
    return sc.suspension_scenario(risk(n), parsed_suspensions(n), n.stations, walk_km=3.0, clock=n.clock)


# -- anomalies --------------------------------------------------------------------------------
@register("e14_event_checks", "show_id:i phase observed:i normal:f2 z:f", ctes="phase vshare risk", sql="""
SELECT show_id, phase, sum(reading) observed, sum(expected0) normal, (sum(reading)-sum(expected0))/greatest(sqrt(sum(expected0*expected0)),1) z FROM phase p JOIN vshare v USING(venue_key) JOIN risk r ON r.station_key=v.station_key AND r.slot>=p.lo AND r.slot<p.hi GROUP BY 1,2""")
def _(n):
    return ev.event_checks(risk(n), n.crowd_events, shares(n), n.clock)


@register("e14_spikes", "day:d spikes:i", ctes="risk", sql="SELECT day, count_if(reading>8*lam AND lam>3) spikes FROM risk GROUP BY 1")
def _(n):
    return an.spikes(risk(n))


cte("stday", "dense closures crowd vshare", """SELECT s.station_key, s.day, v, EXISTS (SELECT 1 FROM closures c WHERE c.station_key=s.station_key AND CAST(c.start-INTERVAL 5 HOUR AS DATE)=s.day) AS shut, EXISTS (SELECT 1 FROM crowd c JOIN vshare h USING(venue_key) WHERE h.station_key=s.station_key AND CAST(c.start-INTERVAL 5 HOUR AS DATE)=s.day) AS split FROM (SELECT station_key, day, CAST(sum(reading) AS DOUBLE) v FROM dense GROUP BY 1,2) s""")


@register("e14_station_days", "station_key day:d observed:f normal:f n:i z:f", ctes="stday", sql="""
SELECT * FROM (SELECT a.station_key, a.day, a.v observed, avg(o.v) normal, count(*) n, (a.v-avg(o.v))/stddev_samp(o.v) z FROM stday a JOIN stday o ON o.station_key=a.station_key AND isodow(o.day)=isodow(a.day) AND o.day<>a.day AND NOT o.shut WHERE NOT a.shut AND NOT a.split GROUP BY 1,2,3 HAVING count(*)>=2 AND stddev_samp(o.v)>0) WHERE abs(z)>=2""")
def _(n):
    return an.station_day_findings(st.daily_totals(n.dense), n.closures, n.crowd_events, shares(n), 2, 2.0, n.clock)


def _dry(n, f):
    d = ex.expected(f, n.dense, n.weather.withColumn("prcp", F.lit(0.0)), n.crowd_events, n.closures, n.params, n.clock)
    return d.select("station_key", "slot", expected_reading("lam", "ceiling").alias("expected_dry"))


@register("e14_anomaly_scan", "day:d rank:i type where observed:f2 normal:f2 score:f")
def _(n):
    """All detectors ranked per day; its parts have SQL twins of their own."""
    f = quick_fit(n)
    r = risk(n, f)
    s = shares(n)
    return an.anomaly_scan(
        ev.event_checks(r, n.crowd_events, s, n.clock), an.rain_findings(r, n.weather, _dry(n, f), clock=n.clock),
        an.station_day_findings(st.daily_totals(n.dense), n.closures, n.crowd_events, s, 2, 3.0, n.clock), an.unexplained(r))


@register("e14_energy_residuals", "line day:d z:f", ctes="ldays", sql="""
WITH m AS (SELECT line, regr_slope(mwh,riders) b1, regr_intercept(mwh,riders) b0 FROM ldays GROUP BY 1), r AS (SELECT *, mwh-(b0+b1*riders) resid FROM ldays JOIN m USING(line)) SELECT line, day, resid/stddev_pop(resid) OVER (PARTITION BY line) z FROM r""")
def _(n):
    d = en.line_days(n.daily_station, n.energy, n.stations)
    return an.energy_residual_z(d, en.energy_model(d))


@register("e15_spill_over", "show_id:i day:d station_key km:f observed:i z:f", ctes="gigs vkm vshare risk", sql="""
WITH s AS (SELECT *, CAST(start-INTERVAL 5 HOUR AS DATE) AS day FROM gigs), sp AS (SELECT DISTINCT day, station_key FROM s JOIN vshare USING(venue_key)),
c AS (SELECT show_id, day, k.station_key, km, "end" e0 FROM s JOIN vkm k ON k.venue_key=s.venue_key AND km<=2.5 WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.day=s.day AND sp.station_key=k.station_key) QUALIFY rank() OVER (PARTITION BY day, k.station_key ORDER BY km)=1)
SELECT * FROM (SELECT show_id, c.day, c.station_key, km, sum(reading) observed, (sum(reading)-sum(expected0))/sqrt(sum(expected0*expected0)+1) z FROM c JOIN risk r ON r.station_key=c.station_key AND r.slot>=c.e0 AND r.slot<=c.e0+INTERVAL 105 MINUTE GROUP BY 1,2,3,4) WHERE z>0.5""")
def _(n):
    return an.spill_over(risk(n), n.crowd_events, shares(n), n.venues, n.stations, min_z=0.5, clock=n.clock)


# -- peaks and small reports ------------------------------------------------------------------
@register("a17_peak_time", "station_key wd_time wd_peak:f median_peak:f all_peak:f rank:i mean_of_peaks:f verdict pm_am_ratio:f ceiling_share:f", ctes="dense caps", sql="""
WITH p AS (SELECT station_key, tod, avg(reading) FILTER (daytype=0) m, median(reading) FILTER (daytype=0) md, avg(reading) a FROM dense GROUP BY 1,2),
g AS (SELECT station_key, first(tod ORDER BY m DESC, tod) wt, max(m) wd_peak, max(md) median_peak, max(a) all_peak FROM p GROUP BY 1),
r AS (SELECT station_key, avg(v) FILTER (k='pm')/nullif(avg(v) FILTER (k='am'),0) pm_am_ratio FROM (SELECT station_key, day, CASE WHEN tod BETWEEN 8 AND 15 THEN 'am' WHEN tod BETWEEN 48 AND 55 THEN 'pm' END k, avg(reading) v FROM dense WHERE daytype=0 AND (tod BETWEEN 8 AND 15 OR tod BETWEEN 48 AND 55) GROUP BY 1,2,3) GROUP BY 1),
c AS (SELECT station_key, avg(CASE WHEN mx>=ceiling THEN 1.0 ELSE 0 END) ceiling_share FROM (SELECT station_key, day, max(reading) mx FROM dense WHERE daytype=0 GROUP BY 1,2) JOIN caps USING(station_key) GROUP BY 1)
SELECT station_key, lpad(CAST(((wt*15+300)%1440)//60 AS VARCHAR),2,'0')||':'||lpad(CAST((wt*15)%60 AS VARCHAR),2,'0') wd_time, wd_peak, median_peak, all_peak, rank() OVER (ORDER BY wd_peak DESC) rank, avg(wd_peak) OVER () mean_of_peaks,
CASE WHEN abs(wd_peak/avg(wd_peak) OVER ()-1)*100<2 THEN 'about equal' WHEN wd_peak>avg(wd_peak) OVER () THEN 'above' ELSE 'below' END verdict, pm_am_ratio, ceiling_share FROM g JOIN r USING(station_key) JOIN c USING(station_key)""")
def _(n):
    return pk.peak_time(n.dense, st.ceilings(n.dense), n.clock)


@register("a17_ratio_interval", "station_key lo:f hi:f")
def _(n):
    """Bootstrap over days with a seeded draw; no brute-force test yet."""
    return pk.ratio_interval(n.dense, 1000)


@register("a18_load_status", "station_key peak_mean:f station_max:i pct:f status", ctes="fulld caps", sql="""
SELECT *, CASE WHEN pct>=90 THEN 'CRITICAL' WHEN pct>=70 THEN 'ELEVATED' ELSE 'NORMAL' END status FROM (SELECT station_key, max(m) peak_mean, any_value(ceiling) station_max, max(m)/any_value(ceiling)*100 pct FROM (SELECT station_key, hm, avg(reading) m FROM fulld WHERE wd<5 GROUP BY 1,2) JOIN caps USING(station_key) GROUP BY 1)""")
def _(n):
    return pk.load_status(st.tod_profile(n.dense, "weekday"), st.ceilings(n.dense))


@register("a29_hotspot_venues", "venue_key n:i largest:i largest_name", ctes="crowd", sql="SELECT venue_key, count(*) n, max(attendance) largest, first(event_name ORDER BY attendance DESC, crowd_id) largest_name FROM crowd WHERE segment='Music' GROUP BY 1 ORDER BY n DESC, venue_key LIMIT 3")
def _(n):
    return ev.hotspot_venues(n.crowd_events)


@register("a29_events_matching", "event_name n:i attendance:i", ctes="crowd", sql="SELECT event_name, count(*) n, sum(attendance) attendance FROM crowd WHERE lower(event_name) LIKE '%show 1%' GROUP BY 1")
def _(n):
    return ev.events_matching(n.crowd_events, "Show 1").groupBy("event_name").agg(F.count(F.lit(1)).alias("n"), F.sum("attendance").alias("attendance"))


@register("a30_feedback_rollup", "kind up:i down:i up_share:f last_comment:i", sql="""
SELECT event_type AS kind, count_if(value>=50) up, count_if(value<50) down, count_if(value>=50)/count(*) up_share, first(event_id ORDER BY ts DESC, event_id DESC) last_comment FROM events GROUP BY 1""")
def _(n):
    e = n.raw("events").select(F.col("event_type").alias("kind"), F.when(F.col("value") >= 50, "up").otherwise("down").alias("rating"), F.col("ts").alias("time"), F.col("event_id").alias("comment"))
    return pk.feedback_rollup(e)


@register("e16_station_info", "station_key lines:a weekday_mean:f ceiling:i adjacent:a walkable:i venues_nearby:i largest_share:f am_peak:f pm_peak:f closures:i", ctes="stations levels caps e2 vkm vshare dense closures", sql=f"""
SELECT s.station_key, lines, weekday_mean, ceiling, (SELECT list(dst ORDER BY dst) FROM e2 WHERE src=s.station_key) adjacent, (SELECT count(*) FROM stations o WHERE o.station_key<>s.station_key AND {hav('s', 'o')}<=2.0) walkable,
(SELECT count(*) FROM vkm k WHERE k.station_key=s.station_key AND km<=2.0) venues_nearby, coalesce((SELECT max(share) FROM vshare v JOIN vkm k USING(venue_key, station_key) WHERE v.station_key=s.station_key AND km<=2.0),0) largest_share, am_peak, pm_peak, (SELECT count(*) FROM closures c WHERE c.station_key=s.station_key) closures
FROM stations s JOIN levels USING(station_key) JOIN caps USING(station_key) JOIN (SELECT station_key, max(m) FILTER (tod BETWEEN 4 AND 20) am_peak, max(m) FILTER (tod BETWEEN 40 AND 60) pm_peak FROM (SELECT station_key, tod, avg(reading) m FROM dense WHERE daytype=0 GROUP BY 1,2) GROUP BY 1) USING(station_key)""")
def _(n):
    prof = n.dense.filter("daytype = 0").groupBy("station_key", "tod").agg(F.avg("reading").alias("mean"))
    return rp.station_info(n.stations, n.edges, levels(n), st.ceilings(n.dense), prof, n.venues, shares(n), n.closures, 2.0)


# -- plans ------------------------------------------------------------------------------------
def reference(n, f, tmean=None):
    """Normal day: no events, dry; 18 degrees, or the day's own temperature."""
    dry = n.weather.withColumn("prcp", F.lit(0.0))
    if tmean is not None:
        dry = dry.withColumn("temp", F.lit(float(tmean)))
    d = ex.expected(f, n.dense, dry, None, n.closures, n.params, n.clock)
    return d.select("station_key", "slot", over_capacity("lam", "ceiling").alias("over_ref"))


def staff_values(n, tmean=18.0):
    f = quick_fit(n)
    return cut(op.staff_value(risk(n, f), reference(n, f, tmean)))


cte("values18", "risk lam_n18", "SELECT r.*, over_ref, greatest(\"over\"-over_ref,0) AS extra, greatest(\"over\"-over_ref,0)+0.3::DOUBLE*event_load AS value FROM risk r JOIN (SELECT station_key, slot, lam*CASE WHEN lam>0 THEN exp(-ceiling/lam) ELSE 0 END AS over_ref FROM lam_n18) USING(station_key, slot)")


@register("r5_staff_values", "station_key day:d extra:f2 value:f2", ctes="values18", sql="SELECT station_key, day, sum(extra) extra, sum(value) AS value FROM values18 GROUP BY 1,2")
def _(n):
    return staff_values(n).groupBy("station_key", "day").agg(F.sum("extra").alias("extra"), F.sum("value").alias("value"))


@register("r5_staff_plan", "day:d station_key tod_from:i tod_to:i staff:i extra_above_capacity:f2 event_crowd:f2 peak_chance:f")
def _(n):
    """Greedy placement; the tests compare it with a sequential greedy."""
    v = staff_values(n)
    return op.staff_roster(op.staff_picks(v, 10, 2.0), v)


cte("watch", "risk", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 6) DESC, station_key DESC, tod_from DESC) AS rank FROM (
SELECT * FROM (SELECT f.station_key, f.day, tod_from, tod_to, sum(r."over")+0.2::DOUBLE*sum(r.event_load) AS score, max(r.p) AS p_max, first(r.tod ORDER BY r.event_load DESC, r.tod) AS tod_event_peak FROM (
SELECT station_key, day, g, min(tod) tod_from, max(tod) tod_to FROM (SELECT *, sum(nw) OVER (PARTITION BY station_key, day ORDER BY tod) g FROM (SELECT *, CASE WHEN tod-lag(tod) OVER (PARTITION BY station_key, day ORDER BY tod)<=2 THEN 0 ELSE 1 END nw FROM risk WHERE p>=0.15 OR event_load>=greatest(30,0.3*lam0))) GROUP BY 1,2,3) f
JOIN risk r ON r.station_key=f.station_key AND r.day=f.day AND r.tod BETWEEN tod_from AND tod_to GROUP BY 1,2,3,4) QUALIFY row_number() OVER (PARTITION BY day, station_key ORDER BY round(score, 6) DESC, tod_from DESC)<=2)) WHERE rank<=8""")


@register("r6_watch_windows", "day:d rank:i station_key tod_from:i tod_to:i score:f2 p_max:f", ctes="watch", sql="SELECT * FROM watch")
def _(n):
    return op.watch_windows(risk(n))


def action(n, r):
    w = op.watch_windows(r)
    return op.action_plan(w, op.window_cells(w, r))


@register("r6_action_plan", "day:d rank:i station_key surge_min:f surge_max:f plan_max:f near_capacity:f peak_slot:t surge_fired:t plan_fired:t near_fired:t", ctes="watch fc", sql="""
WITH c AS (SELECT w.day, w.rank, w.station_key, f.tod, f.slot, reading, lam, q95, normal_q95, ceiling*0.9::DOUBLE nr FROM watch w JOIN fc f ON f.station_key=w.station_key AND f.day=w.day AND f.tod BETWEEN greatest(tod_from-1,0) AND least(tod_to+1,79)),
x AS (SELECT *, reading>normal_q95 AND lag(reading) OVER v>lag(normal_q95) OVER v su, reading>q95 AND lag(reading) OVER v>lag(q95) OVER v ab FROM c WINDOW v AS (PARTITION BY day, rank ORDER BY tod))
SELECT day, rank, any_value(station_key) station_key, min(normal_q95) surge_min, max(normal_q95) surge_max, max(q95) plan_max, max(nr) near_capacity, first(slot ORDER BY lam DESC, tod) peak_slot, min(slot) FILTER (su) surge_fired, min(slot) FILTER (ab) plan_fired, min(slot) FILTER (reading>=nr) near_fired FROM x GROUP BY 1,2""")
def _(n):
    return action(n, risk(n))


@register("r6_window_reasons", "day:d rank:i reason reason_event:i", ctes="watch crowd vshare spine", sql="""
WITH e AS (SELECT s.day, s.tod, v.station_key, crowd_id, CASE WHEN s.slot<=start+INTERVAL 15 MINUTE THEN 'arrivals' ELSE 'departures' END ph FROM crowd c JOIN vshare v USING(venue_key) JOIN spine s ON (s.slot>=start-INTERVAL 90 MINUTE AND s.slot<=start+INTERVAL 15 MINUTE) OR (s.slot>="end" AND s.slot<="end"+INTERVAL 120 MINUTE))
SELECT w.day, rank, coalesce(first(ph ORDER BY crowd_id),'peak hour') reason, min(crowd_id) reason_event FROM watch w LEFT JOIN e ON e.day=w.day AND e.tod=w.tod_event_peak AND e.station_key=w.station_key GROUP BY 1,2""")
def _(n):
    return op.event_reasons(op.watch_windows(risk(n)), n.crowd_events, shares(n), clock=n.clock)


cte("valuesd", "risk lam_ndry", "SELECT r.*, over_ref, greatest(\"over\"-over_ref,0) AS extra FROM risk r JOIN (SELECT station_key, slot, lam*CASE WHEN lam>0 THEN exp(-ceiling/lam) ELSE 0 END AS over_ref FROM lam_ndry) USING(station_key, slot)")
LOW = op.ModeAssumptions(min_extra_slot=2.0, min_extra_window=5.0)


@register("r7_overload_windows", "day:d rank:i station_key tod_from:i tod_to:i score:f2", ctes="valuesd", sql="""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 6) DESC, station_key DESC, tod_from DESC) rank FROM (SELECT f.station_key, f.day, tod_from, tod_to, sum(r.extra) score FROM (SELECT station_key, day, g, min(tod) tod_from, max(tod) tod_to FROM (SELECT *, sum(nw) OVER (PARTITION BY station_key, day ORDER BY tod) g FROM (
SELECT *, CASE WHEN tod-lag(tod) OVER (PARTITION BY station_key, day ORDER BY tod)<=2 THEN 0 ELSE 1 END nw FROM valuesd WHERE extra>=2)) GROUP BY 1,2,3) f JOIN valuesd r ON r.station_key=f.station_key AND r.day=f.day AND r.tod BETWEEN tod_from AND tod_to GROUP BY 1,2,3,4) WHERE score>=5) WHERE rank<=6""")
def _(n):
    return op.overload_windows(staff_values(n, None), LOW, 6)


def reinforcement(n, a=LOW, top=6):
    return op.reinforcement_plan(staff_values(n, None), n.stations, n.weather, a, top, n.clock)


@register("r7_reinforcement_plan", "day:d rank:i station_key df:i trains_absorb:f rail_absorb:f ground1:f ground2:f bike_absorb:f taxi_absorb:f meter_per_hour:f extra_total:f2 residual_total:f2")
def _(n):
    """Mode by mode absorption; no brute-force test yet."""
    return reinforcement(n)


@register("r7_line_needs", "day:d line tod_from:i tod_to:i trains:i")
def _(n):
    """Extra trains per line after merging windows."""
    return op.line_needs(reinforcement(n), n.stations)


SCEN = [("dry13", 13.0, 0.0), ("dry18", 18.0, 0.0), ("rain13", 13.0, 1.5), ("rain18", 18.0, 1.5)]


def scenario_risk(n):
    s = n.spark.createDataFrame(SCEN, "scenario_id string, tmean double, prcp double")
    cells = sc.scenario_cells(n.dense, s)
    c = n.closures.withColumn("scenario_id", F.explode(F.array(*[F.lit(x[0]) for x in SCEN])))
    return ex.risk_table(quick_fit(n), cells, None, sc.scenario_events(n.crowd_events, s), c, n.params, n.clock, ["scenario_id"])


cte("scen", "", "SELECT * FROM (VALUES ('dry13',13.0::DOUBLE,0.0::DOUBLE),('dry18',18.0,0.0),('rain13',13.0,1.5),('rain18',18.0,1.5)) v(scenario_id, tm, pr)")
cte("sbase", "base18 scen", "SELECT b.station_key, b.slot, b.day, b.tod, b.ceiling, scenario_id, base*exp(-0.0185::DOUBLE*(tm-18)+0.29::DOUBLE*(1-exp(-pr/0.6::DOUBLE))) AS base FROM base18 b CROSS JOIN scen")
cte("slost", "ccells sbase eload", "SELECT scenario_id, closure_id, c.station_key, sum(base+coalesce(event_load,0)) AS lost FROM ccells c JOIN sbase b ON b.station_key=c.station_key AND b.slot=c.slot LEFT JOIN eload e ON e.station_key=c.station_key AND e.slot=c.slot GROUP BY 1,2,3")
cte("srisk", "sbase eload ccd slost reopen", f"""SELECT *, lam*CASE WHEN lam>0 THEN exp(-ceiling/lam) ELSE 0 END AS "over", CASE WHEN lam>0 THEN exp(-ceiling/lam) ELSE 0 END AS p, {er('lam')} AS expected FROM (SELECT b.*, CASE WHEN c.slot IS NOT NULL THEN 0::DOUBLE ELSE base+coalesce(event_load,0)+coalesce(rebound,0) END AS lam FROM sbase b LEFT JOIN eload e ON e.station_key=b.station_key AND e.slot=b.slot LEFT JOIN ccd c ON c.station_key=b.station_key AND c.slot=b.slot
LEFT JOIN (SELECT scenario_id, r.station_key, r.slot, sum(lost*([0.39,0.12,0.05]::DOUBLE[])[r.r+1]) AS rebound FROM reopen r JOIN slost l ON l.closure_id=r.closure_id AND l.station_key=r.station_key WHERE r.r<3 GROUP BY 1,2,3) x ON x.scenario_id=b.scenario_id AND x.station_key=b.station_key AND x.slot=b.slot)""")


@register("r4h_scenario_summary", "scenario_id day:d expected_passengers:f2 above_capacity:f2 stations_likely_at_ceiling:i", ctes="srisk", sql="""
SELECT scenario_id, day, sum(e) expected_passengers, sum(o) above_capacity, count_if(p>=0.5) stations_likely_at_ceiling FROM (SELECT scenario_id, day, station_key, sum(expected) e, sum("over") o, max(p) p FROM srisk GROUP BY 1,2,3) GROUP BY 1,2""")
def _(n):
    return sc.scenario_summary(scenario_risk(n))


@register("r4h_compare_scenarios", "scenario_id day:d rank:i station_key passengers_change:f2 above_capacity_change:f2 p_base:f p_scenario:f", ctes="srisk", sql="""
WITH p AS (SELECT scenario_id, day, station_key, sum(expected) e, sum("over") o, max(p) p FROM srisk GROUP BY 1,2,3), j AS (SELECT a.*, a.e-b.e de, a.o-b.o dd, b.p p0 FROM p a JOIN p b ON b.scenario_id='dry18' AND b.day=a.day AND b.station_key=a.station_key WHERE a.scenario_id<>'dry18')
SELECT scenario_id, day, rank, station_key, de passengers_change, dd above_capacity_change, p0 p_base, p p_scenario FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, day ORDER BY round(abs(dd)+0.02::DOUBLE*abs(de),6) DESC, station_key) rank FROM j) WHERE rank<=5 AND (abs(de)>=1 OR abs(dd)>=1)""")
def _(n):
    return sc.compare_scenarios(scenario_risk(n), "dry18", 5)


@register("r4c_scenario_weather", "day:d in_data:b tmean:f prcp:f n:i", ctes="spine tday weather", sql="""
SELECT day, in_data, avg(tm) tmean, sum(pr) prcp, count(*) n FROM (SELECT s.day, true in_data, tday tm, prcp pr FROM spine s JOIN tday USING(day) JOIN weather w ON w.slot=s.slot UNION ALL SELECT day+40, false, 16.0, 0.0 FROM spine) GROUP BY 1,2""")
def _(n):
    later = n.spine.select(F.date_add("day", 40).alias("day"), (F.col("slot") + t.minutes(40 * 1440)).alias("slot"))
    r = sc.resolve_weather(n.spine.select("day", "slot").unionByName(later), n.weather)
    return r.groupBy("day", "in_data").agg(F.avg("tmean").alias("tmean"), F.sum("prcp").alias("prcp"), F.count(F.lit(1)).alias("n"))


@register("r4i_diversion", "show_id:i station_key is_alternative:b share_pct:i peak_ratio:f2")
def _(n):
    """Peak demand over ceiling for diverted shares 0 to 60 percent; no brute-force test yet."""
    return sc.diversion(quick_fit(n), n.crowd_events, n.venues, n.stations, n.weather, 2.6, n.params, n.clock)


@register("r4i_capacity_limited", "show_id:i share_pct:i")
def _(n):
    return sc.capacity_limited_share(sc.diversion(quick_fit(n), n.crowd_events, n.venues, n.stations, n.weather, 2.6, n.params, n.clock))


@register("r8_daily_brief", "day:d section rank:i payload")
def _(n):
    """All brief sections of all days in one table."""
    f = quick_fit(n)
    r = risk(n, f)
    v = cut(op.staff_value(r, reference(n, f, 18.0)))
    roster = op.staff_roster(op.staff_picks(v, 10), v)
    plan = op.reinforcement_plan(cut(op.staff_value(r, reference(n, f))), n.stations, n.weather, LOW, 6, n.clock)
    return rp.daily_brief(r, n.weather, n.crowd_events, n.closures, op.watch_windows(r, 6), roster, plan, n.clock)


def fired(n, r):
    c = r.withColumn("q95", quantile("lam0", "ceiling", 0.95)).withColumn("q99", quantile("lam0", "ceiling", 0.99)).withColumn("expected", F.col("expected0"))
    return win.long_rules(win.alert_rules(c))


@register("r9_early_warning", "rule alerts:i alerts_per_day:f share_explained:f detected:i events_detected:f median_delay:f score:f", ctes="fc dense gigs vshare spine reopen", sql=f"""
WITH a AS (SELECT *, {"CASE WHEN lam0>0 THEN least(floor(-lam0*ln(0.01::DOUBLE)),ceiling) ELSE 0 END"} q99n FROM fc),
f0 AS (SELECT *, reading>normal_q95 AND lag(reading) OVER w>lag(normal_q95) OVER w AS r1, reading>normal_q95 AND lag(reading) OVER w>lag(normal_q95) OVER w AND lag(reading,2) OVER w>lag(normal_q95,2) OVER w AS r2, reading>q99n AND lag(reading) OVER w>lag(q99n) OVER w AS r3,
count(*) OVER v=4 AND (sum(reading) OVER v-sum(expected0) OVER v)/sqrt(greatest(sum(expected0*expected0) OVER v,1))>3 AS r4 FROM a WINDOW w AS (PARTITION BY station_key, day ORDER BY tod), v AS (PARTITION BY station_key, day ORDER BY tod ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
fr AS (SELECT rule, station_key, slot, day, tod, CAST(day-DATE '1970-01-01' AS BIGINT)*80+tod op FROM (SELECT station_key, slot, day, tod, r1, r2, r3, r4 FROM f0) UNPIVOT (fired FOR rule IN (r1 AS 'R1', r2 AS 'R2', r3 AS 'R3', r4 AS 'R4')) WHERE fired),
ep AS (SELECT * FROM fr QUALIFY op-coalesce(lag(op) OVER (PARTITION BY rule, station_key ORDER BY op),-1000)>4),
cz AS (SELECT r.station_key, r.slot, max(CASE WHEN event_load>greatest(20,0.3*lam0) OR prcp>=0.5 OR EXISTS (SELECT 1 FROM reopen q WHERE q.station_key=r.station_key AND q.slot=r.slot) THEN 1 ELSE 0 END) OVER (PARTITION BY r.station_key ORDER BY r.day, r.tod ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ex FROM fc r),
big AS (SELECT *, time_bucket(INTERVAL 15 MINUTE,"end") e0 FROM gigs WHERE attendance>=1000 AND venue_key IN (SELECT venue_key FROM vshare WHERE share>=0.2)),
sl AS (SELECT show_id, venue_key, s.slot, row_number() OVER (PARTITION BY show_id ORDER BY s.slot)-1 step FROM big JOIN spine s ON s.slot>=e0 AND s.slot<e0+INTERVAL 120 MINUTE),
dt AS (SELECT rule, show_id, min(step)*15 delay FROM sl JOIN vshare v ON v.venue_key=sl.venue_key AND share>=0.2 JOIN fr ON fr.station_key=v.station_key AND fr.slot=sl.slot GROUP BY 1,2)
SELECT a.rule, alerts, alerts/(SELECT count(DISTINCT day) FROM dense) alerts_per_day, se share_explained, coalesce(det,0) detected, coalesce(det,0)/(SELECT count(*) FROM big) events_detected, md median_delay, se*coalesce(det,0)/(SELECT count(*) FROM big) score FROM (SELECT rule, count(*) alerts, avg(ex) se FROM ep JOIN cz USING(station_key, slot) GROUP BY 1) a LEFT JOIN (SELECT rule, count(*) det, median(delay) md FROM dt GROUP BY 1) USING(rule)""")
def _(n):
    r = risk(n)
    days = n.spine.select("day").distinct().agg(F.count(F.lit(1))).scalar()
    return rp.early_warning(fired(n, r), rp.causes(r, n.closures, clock=n.clock), n.crowd_events, shares(n), days, clock=n.clock)


@register("r9_planning_coverage", "event_ceiling_readings:i flagged_in_advance:i event_windows:i confirmed:i")
def _(n):
    """Counts over the watch windows of all days."""
    r = risk(n)
    w = op.event_reasons(op.watch_windows(r, 12), n.crowd_events, shares(n), clock=n.clock)
    return rp.planning_coverage(r, w, fired(n, r))


@register("r9_reinforcement_value", "day:d extra:f2 absorbed:f2 residual:f2 share_absorbed:f")
def _(n):
    return rp.reinforcement_value(reinforcement(n, LOW, 20))


@register("r10_closure_losses", "closure_id:i station_key lost:f2 recorded:i recorded_after:i", ctes="ccells reopen base eload dense", sql=f"""
WITH o AS (SELECT b.station_key, b.slot, b.reading, b.ceiling, base+coalesce(event_load,0) AS lam FROM base b LEFT JOIN eload e ON e.station_key=b.station_key AND e.slot=b.slot)
SELECT l.*, ra recorded_after FROM (SELECT closure_id, c.station_key, sum({er('lam')}) lost, sum(reading) recorded FROM ccells c JOIN o ON o.station_key=c.station_key AND o.slot=c.slot GROUP BY 1,2) l LEFT JOIN (SELECT closure_id, r.station_key, sum(reading) ra FROM reopen r JOIN dense d ON d.station_key=r.station_key AND d.slot=r.slot WHERE r<3 GROUP BY 1,2) a USING(closure_id, station_key)""")
def _(n):
    return rp.closure_losses(opened(n, quick_fit(n)), n.closures, n.clock)


def opened(n, f):
    e = ex.expected(f, n.dense, n.weather, n.crowd_events, None, n.params, n.clock)
    return e.withColumn("open_expected", expected_reading("lam", "ceiling"))


@register("r10_incident_report", "day:d section rank:i payload")
def _(n):
    """Content of the incident report of every day, section by section."""
    f = quick_fit(n)
    r, s = risk(n, f), shares(n)
    v = cut(op.staff_value(r, reference(n, f, 18.0)))
    plan = op.reinforcement_plan(cut(op.staff_value(r, reference(n, f))), n.stations, n.weather, LOW, 8, n.clock)
    w = op.watch_windows(r, 8)
    brief = rp.daily_brief(r, n.weather, n.crowd_events, n.closures, w, op.staff_roster(op.staff_picks(v, 10), v), plan, n.clock)
    checks = ev.event_checks(r, n.crowd_events, s, n.clock)
    find = an.anomaly_scan(checks, an.rain_findings(r, n.weather, _dry(n, f), clock=n.clock), an.station_day_findings(st.daily_totals(n.dense), n.closures, n.crowd_events, s, clock=n.clock), an.unexplained(r))
    tot = checks.filter("phase = 'departure'").withColumn("extra_share", F.col("extra") / F.greatest("attendance", F.lit(1)))
    return rp.incident_report(brief, find, op.action_plan(w, op.window_cells(w, r)), tot, rp.closure_losses(opened(n, f), n.closures, n.clock))


@register("r11_contingency", "station_key stations_cut_off:i affected_weekday:f adjacent:a walk_to:a other_line_walk rail past_closures:i ceiling:i", ctes="comps levels caps e2 alts stations closures", sql=f"""
WITH f AS (SELECT removed, coalesce(sum(size) FILTER (r>1),0) off, coalesce(sum(wd) FILTER (r>1),0) wdc FROM comps GROUP BY 1), w AS (SELECT *, row_number() OVER (PARTITION BY station_key ORDER BY km, other) r FROM alts WHERE km<=3.0)
SELECT s.station_key, off stations_cut_off, weekday_mean+wdc affected_weekday, (SELECT list(dst ORDER BY dst) FROM e2 WHERE src=s.station_key) adjacent, (SELECT list(other ORDER BY r) FROM w WHERE w.station_key=s.station_key AND r<=5) walk_to,
(SELECT first(other ORDER BY r) FROM w WHERE w.station_key=s.station_key AND r<=5 AND len(list_filter(lb, lambda x: NOT list_contains(la, x)))>0) other_line_walk, (SELECT first(h.station_key ORDER BY {hav('s', 'h')}, h.station_key) FROM stations h WHERE h.is_rail AND {hav('s', 'h')}<=3.0) rail, (SELECT count(*) FROM closures c WHERE c.station_key=s.station_key) past_closures, ceiling
FROM stations s JOIN levels USING(station_key) JOIN caps USING(station_key) JOIN f ON f.removed=s.station_key""")
def _(n):
    lab = g.removal_components(n.edges)
    lv = levels(n)
    return rp.contingency_table(n.stations, n.edges, lab, g.fragmentation(lab, lv), lv, st.ceilings(n.dense), n.closures, 3.0, 3.0)


@register("f14_passenger_messages", "kind lang channel n:i distinct_texts:i chars:i", ctes="closures suspensions", sql="""
WITH a AS (SELECT 'station' kind, 'NATION_'||CAST(CAST(substr(station_key,2) AS INT) AS VARCHAR) a, '' b, '' AS line, strftime("end",'%H:%M') u FROM closures UNION ALL SELECT 'line', 'NATION_'||CAST(CAST(substr(a,2) AS INT) AS VARCHAR), 'NATION_'||CAST(CAST(substr(b,2) AS INT) AS VARCHAR), line, strftime("end",'%H:%M') FROM suspensions),
m AS (SELECT kind, 'en' lang, 'display' channel, CASE WHEN kind='station' THEN a||': closed until '||u ELSE line||' '||a||' - '||b||': no trains until '||u END t FROM a)
SELECT kind, lang, channel, count(*) n, count(DISTINCT t) distinct_texts, sum(length(t)) chars FROM m GROUP BY 1,2,3""")
def _(n):
    m = messages(n).filter("lang = 'en' AND channel = 'display'")
    return m.groupBy("kind", "lang", "channel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("message").alias("distinct_texts"), F.sum(F.length("message")).alias("chars"))


def messages(n):
    names = n.stations.select("station_key", "name")
    c = n.closures.select(F.col("closure_id").alias("item_id"), "kind", "description", F.lit(None).cast("string").alias("line"), F.col("stations")[0].alias("ka"), F.lit(None).cast("string").alias("kb"), F.col("end").alias("until"))
    p = parsed_suspensions(n).filter(F.size("stations") > 0)
    p = p.select(F.col("closure_id").alias("item_id"), "kind", "description", "line", F.col("stations")[0].alias("ka"), F.element_at("stations", -1).alias("kb"), F.col("end").alias("until"))
    adj = n.edges.join(names, F.col("dst") == F.col("station_key")).groupBy(F.col("src").alias("ka")).agg(F.slice(F.array_sort(F.collect_set("name")), 1, 2).alias("alternatives"))
    u = c.unionByName(p).join(names.toDF("ka", "a"), "ka").join(names.toDF("kb", "b"), "kb", "left").join(adj, "ka", "left")
    return msg.passenger_messages(u, n.spark)


@register("f14_message_texts", "item_id:i kind lang channel message")
def _(n):
    return messages(n)


@register("a9_peak_confounders", "station_key cday:d slot:t events:i closures:i event_names:a crowd", ctes="dd vkm crowd closures suspensions stations", sql="""
WITH p AS (SELECT station_key, cday, first(slot ORDER BY reading DESC, slot) slot FROM dd GROUP BY 1,2),
e AS (SELECT p.station_key, p.slot, count(DISTINCT crowd_id) n, list_sort(list(DISTINCT event_name)) names, max(attendance) most FROM p JOIN vkm k ON k.station_key=p.station_key AND k.km<=1.5 JOIN crowd c ON c.venue_key=k.venue_key AND p.slot>=c.start-INTERVAL 90 MINUTE AND p.slot<=c."end"+INTERVAL 60 MINUTE GROUP BY 1,2),
c AS (SELECT station_key, slot, count(*) n FROM (SELECT DISTINCT p.station_key, p.slot, CAST(closure_id AS VARCHAR) id FROM p JOIN closures c ON c.station_key=p.station_key AND p.slot>=c.start AND p.slot<c."end"
UNION SELECT DISTINCT p.station_key, p.slot, 'line '||closure_id FROM p JOIN stations s ON s.station_key=p.station_key JOIN suspensions u ON list_contains(s.lines, u.line) AND p.slot>=u.start AND p.slot<u."end") GROUP BY 1,2)
SELECT p.station_key, p.cday, p.slot, coalesce(e.n,0) "events", coalesce(c.n,0) closures, coalesce(names, []) event_names, CASE WHEN most>=1500 THEN 'high' WHEN most>=800 THEN 'medium' WHEN most IS NOT NULL THEN 'low' END crowd
FROM p LEFT JOIN e ON e.station_key=p.station_key AND e.slot=p.slot LEFT JOIN c ON c.station_key=p.station_key AND c.slot=p.slot""")
def _(n):
    """Daily peaks with the events and closures around them."""
    from flowspark.operators.stats import calendar, first_argmax

    p = calendar(n.dense).groupBy("station_key", "cday").agg(first_argmax("slot", "reading", t.slot_no("slot")).alias("slot"))
    lines = n.suspensions.select("closure_id", F.regexp_extract("description", r"^Line (\S+) ", 1).alias("line"), "start", "end")
    return pk.peak_confounders(p, n.crowd_events, n.venues, n.stations, n.closures, lines, n.clock)
