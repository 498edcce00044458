"""Flow statistics on the bound tables."""

from pyspark.sql import functions as F

from flowspark.catalog.ctes import cte
from flowspark.catalog.registry import register
from flowspark.functions import time as t
from flowspark.operators import stats as st

cte("dd", "dense", "SELECT *, CAST(slot AS DATE) AS cday, hour(slot) AS hr, isodow(slot)-1 AS wd, strftime(slot,'%H:%M') AS hm FROM dense")
cte("fulld", "dd", "SELECT * FROM dd WHERE cday IN (SELECT cday FROM dd GROUP BY cday HAVING count(DISTINCT slot)>=80)")
cte("caps", "dense", "SELECT station_key, max(reading) AS ceiling FROM dense GROUP BY 1")

WIN = "slot >= TIMESTAMP '2024-01-05 00:00:00' AND slot < TIMESTAMP '2024-01-12 12:00:00'"
ABS = dict(start="2024-01-05 00:00:00", end="2024-01-12 12:00:00")


@register("a1_flow_window_total", "slots:i total:i mean_per_slot:f max_value:i max_slot:t slots_at_ceiling:i", ctes="dense caps", sql=f"""
SELECT count(*) slots, sum(total) total, avg(total) mean_per_slot, max(total) max_value, first(slot ORDER BY total DESC, slot) max_slot, sum(hits) slots_at_ceiling
FROM (SELECT slot, sum(reading) total, count_if(reading>=ceiling) hits FROM dense JOIN caps USING(station_key) WHERE {WIN} GROUP BY slot)""")
def _(n):
    return st.flow_window(n.dense, st.ceilings(n.dense), **ABS)


for by, col, sqlcol, kind in (("slot", "slot", "slot", "t"), ("hour", "hour", "date_trunc('hour',slot)", "t"), ("day", "day", "day", "d"), ("station", "station_key", "station_key", "s")):
    @register(f"a1_flow_window_by_{by}", f"{col}:{kind} total:i", ctes="flows fd", sql=f"SELECT {sqlcol} AS {col}, sum(reading) AS total FROM fd WHERE {WIN} GROUP BY 1")
    def _(n, by=by):
        return st.flow_window(n.flow_days, None, by=by, **ABS)


NIGHT = "(tod>=68)"


@register("a2_typical_weekday", "service_days:i window_total:f min_day:i max_day:i first_day:d last_day:d", ctes="dense", sql="""
SELECT count(*) service_days, avg(v) window_total, min(v) min_day, max(v) max_day, min(day) first_day, max(day) last_day FROM (
SELECT day, sum(reading) v FROM dense WHERE daytype=0 AND tod>=8 AND tod<20 GROUP BY day)""")
def _(n):
    return st.typical_day(n.dense, days="weekday", time_from="07:00", time_to="10:00", clock=n.clock)


@register("a2_typical_night_wrap", "station_key window_total:f", ctes="dense", sql="""
SELECT station_key, median(v) window_total FROM (SELECT station_key, day, sum(reading) v FROM dense WHERE tod>=68 AND tod<80 GROUP BY 1,2) GROUP BY 1""")
def _(n):
    return st.typical_day(n.dense, by="station", stat="median", time_from="22:00", time_to="01:00", clock=n.clock)


@register("a2_typical_slot_weekend", "tod:i time value:f", ctes="dense", sql="""
SELECT tod, lpad(CAST(((tod*15+300)%1440)//60 AS VARCHAR),2,'0')||':'||lpad(CAST((tod*15)%60 AS VARCHAR),2,'0') AS time, median(v) AS value FROM (
SELECT day, tod, sum(reading) v FROM dense WHERE daytype>0 GROUP BY 1,2) GROUP BY tod""")
def _(n):
    return st.typical_day(n.dense, by="slot", stat="median", days="weekend", clock=n.clock)


@register("a2_typical_hour", "hour:i value:f", ctes="dense", sql="""
SELECT hour, max(v) AS value FROM (SELECT day, hour(slot) AS hour, sum(reading) v FROM dense WHERE day>=DATE '2024-01-03' AND day<=DATE '2024-01-20' GROUP BY 1,2) GROUP BY 1""")
def _(n):
    return st.typical_day(n.dense, by="hour", stat="max", date_from="2024-01-03", date_to="2024-01-20", clock=n.clock)


@register("a2_typical_days_listed", "day:d total:i", ctes="dense", sql="SELECT day, sum(reading) AS total FROM dense WHERE day IN (DATE '2024-01-06', DATE '2024-01-07') GROUP BY 1")
def _(n):
    return st.typical_day(n.dense, by="day", dates=["2024-01-06", "2024-01-07"], clock=n.clock)


@register("p1_scope_line", "station_key total:i", ctes="fd line_stops", sql="SELECT station_key, sum(reading) total FROM fd WHERE station_key IN (SELECT station_key FROM line_stops WHERE line='L1') GROUP BY 1")
def _(n):
    return st.flow_window(st.scope(n.flow_days, line="L1", line_stops=n.line_stops), None, by="station")


RANK = "SELECT station_key, value, median(value) OVER () AS network_median FROM ({}) ORDER BY value {}, station_key LIMIT {}"


@register("a3_rank_stations_total", "station_key name lines:a value:i network_median:f", ctes="flows stations", sql="SELECT r.*, name, lines FROM (" + RANK.format("SELECT station_key, sum(reading) AS value FROM flows GROUP BY 1", "DESC", 10) + ") r JOIN stations USING(station_key)")
def _(n):
    r = st.rank_stations(n.flows, None, "total")
    return r.join(n.stations.select("station_key", "name", "lines"), "station_key")


@register("a3_rank_mean_per_day_ascending", "station_key value:f network_median:f", ctes="dense", sql=RANK.format("SELECT station_key, sum(reading)/(SELECT count(DISTINCT day) FROM dense) AS value FROM dense GROUP BY 1", "ASC", 7))
def _(n):
    return st.rank_stations(n.dense, None, "mean_per_day", top=7, ascending=True)


@register("a3_rank_peak_slot", "station_key value:i at:t network_median:f", ctes="flows", sql="""SELECT station_key, value, "at", median(value) OVER () AS network_median FROM (SELECT station_key, max(reading) AS value, first(slot ORDER BY reading DESC, slot) AS "at" FROM flows GROUP BY 1) ORDER BY value DESC, station_key LIMIT 10""")
def _(n):
    return st.rank_stations(n.flows, None, "peak_slot")


@register("a3_rank_slots_at_ceiling", "station_key value:i network_median:f", ctes="dense caps", sql=RANK.format("SELECT station_key, count_if(reading>=ceiling) AS value FROM dense JOIN caps USING(station_key) GROUP BY 1", "DESC", 25))
def _(n):
    return st.rank_stations(n.dense, st.ceilings(n.dense), "slots_at_ceiling", top=25)


@register("a3b_station_levels", "station_key weekday_mean:f weekend_mean:f", ctes="dense", sql="""
SELECT station_key, avg(CASE WHEN daytype=0 THEN v END) weekday_mean, avg(CASE WHEN daytype>0 THEN v END) weekend_mean FROM (SELECT station_key, day, daytype, sum(reading) v FROM dense GROUP BY 1,2,3) GROUP BY 1""")
def _(n):
    return st.station_levels(st.daily_totals(n.dense))


@register("a4_compare_to_weeks", "request_id:d observed:i weeks:i mean:f min:i max:i share_higher:f", ctes="dense", sql="""
WITH net AS (SELECT slot, sum(reading) v FROM dense GROUP BY 1), ext AS (SELECT min(slot) lo, max(slot)+INTERVAL 15 MINUTE hi FROM net),
req AS (SELECT DISTINCT day, day+INTERVAL 7 HOUR s0, day+INTERVAL 20 HOUR e0 FROM dense),
sh AS (SELECT day, w, s0+to_days(CAST(7*w AS INTEGER)) s, e0+to_days(CAST(7*w AS INTEGER)) e FROM req, range(-16,17) r(w)),
tot AS (SELECT sh.day, w, sum(v) total FROM sh, ext, net WHERE s>=lo AND e<=hi AND slot>=s AND slot<e GROUP BY 1,2),
o AS (SELECT day, total obs FROM tot WHERE w=0)
SELECT o.day request_id, obs observed, count(t.total) AS weeks, avg(t.total) mean, min(t.total) "min", max(t.total) "max", avg(CASE WHEN t.total>obs THEN 1.0 WHEN t.total IS NULL THEN NULL ELSE 0.0 END) share_higher
FROM o LEFT JOIN tot t ON t.day=o.day AND t.w<>0 GROUP BY 1,2""")
def _(n):
    day = F.col("day").cast("timestamp_ntz")
    req = n.spine.select("day").distinct().select(
        F.col("day").alias("request_id"), (day + t.minutes(420)).alias("start"), (day + t.minutes(1200)).alias("end"))
    return st.compare_to_weeks(st.same_weekday_weeks(n.dense, req))


@register("a5_network_summary", "cday:d total:i mean_per_slot:f peak_value:i peak_slot:t zero_stations:i", ctes="dd", sql="""
SELECT a.*, z.zero_stations FROM (SELECT cday, sum(v) total, avg(v) mean_per_slot, max(v) peak_value, first(slot ORDER BY v DESC, slot) peak_slot FROM (SELECT cday, slot, sum(reading) v FROM dd GROUP BY 1,2) GROUP BY 1) a
JOIN (SELECT cday, count_if(v=0) zero_stations FROM (SELECT cday, station_key, sum(reading) v FROM dd GROUP BY 1,2) GROUP BY 1) z USING(cday)""")
def _(n):
    return st.network_summary(n.dense)


@register("a5_station_extremes", "cday:d side rank:i station_key total:i", ctes="dd", sql="""
WITH g AS (SELECT cday, station_key, sum(reading) total FROM dd GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY cday ORDER BY total DESC, station_key) hi, row_number() OVER (PARTITION BY cday ORDER BY total, station_key) lo FROM g)
SELECT cday, 'top' side, hi AS rank, station_key, total FROM r WHERE hi<=5 UNION ALL SELECT cday, 'bottom', lo, station_key, total FROM r WHERE lo<=5""")
def _(n):
    return st.station_extremes(n.dense)


@register("a6_station_window", "station_key cday:d total:i mean_per_slot:f peak:i peak_slot:t zero_slots:i capped_slots:i baseline_total:f change_pct:f", ctes="fulld", sql="""
WITH d AS (SELECT station_key, cday, wd, sum(reading) total, avg(reading) mean_per_slot, max(reading) peak, first(slot ORDER BY reading DESC, slot) peak_slot, count_if(reading=0) zero_slots, count_if(reading>=3000) capped_slots FROM fulld WHERE hr>=6 AND hr<10 GROUP BY 1,2,3),
b AS (SELECT a.station_key, a.cday, avg(o.total) baseline_total FROM d a JOIN d o ON o.station_key=a.station_key AND o.wd=a.wd AND o.cday<>a.cday GROUP BY 1,2)
SELECT d.*, baseline_total, CASE WHEN baseline_total>0 THEN (total/baseline_total-1)*100 END change_pct FROM d LEFT JOIN b USING(station_key, cday)""")
def _(n):
    return st.station_window(n.dense, 6, 10)


@register("a8_peak_status", "station_key station_max:i peak_value:i peak_slot:t pct_of_max:f status", ctes="flows", sql="""
SELECT *, CASE WHEN pct_of_max>=90 THEN 'CRITICAL' WHEN pct_of_max>=70 THEN 'ELEVATED' ELSE 'NORMAL' END status FROM (
SELECT station_key, max(reading) station_max, max(CASE WHEN hour(slot)>=6 AND hour(slot)<12 THEN reading END) peak_value,
first(slot ORDER BY CASE WHEN hour(slot)>=6 AND hour(slot)<12 THEN reading END DESC NULLS LAST, slot) peak_slot, round(peak_value/station_max*100,1) pct_of_max FROM flows GROUP BY 1)""")
def _(n):
    return st.peak_status(n.flows, 6, 12)


@register("a10_weekday_profile", "wd:i mean_daily_total:f peak_value:f peak_time", ctes="fulld", sql="""
WITH s AS (SELECT cday, wd, slot, hm, sum(reading) v FROM fulld GROUP BY 1,2,3,4), d AS (SELECT wd, avg(v) mean_daily_total FROM (SELECT cday, wd, sum(v) v FROM s GROUP BY 1,2) GROUP BY 1),
p AS (SELECT wd, max(m) peak_value, first(hm ORDER BY m DESC, hm) peak_time FROM (SELECT wd, hm, avg(v) m FROM s GROUP BY 1,2) GROUP BY 1) SELECT * FROM d JOIN p USING(wd)""")
def _(n):
    return st.weekday_profile(n.dense)


@register("a11_single_weekday_profile", "station_key wd:i peak_time peak_value:f quiet_time quiet_value:f morning_time morning_value:f evening_time evening_value:f", ctes="fulld", sql="""
WITH p AS (SELECT station_key, wd, hm, CAST(substr(hm,1,2) AS INT) h, avg(reading) m FROM fulld GROUP BY 1,2,3)
SELECT station_key, wd, first(hm ORDER BY m DESC, hm) peak_time, max(m) peak_value, first(hm ORDER BY m, hm) FILTER (m>0) quiet_time, min(m) FILTER (m>0) quiet_value,
first(hm ORDER BY m DESC, hm) FILTER (h>=5 AND h<12) morning_time, max(m) FILTER (h>=5 AND h<12) morning_value, first(hm ORDER BY m DESC, hm) FILTER (h>=15 AND h<20) evening_time, max(m) FILTER (h>=15 AND h<20) evening_value FROM p GROUP BY 1,2""")
def _(n):
    return st.single_weekday_profile(n.dense)


@register("a11_weekday_hourly", "wd:i hr:i mean_total:f", ctes="fulld", sql="SELECT wd, hr, avg(v) mean_total FROM (SELECT cday, wd, hr, sum(reading) v FROM fulld GROUP BY 1,2,3) GROUP BY 1,2")
def _(n):
    return st.weekday_hourly(n.dense)


@register("a12_busiest_by_weekday", "wd:i station_key mean_total:f rank:i", ctes="fulld", sql="""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wd ORDER BY mean_total DESC, station_key) rank FROM (SELECT wd, station_key, avg(v) mean_total FROM (SELECT station_key, wd, cday, sum(reading) v FROM fulld WHERE hr>=6 AND hr<10 GROUP BY 1,2,3) GROUP BY 1,2)) WHERE rank<=5""")
def _(n):
    return st.busiest_by_weekday(n.dense, 6, 10)


for per, unit, thr in (("hour", "hr*60", 4500), ("slot", "hr*60+minute(slot)", 1500)):
    @register(f"a13_above_threshold_{per}", "station_key peak_mean:f peak_minute:i units_above:i first_minute:i last_minute:i", ctes="fulld", sql=f"""
WITH p AS (SELECT station_key, unit, avg(v) m FROM (SELECT station_key, cday, {unit} AS unit, sum(reading) v FROM fulld GROUP BY 1,2,3) GROUP BY 1,2)
SELECT station_key, max(m) peak_mean, first(unit ORDER BY m DESC, unit) peak_minute, count_if(m>{thr}) units_above, min(unit) FILTER (m>{thr}) first_minute, max(unit) FILTER (m>{thr}) last_minute FROM p GROUP BY 1 HAVING count_if(m>{thr})>0""")
    def _(n, per=per, thr=thr):
        return st.above_threshold(n.dense, thr, per)


@register("a14_weekday_pattern", "station_key weekday_mean:f weekend_mean:f busiest_wd:i ratio:f pattern", ctes="fulld", sql="""
SELECT *, CASE WHEN ratio<=0.8 THEN 'commuter' WHEN ratio>=1.0 THEN 'leisure' ELSE 'mixed' END pattern FROM (
SELECT station_key, avg(m) FILTER (wd<5) weekday_mean, avg(m) FILTER (wd>=5) weekend_mean, first(wd ORDER BY m DESC, wd) busiest_wd, weekend_mean/weekday_mean ratio FROM (
SELECT station_key, wd, avg(v) m FROM (SELECT station_key, wd, cday, sum(reading) v FROM fulld GROUP BY 1,2,3) GROUP BY 1,2) GROUP BY 1)""")
def _(n):
    return st.weekday_pattern(n.dense)


@register("a15_weekly_summary", "week_start:d days:i total:i mean_daily:f peak_day:d low_day:d", ctes="fulld", sql="""
SELECT CAST(date_trunc('week',cday) AS DATE) week_start, count(*) AS days, sum(v) total, avg(v) mean_daily, first(cday ORDER BY v DESC, cday) peak_day, first(cday ORDER BY v, cday) low_day FROM (SELECT cday, sum(reading) v FROM fulld GROUP BY 1) GROUP BY 1""")
def _(n):
    return st.weekly_summary(n.dense)


@register("a15b_reference_days", "date:d kind reference_day:d", ctes="fulld", sql="""
WITH days AS (SELECT DISTINCT cday FROM fulld), r AS (SELECT DISTINCT CAST(CAST(ts AS DATE)+INTERVAL 20 DAY AS DATE) AS date FROM events),
k AS (SELECT date, CASE isodow(date) WHEN 7 THEN 'sunday' WHEN 6 THEN 'saturday' ELSE 'weekday' END kind FROM r)
SELECT date, kind, CASE WHEN date IN (SELECT cday FROM days) THEN date ELSE (SELECT max(cday) FROM days WHERE CASE isodow(cday) WHEN 7 THEN 'sunday' WHEN 6 THEN 'saturday' ELSE 'weekday' END=kind) END reference_day FROM k""")
def _(n):
    req = n.raw("events").select(F.date_add(F.to_date("ts"), 20).alias("date")).distinct()
    return st.reference_days(req, n.dense)


for kind, cond in (("weekday", "wd<5"), ("weekend", "wd>=5"), ("all", "true")):
    @register(f"a16_tod_profile_{kind}", "station_key time mean:f max:i min:i", ctes="fulld", sql=f'SELECT station_key, hm AS time, avg(reading) mean, max(reading) "max", min(reading) "min" FROM fulld WHERE {cond} GROUP BY 1,2')
    def _(n, kind=kind):
        return st.tod_profile(n.dense, kind)


@register("a16_compare_to_network", "station_key am:f am_time pm:f pm_time net_am:f med_am:f net_pm:f am_rank:i pm_rank:i am_diff_pct:f higher_peak", ctes="fulld", sql="""
WITH p AS (SELECT station_key, hm, CAST(substr(hm,1,2) AS INT) h, avg(reading) m FROM fulld WHERE wd<5 GROUP BY 1,2),
g AS (SELECT station_key, max(m) FILTER (h>=5 AND h<12) am, first(hm ORDER BY m DESC, hm) FILTER (h>=5 AND h<12) am_time, max(m) FILTER (h>=15 AND h<20) pm, first(hm ORDER BY m DESC, hm) FILTER (h>=15 AND h<20) pm_time FROM p GROUP BY 1)
SELECT *, avg(am) OVER () net_am, median(am) OVER () med_am, avg(pm) OVER () net_pm, rank() OVER (ORDER BY am DESC) am_rank, rank() OVER (ORDER BY pm DESC) pm_rank, (am/avg(am) OVER ()-1)*100 am_diff_pct, CASE WHEN pm>am THEN 'evening' ELSE 'morning' END higher_peak FROM g""")
def _(n):
    return st.compare_to_network(n.dense)


@register("s15_data_extents", "first_full_day:d last_full_day:d last_weekday:d last_saturday:d last_sunday:d full_days:i", ctes="fulld", sql="""
SELECT min(cday) first_full_day, max(cday) last_full_day, max(cday) FILTER (wd<5) last_weekday, max(cday) FILTER (wd=5) last_saturday, max(cday) FILTER (wd=6) last_sunday, count(*) full_days FROM (SELECT DISTINCT cday, wd FROM fulld)""")
def _(n):
    return st.data_extents(n.dense)


@register("p11_temporal_context", "context weekend:b service_running:b n:i", sql="""
SELECT context, weekend, service_running, count(*) n FROM (SELECT hour(ts)*60+minute(ts) m, isodow(ts)>=6 weekend, m<60 OR m>=285 service_running,
CASE WHEN m>=1320 OR m<285 THEN 'night' WHEN weekend THEN 'off_peak' WHEN m>=420 AND m<540 THEN 'morning_peak' WHEN m>=960 AND m<1140 THEN 'evening_peak' ELSE 'off_peak' END context FROM events) GROUP BY 1,2,3""")
def _(n):
    return st.temporal_context(n.raw("events").select("ts")).groupBy("context", "weekend", "service_running").agg(F.count(F.lit(1)).alias("n"))


@register("p12_peak_hours", "hr:i mean_total:f in_rule_window:b rule_share_pct:f", ctes="fulld", sql="""
WITH h AS (SELECT hr, avg(v) mean_total FROM (SELECT cday, hr, sum(reading) v FROM fulld WHERE wd<5 GROUP BY 1,2) GROUP BY 1)
SELECT *, hr IN (7,8,16,17,18) in_rule_window, (SELECT sum(mean_total) FILTER (hr IN (7,8,16,17,18))/sum(mean_total)*100 FROM h) rule_share_pct FROM h""")
def _(n):
    return st.peak_hours(n.dense)


@register("e13_day_anomalies", "station_key cday:d v:f n:i mean:f sd:f z:f", ctes="fulld", sql="""
WITH d AS (SELECT station_key, wd, cday, CAST(sum(reading) AS DOUBLE) v FROM fulld GROUP BY 1,2,3)
SELECT * FROM (SELECT a.station_key, a.cday, a.v, count(*) n, avg(o.v) mean, stddev_samp(o.v) sd, (a.v-avg(o.v))/nullif(stddev_samp(o.v),0) z FROM d a JOIN d o ON o.station_key=a.station_key AND o.wd=a.wd AND o.cday<>a.cday GROUP BY 1,2,3 HAVING count(*)>=2) WHERE abs(z)>=2""")
def _(n):
    return st.day_anomalies(n.dense)


@register("a28_network_counts", "line stations:i network_stations:i distinct_names:i riders:i", ctes="stations line_stops flows", sql="""
SELECT line, count(DISTINCT l.station_key) stations, (SELECT count(*) FROM stations) network_stations, (SELECT count(DISTINCT name) FROM stations) distinct_names, sum(f.reading) riders FROM line_stops l JOIN (SELECT station_key, sum(reading) reading FROM flows GROUP BY 1) f USING(station_key) GROUP BY 1""")
def _(n):
    riders = n.line_stops.join(n.flows.groupBy("station_key").agg(F.sum("reading").alias("r")), "station_key").groupBy("line").agg(F.sum("r").alias("riders"))
    return st.network_counts(n.stations).join(riders, "line")
