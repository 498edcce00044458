"""Weather and energy on the bound tables."""

from flowspark.catalog.ctes import cte, hav
from flowspark.catalog import stats as _stats  # noqa: F401  (defines shared expressions)
from flowspark.catalog.registry import register
from flowspark.operators import energy as en
from flowspark.operators import stats as st
from flowspark.operators import weather as wx
from pyspark.sql import functions as F

PARAMS = {"heat": -0.0185, "rain_max": 0.29, "rain_scale": 0.6}
MULT = "exp(-0.0185::DOUBLE*(tday-18)+0.29::DOUBLE*(1-exp(-prcp/0.6::DOUBLE)))"

cte("tday", "weather", "SELECT day, avg(temp) AS tday FROM weather WHERE minute(slot)=0 GROUP BY 1")
cte("wxm", "weather tday", f"SELECT w.*, tday, {MULT} AS multiplier FROM weather w JOIN tday USING(day)")


@register("a19_weather_by_day", "day:d temp_mean:f temp_min:f temp_max:f rain_mm:f max_rain_mm_h:f wind_max:f condition_code:i multiplier:f", ctes="wxm", sql="""
SELECT day, avg(temp) temp_mean, min(temp) temp_min, max(temp) temp_max, sum(prcp)/4 rain_mm, max(prcp) max_rain_mm_h, max(wspd) wind_max, max(coco) condition_code, avg(multiplier) multiplier FROM wxm GROUP BY 1""")
def _(n):
    return wx.weather_table(n.weather, PARAMS)


@register("a19_weather_by_hour", "hour:t temp:f rain_mm_h:f wind_kmh:f condition_code:i multiplier:f", ctes="wxm", sql="""
SELECT date_trunc('hour',slot) AS hour, avg(temp) temp, avg(prcp) rain_mm_h, avg(wspd) wind_kmh, max(coco) condition_code, avg(multiplier) multiplier FROM wxm GROUP BY 1""")
def _(n):
    return wx.weather_table(n.weather, PARAMS, "hour")


@register("a20_weather_window", "cday:d temp_mean:f temp_min:f temp_max:f rain_mm:f max_rate:f wind_mean:f code:i condition", ctes="weather", sql="""
WITH w AS (SELECT *, CAST(slot AS DATE) cday, CAST(coco AS INT) code FROM weather WHERE hour(slot)>=6 AND hour(slot)<22)
SELECT *, CASE code WHEN 1 THEN 'Clear sky' WHEN 2 THEN 'Partly cloudy' WHEN 3 THEN 'Cloudy' WHEN 4 THEN 'Overcast' WHEN 5 THEN 'Fog' WHEN 6 THEN 'Freezing fog' WHEN 7 THEN 'Light rain' WHEN 8 THEN 'Rain' WHEN 9 THEN 'Heavy rain' ELSE 'Unknown' END AS condition FROM (
SELECT cday, avg(temp) temp_mean, min(temp) temp_min, max(temp) temp_max, sum(prcp)/4 rain_mm, max(prcp) max_rate, avg(wspd) wind_mean FROM w GROUP BY 1) JOIN
(SELECT cday, first(code ORDER BY n DESC, code) code FROM (SELECT cday, code, count(*) n FROM w GROUP BY 1,2) GROUP BY 1) USING(cday)""")
def _(n):
    return wx.weather_window(n.weather, 6, 22)


for metric in ("prcp", "temp", "wspd"):
    @register(f"a21_weather_outliers_{metric}", "week:d value:f slot:t week_mean:f z:f", ctes="weather", sql=f"""
SELECT CAST(date_trunc('week',slot) AS DATE) AS week, max({metric}) AS value, first(slot ORDER BY {metric} DESC, slot) slot, avg({metric}) week_mean,
(max({metric})-(SELECT avg({metric}) FROM weather))/(SELECT stddev_samp({metric}) FROM weather) z FROM weather GROUP BY 1""")
    def _(n, metric=metric):
        return wx.weather_outliers(n.weather, metric)


cte("rainh", "fulld weather", """SELECT h.*, b.expected, (flow-b.expected)/b.expected*100 AS diff_pct FROM (
SELECT f.hour, flow, prcp, hour(f.hour) hr, isodow(f.hour)>=6 weekend FROM (SELECT date_trunc('hour',slot) AS hour, sum(reading) flow FROM fulld GROUP BY 1) f JOIN (SELECT date_trunc('hour',slot) AS hour, avg(prcp) prcp FROM weather GROUP BY 1) w ON f.hour=w.hour WHERE flow>0) h
JOIN (SELECT weekend, hr, avg(flow) expected FROM (SELECT f.hour, flow, prcp, hour(f.hour) hr, isodow(f.hour)>=6 weekend FROM (SELECT date_trunc('hour',slot) AS hour, sum(reading) flow FROM fulld GROUP BY 1) f JOIN (SELECT date_trunc('hour',slot) AS hour, avg(prcp) prcp FROM weather GROUP BY 1) w ON f.hour=w.hour WHERE flow>0) WHERE prcp<0.6 GROUP BY 1,2 HAVING count(*)>=3) b USING(weekend, hr)""")


@register("a22_rain_impact", "rain_class hours:i mean_change_pct:f median_change_pct:f", ctes="rainh", sql="""
SELECT CASE WHEN prcp<0.6 THEN 'dry' WHEN prcp>=0.1 AND prcp<2.5 THEN 'light' WHEN prcp<10 THEN 'moderate' ELSE 'heavy' END rain_class, count(*) AS hours, avg(diff_pct) mean_change_pct, median(diff_pct) median_change_pct FROM rainh GROUP BY 1""")
def _(n):
    return wx.rain_impact(wx.rain_hours(n.dense, n.weather, dry_max=0.6), dry_max=0.6)


@register("a22_wettest_hours", "hour:t flow:i prcp:f expected:f diff_pct:f", ctes="rainh", sql="SELECT hour, flow, prcp, expected, diff_pct FROM rainh WHERE prcp>=0.1 ORDER BY prcp DESC, hour LIMIT 12")
def _(n):
    return wx.wettest_hours(wx.rain_hours(n.dense, n.weather, dry_max=0.6), 12)


@register("a9_peak_vs_dry", "station_key cday:d peak:i slot:t dry_median:f all_median:f dry_days:i baseline:f change_pct:f", ctes="dd weather", sql="""
WITH p AS (SELECT station_key, cday, wd, max(reading) peak, first(slot ORDER BY reading DESC, slot) slot FROM dd GROUP BY 1,2,3),
r AS (SELECT date_trunc('hour',slot) h, avg(prcp) rate FROM weather GROUP BY 1),
j AS (SELECT p.station_key, p.cday, p.peak, p.slot, c.reading, coalesce(rate,0)<0.6 dry FROM p JOIN dd c ON c.station_key=p.station_key AND c.wd=p.wd AND c.hm=strftime(p.slot,'%H:%M') AND c.cday<>p.cday LEFT JOIN r ON r.h=date_trunc('hour',c.slot))
SELECT *, coalesce(dry_median, all_median) baseline, CASE WHEN coalesce(dry_median, all_median)>0 THEN (peak/coalesce(dry_median, all_median)-1)*100 END change_pct FROM (
SELECT station_key, cday, peak, slot, median(reading) FILTER (dry) dry_median, median(reading) all_median, count_if(dry) dry_days FROM j GROUP BY 1,2,3,4)""")
def _(n):
    return wx.peak_vs_dry(n.dense, n.weather, dry_max=0.6)


cte("lweights", "stations", """SELECT r.rule, station_key, line, CASE r.rule WHEN 'equal_split' THEN 1.0::DOUBLE/len(lines) WHEN 'first_line' THEN CASE WHEN line=lines[1] THEN 1.0::DOUBLE ELSE 0 END ELSE 1.0::DOUBLE END AS weight
FROM (SELECT station_key, lines, unnest(lines) AS line FROM stations) CROSS JOIN (SELECT unnest(['equal_split','first_line','full_count']) AS rule) r""")
cte("udays", "daily_station energy", "SELECT day FROM daily_station GROUP BY 1 HAVING count(*)>=10 INTERSECT SELECT day FROM energy")
cte("ldays", "daily_station energy stations", f"""SELECT e.day, e.line, mwh, riders, CASE WHEN isodow(e.day)=7 THEN 2 WHEN isodow(e.day)=6 THEN 1 ELSE 0 END AS daytype, split_riders FROM energy e JOIN (
SELECT day, line, CAST(sum(riders) AS DOUBLE) riders, sum(riders/len(lines)) split_riders FROM daily_station JOIN (SELECT station_key, lines, unnest(lines) AS line FROM stations) USING(station_key) GROUP BY 1,2) r ON r.day=e.day AND r.line=e.line""")


@register("a23_energy_allocation", "rule line pax:f stations:i mwh:f mwh_per_1000:f rank:i gap_pct:f", ctes="lweights udays daily_station energy", sql="""
SELECT *, row_number() OVER w AS rank, (mwh_per_1000/lead(mwh_per_1000) OVER w-1)*100 gap_pct FROM (SELECT rule, line, pax, stations, mwh, mwh/(pax/1000) mwh_per_1000 FROM (
SELECT rule, line, sum(riders*weight) pax, count(*) stations FROM (SELECT station_key, sum(riders) riders FROM daily_station WHERE day IN (SELECT day FROM udays) GROUP BY 1) JOIN lweights USING(station_key) WHERE weight>0 GROUP BY 1,2) JOIN
(SELECT line, sum(mwh) mwh FROM energy WHERE day IN (SELECT day FROM udays) GROUP BY 1) USING(line)) WINDOW w AS (PARTITION BY rule ORDER BY mwh_per_1000 DESC, line)""")
def _(n):
    return en.efficiency_ranking(n.daily_station, n.energy, n.stations, min_stations=10)


@register("m10_energy_model", "line b0:f b1_wh:f n:i sd:f", ctes="ldays", sql="""
WITH m AS (SELECT line, regr_slope(mwh,riders) b1, regr_intercept(mwh,riders) b0, count(*) n FROM ldays GROUP BY 1)
SELECT line, b0, b1*1e6 b1_wh, n, stddev_pop(mwh-(b0+b1*riders)) sd FROM ldays JOIN m USING(line) GROUP BY 1,2,3,4""")
def _(n):
    return en.energy_model(en.line_days(n.daily_station, n.energy, n.stations)).withColumn("b1_wh", F.col("b1") * 1e6)


@register("a24_energy_stats", "line days:i total_mwh:f mean_mwh:f riders:f kwh_per_passenger:f highest_day:d lowest_day:d mean_gap:f unusual_day:d sd:f", ctes="ldays", sql="""
WITH m AS (SELECT line, regr_slope(mwh,riders) b1, regr_intercept(mwh,riders) b0 FROM ldays GROUP BY 1), r AS (SELECT *, mwh-(b0+b1*riders) resid FROM ldays JOIN m USING(line)),
s AS (SELECT line, stddev_pop(resid) sd FROM r GROUP BY 1)
SELECT line, count(*) AS days, sum(mwh) total_mwh, avg(mwh) mean_mwh, sum(riders) riders, sum(mwh)*1000/sum(riders) kwh_per_passenger, first(day ORDER BY mwh DESC, day) highest_day, first(day ORDER BY mwh, day) lowest_day, avg(resid) mean_gap, first(day ORDER BY abs(resid) DESC, day) unusual_day, any_value(sd) sd
FROM r JOIN s USING(line) WHERE daytype=0 GROUP BY 1""")
def _(n):
    d = en.line_days(n.daily_station, n.energy, n.stations)
    return en.energy_stats(d, en.energy_model(d), "weekday")


cte("llen", "line_stops stations", f"""SELECT line, sum(km) AS km, count(*) AS stations FROM (SELECT l.line, CASE WHEN a.station_key IS NULL THEN NULL ELSE {hav('a', 'b')} END AS km FROM line_stops l JOIN stations b ON b.station_key=l.station_key LEFT JOIN line_stops p ON p.line=l.line AND p.seq=l.seq-1 LEFT JOIN stations a ON a.station_key=p.station_key) GROUP BY 1""")
cte("leff", "ldays llen", """SELECT *, riders_day/km riders_per_km, mwh_day/km mwh_per_km, fixed_mwh/mwh_day fixed_share FROM (SELECT line, sum(mwh)*1000/sum(riders) kwh_per_passenger, sum(mwh)*1000/sum(split_riders) kwh_split, avg(mwh) mwh_day, avg(riders) riders_day, regr_intercept(mwh,riders) fixed_mwh, regr_slope(mwh,riders)*1e6 marginal_wh,
sum(mwh) FILTER (daytype=0)*1000/sum(riders) FILTER (daytype=0) kwh_weekday, sum(mwh) FILTER (daytype>0)*1000/sum(riders) FILTER (daytype>0) kwh_weekend, avg(riders) FILTER (daytype>0)/avg(riders) FILTER (daytype=0) weekend_ratio, sum(mwh) mwh, sum(riders) riders, count(*) n, count_if(daytype>0) n_weekend FROM ldays GROUP BY 1) JOIN llen USING(line)""")


def _eff(n):
    d = en.line_days(n.daily_station, n.energy, n.stations)
    return en.energy_efficiency(d, en.line_riders(n.daily_station, n.stations, "equal_split"), en.line_lengths(n.line_stops, n.stations))


EFF_COLS = "kwh_per_passenger kwh_split mwh_day riders_day fixed_mwh marginal_wh kwh_weekday kwh_weekend km riders_per_km mwh_per_km fixed_share".split()


@register("a25_energy_efficiency", "line stations:i " + " ".join(c + ":f" for c in EFF_COLS), ctes="leff", sql="SELECT * FROM leff")
def _(n):
    return _eff(n)


@register("a25_correlations", "kwh_vs_density:f fixed_vs_length:f", ctes="leff", sql="SELECT corr(kwh_per_passenger, riders_per_km) kwh_vs_density, corr(fixed_mwh, km) fixed_vs_length FROM leff")
def _(n):
    return en.efficiency_correlations(_eff(n))


@register("a25_interventions", "line measure kwh_before:f kwh_after:f change_pct:f", ctes="leff", sql="""
WITH w AS (SELECT *, (SELECT median(riders_per_km) FROM leff)*km/riders_day-1 x, mwh/riders base, marginal_wh/1e6 b1 FROM leff ORDER BY kwh_per_passenger DESC, line LIMIT 1),
m AS (SELECT line, base, unnest(['cut_fixed_energy_10pct','ridership_plus_10pct','weekend_service_matched','reach_median_density']) measure, unnest([(mwh-0.1::DOUBLE*fixed_mwh*n)/riders, (mwh+0.1::DOUBLE*b1*riders)/(riders*1.1::DOUBLE), (mwh-fixed_mwh*(1-weekend_ratio)*n_weekend)/riders, (mwh+b1*riders*x)/(riders*(1+x))]) af FROM w)
SELECT line, measure, base*1000 kwh_before, af*1000 kwh_after, (af/base-1)*100 change_pct FROM m""")
def _(n):
    return en.interventions(_eff(n))


@register("j12_usable_days", "day:d", ctes="udays", sql="SELECT day FROM udays")
def _(n):
    return en.usable_days(n.daily_station, n.energy, 10)
