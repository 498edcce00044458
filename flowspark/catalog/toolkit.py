"""Joins, window operators and scalar functions on the bound tables."""

from pyspark.sql import functions as F

from flowspark.catalog.ctes import cte, hav
from flowspark.catalog import stats as _stats  # noqa: F401  (defines shared expressions)
from flowspark.catalog.registry import register
from flowspark.functions import geo, noise
from flowspark.functions import text as tx
from flowspark.functions import time as t
from flowspark.operators import joins as jn
from flowspark.operators import stats as st
from flowspark.operators import windows as win

# -- clock and predicates ---------------------------------------------------------------------
HOUR_OF = "hour(ts)*60+minute(ts)"


@register("p2_service_day", "service_day:d daytype:i n:i total:f2", sql="""
SELECT service_day, CASE WHEN isodow(service_day)=7 OR service_day=DATE '2024-01-01' THEN 2 WHEN isodow(service_day)=6 THEN 1 ELSE 0 END daytype, count(*) n, sum(CAST(round(value*100) AS BIGINT))/100 total FROM (SELECT CAST(ts - INTERVAL 5 HOUR AS DATE) service_day, value FROM events) GROUP BY 1""")
def _(n):
    e = n.raw("events").select(t.service_day("ts", n.clock).alias("service_day"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return e.groupBy("service_day", t.day_type("service_day", n.clock).alias("daytype")).agg(F.count(F.lit(1)).alias("n"), (F.sum("v") / 100).alias("total"))


@register("p5_time_mask_wrap", "event_type n:i", sql=f"SELECT event_type, count(*) n FROM events WHERE ({HOUR_OF}-300+1440)%1440>=1020 AND ({HOUR_OF}-300+1440)%1440<1200 GROUP BY 1")
def _(n):
    return n.raw("events").filter(t.time_mask("ts", "22:00", "01:00")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("p6_hour_window", "event_type n:i", sql="SELECT event_type, count(*) n FROM events WHERE hour(ts)>=6 AND hour(ts)<9 GROUP BY 1")
def _(n):
    return n.raw("events").filter(t.hour_window("ts", 6, 9)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("p7_full_days", "cday:d cells:i", ctes="fulld", sql="SELECT cday, count(*) AS cells FROM fulld GROUP BY 1")
def _(n):
    return st.full_calendar_days(n.dense).groupBy("cday").agg(F.count(F.lit(1)).alias("cells"))


@register("p8_service_spine", "day:d tod:i slot:t daytype:i", ctes="spine", sql="SELECT day, tod, slot, daytype FROM spine")
def _(n):
    return n.spine


@register("p9_closures_of_day", "day:d closure_id:i", ctes="closures", sql="""
SELECT DISTINCT day, closure_id FROM closures, (SELECT DISTINCT CAST(ts - INTERVAL 5 HOUR AS DATE) AS day FROM events) d WHERE start < day+INTERVAL 29 HOUR AND "end" > day+INTERVAL 5 HOUR""")
def _(n):
    # A closure touches few service days: explode those instead of testing every pair.
    c = n.closures.withColumn("day", F.explode(F.sequence(t.service_day("start"), t.service_day(F.col("end") - F.expr("INTERVAL 1 MICROSECOND")))))
    days = n.raw("events").select(t.service_day("ts").alias("day")).distinct()
    return c.join(days, "day").select("day", "closure_id")


@register("p10_text_filter", "doc_id:i", sql="SELECT doc_id FROM documents WHERE lower(text) LIKE '%reand%' OR lower(source) LIKE '%src7%'")
def _(n):
    d = n.raw("documents")
    return d.filter(F.lower("text").contains("reand") | F.lower("source").contains("src7")).select("doc_id")


@register("f17_slot_rounding", "lo:t hi:t hour:t n:i", sql="""
SELECT lo, CASE WHEN lo=ts THEN lo ELSE lo+INTERVAL 15 MINUTE END hi, date_trunc('hour',ts) AS hour, count(*) n FROM (SELECT ts, time_bucket(INTERVAL 15 MINUTE, ts) lo FROM events) GROUP BY 1,2,3""")
def _(n):
    e = n.raw("events").select(t.slot_floor("ts").alias("lo"), t.slot_ceil("ts").alias("hi"), t.hour_floor("ts").alias("hour"))
    return e.groupBy("lo", "hi", "hour").agg(F.count(F.lit(1)).alias("n"))


# -- scalar functions -------------------------------------------------------------------------
NAMES = "SELECT user_id, CASE user_id%4 WHEN 0 THEN 'S+U Bahnhof Möckernbrücke ' WHEN 1 THEN 'U Große Straße ' WHEN 2 THEN 'U Kaiser-Str. ' ELSE 'Zoo Bhf ' END||CAST(user_id%25 AS VARCHAR)||' (Berlin)' AS nm FROM events"
FOLD = "translate(replace(lower({0}),'ß','ss'),'äöüáàâéèêëíìîïóòôúùûçñ','aouaaaeeeeiiiiooouuucn')"


def _names(n):
    u = F.col("user_id")
    head = F.when(u % 4 == 0, "S+U Bahnhof Möckernbrücke ").when(u % 4 == 1, "U Große Straße ").when(u % 4 == 2, "U Kaiser-Str. ").otherwise("Zoo Bhf ")
    return n.raw("events").select("user_id", F.concat(head, (u % 25).cast("string"), F.lit(" (Berlin)")).alias("nm"))


@register("f1_station_keys", "nm words compact n:i", sql=f"""
SELECT nm, ['mockernbrucke ','grosse str ','kaiser str ','zoo '][k%4+1]||k%25 AS words, ['moeckernbruecke','grossestr','kaiserstr','zoo'][k%4+1]||k%25 AS compact, count(*) n FROM (SELECT nm, CAST(user_id AS BIGINT) k FROM ({NAMES})) GROUP BY 1,2,3""")
def _(n):
    g = _names(n).groupBy("nm").agg(F.count(F.lit(1)).alias("n"))
    return g.select("nm", tx.name_key("nm").alias("words"), tx.compact_key("nm").alias("compact"), "n")


@register("f2_name_tokens", "token n:i", sql=f"""
SELECT token, count(*) n FROM (SELECT unnest(list_distinct(string_split_regex(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(nm),'ß','ss'),'ä','ae'),'ö','oe'),'ü','ue'),'\\(berlin\\)',' ','g'),'[^a-z0-9]+',' ','g')),' '))) token FROM ({NAMES}))
WHERE length(token)>=5 AND token NOT IN ('u','s','su','bhf','bahnhof','berlin','str','strasse','bf','station','haltestelle','stop') GROUP BY 1""")
def _(n):
    return _names(n).select(F.explode(tx.name_tokens("nm")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register("f4_closure_causes", "cause reason n:i hours:f2", ctes="closures", sql="""
SELECT CASE WHEN description LIKE '%due to track maintenance.' THEN 'Gleisbau' ELSE 'Unbekannt' END cause, regexp_extract(description,'due to (.+?)\\.?$',1) reason, count(*) n, sum(epoch("end"-start))/3600 AS hours FROM closures GROUP BY 1,2""")
def _(n):
    h = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 3.6e9
    return n.closures.groupBy(tx.cause("description").alias("cause"), tx.reason("description").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("hours"))


@register("f5_durations", "dur minutes:i n:i", sql="""
SELECT dur, coalesce(try_cast(regexp_extract(dur,'(\\d+)\\s*h',1) AS INT),0)*60+coalesce(try_cast(regexp_extract(dur,'(\\d+)\\s*min',1) AS INT),0) AS "minutes", count(*) n FROM (SELECT CASE user_id%3 WHEN 0 THEN CAST(user_id%5 AS VARCHAR)||'h' WHEN 1 THEN CAST(user_id%5 AS VARCHAR)||'h'||CAST(user_id%60 AS VARCHAR)||'min' ELSE CAST(user_id%60 AS VARCHAR)||' min' END dur FROM events) GROUP BY 1""")
def _(n):
    u = F.col("user_id")
    s = lambda k: (u % k).cast("string")
    dur = F.when(u % 3 == 0, F.concat(s(5), F.lit("h"))).when(u % 3 == 1, F.concat(s(5), F.lit("h"), s(60), F.lit("min"))).otherwise(F.concat(s(60), F.lit(" min")))
    g = n.raw("events").groupBy(dur.alias("dur")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("dur", tx.duration_minutes("dur").alias("minutes"), "n")


@register("f6_haversine", "home_id:i stop_id:i km:f", ctes="homes stops", sql=f"SELECT home_id, stop_id, {hav('homes', 'stops')} AS km FROM homes JOIN stops ON stop_id=home_id%(SELECT count(*) FROM supplier)")
def _(n):
    m = n.raw("supplier").agg(F.count(F.lit(1)).alias("m")).scalar()
    h = n.homes.withColumn("stop_id", F.col("home_id") % m)
    s = n.stops.select("stop_id", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    return h.join(s, "stop_id").select("home_id", "stop_id", geo.haversine_km("lat", "lon", "rlat", "rlon").alias("km"))


@register("f7_f9_reading_law", "station_key mean_expected:f q10:f q95:f p_max:f over:f p_any:f", ctes="dense caps", sql="""
WITH m AS (SELECT station_key, tod, avg(reading) lam, any_value(ceiling) cap FROM dense JOIN caps USING(station_key) GROUP BY 1,2)
SELECT station_key, avg(CASE WHEN lam>0 THEN greatest(lam*(1-exp(-cap/lam))-0.5,0) ELSE 0 END) mean_expected, avg(CASE WHEN lam>0 THEN least(floor(-lam*ln(0.9::DOUBLE)),cap) ELSE 0 END) q10, avg(CASE WHEN lam>0 THEN least(floor(-lam*ln(0.05::DOUBLE)),cap) ELSE 0 END) q95,
max(CASE WHEN lam>0 THEN exp(-cap/lam) ELSE 0 END) p_max, sum(CASE WHEN lam>0 THEN lam*exp(-cap/lam) ELSE 0 END) AS "over", 1-exp(sum(CASE WHEN lam>0 THEN ln(1-exp(-cap/lam)) ELSE 0 END)) p_any FROM m GROUP BY 1""")
def _(n):
    m = n.dense.join(st.ceilings(n.dense), "station_key").groupBy("station_key", "tod").agg(F.avg("reading").alias("lam"), F.first("ceiling").alias("cap"))
    return m.groupBy("station_key").agg(
        F.avg(noise.expected_reading("lam", "cap")).alias("mean_expected"), F.avg(noise.quantile("lam", "cap", 0.10)).alias("q10"),
        F.avg(noise.quantile("lam", "cap", 0.95)).alias("q95"), F.max(noise.p_ceiling("lam", "cap")).alias("p_max"),
        F.sum(noise.over_capacity("lam", "cap")).alias("over"), noise.any_of(noise.p_ceiling("lam", "cap")).alias("p_any"))


@register("f13_line_modes", "line mode n:i", ctes="stop_times", sql="SELECT line, CASE WHEN line LIKE 'U%' THEN 'subway' WHEN line LIKE 'M%' THEN 'tram' ELSE 'bus' END AS \"mode\", count(*) n FROM stop_times GROUP BY 1")
def _(n):
    g = n.stop_times.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return g.select("line", tx.line_mode("line").alias("mode"), "n")


TRAINS = [(0, 5, 4), (5, 7, 8), (7, 9, 15), (9, 16, 10), (16, 19, 15), (19, 24, 6)]


@register("f15_trains_per_hour", "day:d trains:f", ctes="spine", sql=f"SELECT day, sum(tph)/4 trains FROM spine JOIN (VALUES {', '.join(str(x) for x in TRAINS)}) v(h0,h1,tph) ON hour(slot)>=h0 AND hour(slot)<h1 GROUP BY 1")
def _(n):
    from flowspark.operators.service import trains_per_hour

    table = n.spark.createDataFrame(TRAINS, "hour_from int, hour_to int, trains int")
    return trains_per_hour(n.spine, table).groupBy("day").agg((F.sum("trains") / 4).alias("trains"))


@register("f18_line_arrays", "station_key lines:a shared:i other:a", ctes="stations flows", sql="""
SELECT station_key, lines, CASE WHEN list_has_any(lines, ['L1','L3']) THEN 1 ELSE 0 END shared, list_filter(lines, lambda x: x<>'L1') AS other FROM stations WHERE station_key IN (SELECT station_key FROM flows)""")
def _(n):
    a = F.array(F.lit("L1"), F.lit("L3"))
    s = n.stations.join(n.flows.select("station_key").distinct(), "station_key", "left_semi")
    return s.select("station_key", "lines", F.arrays_overlap("lines", a).cast("int").alias("shared"), F.array_except("lines", F.array(F.lit("L1"))).alias("other"))


@register("f21_json_fields", "k:i n:i", sql="SELECT CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, count(*) n FROM events GROUP BY 1")
def _(n):
    e = n.raw("events").select(F.from_json("props", "k bigint").k.alias("k"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@register("f22_grid_cells", "cy:i cx:i n:i", ctes="homes", sql="SELECT CAST(floor(lat*(111000.0/1000.0)) AS BIGINT) cy, CAST(floor(lon*(111000.0*0.5/1000.0)) AS BIGINT) cx, count(*) n FROM homes GROUP BY 1,2")
def _(n):
    return n.homes.groupBy(geo.cell("lat", 1.0).alias("cy"), geo.cell("lon", 1.0, 0.5).alias("cx")).agg(F.count(F.lit(1)).alias("n"))


@register("f16_result_json", "station_key payload", ctes="flows", sql="""
SELECT station_key, '{"station":"'||station_key||'","total":'||CAST(sum(reading) AS VARCHAR)||',"slots":'||CAST(count(*) AS VARCHAR)||'}' AS payload FROM flows GROUP BY 1""")
def _(n):
    g = n.flows.groupBy("station_key").agg(F.sum("reading").alias("total"), F.count(F.lit(1)).alias("slots"))
    return g.select("station_key", F.to_json(F.struct(F.col("station_key").alias("station"), "total", "slots")).alias("payload"))


# -- interval and kernel joins ----------------------------------------------------------------
@register("j3_closed_cells", "station_key slot:t reading:i closed:b after:b", ctes="dense closures", sql="""
WITH c AS (SELECT DISTINCT station_key, slot FROM dense d JOIN closures x USING(station_key) WHERE d.slot>=x.start AND d.slot<x."end"),
re AS (SELECT station_key, CASE WHEN time_bucket(INTERVAL 15 MINUTE,"end")="end" THEN "end" ELSE time_bucket(INTERVAL 15 MINUTE,"end")+INTERVAL 15 MINUTE END r FROM closures),
a AS (SELECT DISTINCT station_key, r+to_minutes(CAST(15*i AS BIGINT)) slot FROM re, range(4) t(i))
SELECT d.station_key, d.slot, reading, c.slot IS NOT NULL AS closed, a.slot IS NOT NULL AS "after" FROM dense d LEFT JOIN c USING(station_key, slot) LEFT JOIN a USING(station_key, slot) WHERE c.slot IS NOT NULL OR a.slot IS NOT NULL""")
def _(n):
    return jn.closed_cells(n.dense, n.closures, n.clock).filter("closed OR after")


KERN = "(SELECT unnest([-6,-5,-4,-3,-2,-1,0,1]) k, unnest([0.015,0.025,0.057,0.087,0.115,0.128,0.146,0.010]::DOUBLE[]) f, 'arrival' phase UNION ALL SELECT unnest([0,1,2,3,4,5,6,7]), unnest([0.130,0.140,0.109,0.080,0.049,0.025,0.011,0.004]::DOUBLE[]), 'departure')"
cte("kload", "crowd", f"SELECT crowd_id, venue_key, time_bucket(INTERVAL 15 MINUTE, CASE WHEN phase='arrival' THEN start ELSE \"end\" END)+to_minutes(CAST(15*k AS BIGINT)) AS slot, phase, attendance*f AS load FROM crowd, {KERN} kern")
cte("vkm", "venues stations", f"SELECT v.venue_key, s.station_key, {hav('v', 's')} AS km FROM venues v, stations s")
cte("vshare", "vkm", """SELECT venue_key, station_key, g/sum(g) OVER (PARTITION BY venue_key) AS share FROM (
SELECT venue_key, station_key, exp(-km*km/(2*0.36::DOUBLE)) g FROM (SELECT *, row_number() OVER (PARTITION BY venue_key ORDER BY km, station_key) r, count_if(km<=2) OVER (PARTITION BY venue_key) near FROM vkm) WHERE (near>0 AND km<=2) OR (near=0 AND r<=2)) QUALIFY share>0.01""")
cte("eload", "kload vshare", "SELECT station_key, slot, sum(load*share) AS event_load FROM kload JOIN vshare USING(venue_key) GROUP BY 1,2")


@register("j4_kernel_load", "crowd_id:i venue_key slot:t phase load:f", ctes="kload", sql="SELECT * FROM kload")
def _(n):
    return jn.kernel_load(n.crowd_events, n.params, n.clock)


# -- proximity --------------------------------------------------------------------------------
@register("j5_homes_near_stops", "home_id:i stop_id:i km:f", ctes="homes stops", sql=f"SELECT home_id, stop_id, km FROM (SELECT home_id, stop_id, {hav('homes', 'stops')} AS km FROM homes, stops) WHERE km<=1.2")
def _(n):
    return jn.within_km(n.homes, n.stops.drop("line", "stop_name"), 1.2)


@register("j6_close_stop_pairs", "stop_id:i other:i km:f", ctes="stops", sql=f"SELECT stop_id, other, km FROM (SELECT a.stop_id, b.stop_id other, {hav('a', 'b')} AS km FROM stops a JOIN stops b ON a.stop_id<b.stop_id) WHERE km<=1.5")
def _(n):
    return jn.too_close_pairs(n.stops, "stop_id", 1.5)


@register("j7_nearest_three", "home_id:i stop_id:i km:f rank:i", ctes="homes stops", sql=f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY home_id ORDER BY km, stop_id) rank FROM (SELECT home_id, stop_id, {hav('homes', 'stops')} AS km FROM homes, stops) WHERE km<=1.5) WHERE rank<=3")
def _(n):
    return jn.nearest_k(n.homes, n.stops.drop("line", "stop_name"), "home_id", "stop_id", 1.5, 3)


@register("j7_nearest_any", "home_id:i stop_id:i km:f", ctes="homes stops", sql=f"SELECT home_id, stop_id, km FROM (SELECT *, row_number() OVER (PARTITION BY home_id ORDER BY km, stop_id) rank FROM (SELECT home_id, stop_id, {hav('homes', 'stops')} AS km FROM homes, stops)) WHERE rank=1")
def _(n):
    return jn.nearest(n.homes, n.stops.drop("line", "stop_name"), "home_id", "stop_id")


# -- text joins -------------------------------------------------------------------------------
cte("gaz", "", "SELECT DISTINCT alias FROM (SELECT " + FOLD.format("array_to_string(list_slice(string_split(text,' '),1,2),' ')") + " alias FROM benchmark) WHERE length(alias)>=6")


def gazetteer(n):
    w = F.split("text", " ")
    return n.raw("benchmark").select(tx.fold(F.concat_ws(" ", F.slice(w, 1, 2))).alias("alias")).filter(F.length("alias") >= 6).distinct()


@register("j8_longest_alias", "doc_id:i alias", ctes="gaz", sql=f"""
SELECT doc_id, first(alias ORDER BY length(alias) DESC, strpos(t, alias)) alias FROM (SELECT doc_id, {FOLD.format('text')} t FROM documents) JOIN gaz ON contains(t, alias) GROUP BY 1""")
def _(n):
    return jn.longest_mention(n.raw("documents").select("doc_id", "text"), gazetteer(n), "doc_id")


REQ = """SELECT DISTINCT CASE user_id%4 WHEN 0 THEN 'S+U Nation_'||k||' Bhf (Berlin)' WHEN 1 THEN 'nation '||k WHEN 2 THEN [CASE WHEN user_id%8=2 THEN 'Natiom ' ELSE 'Mation ' END][1]||k ELSE 'Nation_'||k||'x0' END AS request,
CASE user_id%4 WHEN 2 THEN [CASE WHEN user_id%8=2 THEN 'natiom ' ELSE 'mation ' END][1]||k WHEN 3 THEN 'nation '||k||'x0' ELSE 'nation '||k END AS nk FROM (SELECT user_id, CAST(user_id%31 AS VARCHAR) k FROM events)"""


def name_requests(n):
    u = F.col("user_id")
    k = (u % 31).cast("string")
    r = (F.when(u % 4 == 0, F.concat(F.lit("S+U Nation_"), k, F.lit(" Bhf (Berlin)"))).when(u % 4 == 1, F.concat(F.lit("nation "), k))
         .when(u % 8 == 2, F.concat(F.lit("Natiom "), k)).when(u % 4 == 2, F.concat(F.lit("Mation "), k)).otherwise(F.concat(F.lit("Nation_"), k, F.lit("x0"))))
    return n.raw("events").select(r.alias("request"))


@register("j9_resolve_names", "request match_kind station_key candidates:a", ctes="stations", sql=f"""
WITH r AS ({REQ}),
s AS (SELECT station_key, trim(regexp_replace(lower(name),'[^a-z0-9()]+',' ','g')) sk FROM stations),
ex AS (SELECT request, station_key FROM r JOIN s ON nk=sk),
cl AS (SELECT request, station_key, 1-levenshtein(nk,sk)/greatest(length(nk),length(sk)) sc, sk FROM r JOIN s ON nk<>sk),
cb AS (SELECT request, count(*) n, first(station_key ORDER BY sc DESC, sk) station_key, max(sc) sc FROM cl WHERE sc>=0.75 GROUP BY 1),
pt AS (SELECT request, list(station_key ORDER BY station_key) c FROM r JOIN s ON contains(' '||sk||' ', ' '||nk||' ') GROUP BY 1)
SELECT r.request, CASE WHEN ex.station_key IS NOT NULL THEN 'exact' WHEN cb.n=1 OR cb.sc>0.9 THEN 'close' WHEN pt.c IS NULL THEN 'unknown' WHEN len(pt.c)>1 THEN 'ambiguous' ELSE 'part' END match_kind,
coalesce(ex.station_key, CASE WHEN cb.n=1 OR cb.sc>0.9 THEN cb.station_key END, CASE WHEN len(pt.c)=1 THEN pt.c[1] END) AS station_key,
CASE WHEN ex.station_key IS NOT NULL THEN [ex.station_key] WHEN cb.n=1 OR cb.sc>0.9 THEN [cb.station_key] ELSE coalesce(pt.c, []) END candidates
FROM r LEFT JOIN ex USING(request) LEFT JOIN cb USING(request) LEFT JOIN pt USING(request)""")
def _(n):
    return jn.resolve_names(name_requests(n), n.stations)


@register("j9_close_names", "name other score:f", sql="""
WITH k AS (SELECT DISTINCT lower(p_name) k FROM part), c AS (SELECT DISTINCT lower(p_name)||'x' k FROM part WHERE p_partkey%3=0 UNION SELECT DISTINCT 'q'||substr(lower(p_name),2) FROM part WHERE p_partkey%3=1)
SELECT a.k AS name, b.k AS other, 1-levenshtein(a.k,b.k)/greatest(length(a.k),length(b.k)) score FROM c a JOIN k b ON a.k<>b.k WHERE 1-levenshtein(a.k,b.k)/greatest(length(a.k),length(b.k))>=0.9""")
def _(n):
    """Misspelled part names, the first letter among them, against all part names: every pair above the cutoff."""
    k, name = n.raw("part"), F.lower("p_name")
    odd = k.filter("p_partkey % 3 = 0").select(F.concat(name, F.lit("x")).alias("lk")).unionByName(k.filter("p_partkey % 3 = 1").select(F.concat(F.lit("q"), F.expr("substring(lower(p_name), 2)")).alias("lk")))
    return jn.close_names(odd, k.select(name.alias("rk")), 0.9).select(F.col("lk").alias("name"), F.col("rk").alias("other"), "score")


TOK = "list_distinct(string_split(trim(regexp_replace(lower({0}),'[^a-z0-9]+',' ','g')),' '))"


@register("j9b_rare_tokens", "doc_id:i name hits:i", sql=f"""
WITH o AS (SELECT DISTINCT name, token FROM (SELECT CAST(item_id AS VARCHAR) AS name, unnest({TOK.format("replace(replace(replace(replace(text,'ß','ss'),'ä','ae'),'ö','oe'),'ü','ue')")}) token FROM benchmark) WHERE length(token)>=5),
k AS (SELECT token FROM o GROUP BY 1 HAVING count(*)<=3), w AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest({TOK.format("replace(replace(replace(replace(lower(text),'ß','ss'),'ä','ae'),'ö','oe'),'ü','ue')")}) token FROM documents WHERE lang='en') WHERE length(token)>=5),
h AS (SELECT doc_id, name, count(*) hits FROM w JOIN o USING(token) WHERE token IN (SELECT token FROM k) GROUP BY 1,2)
SELECT doc_id, name, hits FROM (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY hits DESC) r FROM h) WHERE r=1""")
def _(n):
    b = n.raw("benchmark").select("text", F.col("item_id").cast("string").alias("id"))
    owners = b.select(F.col("id").alias("label"), F.col("text").alias("name"))
    d = n.raw("documents").filter("lang = 'en'").select("doc_id", "text")
    hits = jn.rare_token_join(d, owners, "doc_id")
    return hits.join(owners, "name").select("doc_id", F.col("label").alias("name"), "hits")


@register("j11_plain_baseline", "station_key tod:i mean:f days:i", ctes="dense closures crowd", sql="""
SELECT station_key, tod, avg(reading) mean, count(*) AS days FROM dense d WHERE daytype=0 AND day NOT IN (SELECT CAST(start - INTERVAL 5 HOUR AS DATE) FROM crowd WHERE attendance>=2500)
AND NOT EXISTS (SELECT 1 FROM closures c WHERE c.station_key=d.station_key AND CAST(c.start - INTERVAL 5 HOUR AS DATE)=d.day) GROUP BY 1,2""")
def _(n):
    busy = n.crowd_events.filter("attendance >= 2500").select(t.service_day("start").alias("day")).distinct()
    shut = n.closures.select(F.explode("stations").alias("station_key"), t.service_day("start").alias("day")).distinct()
    c = n.dense.filter("daytype = 0").join(busy, "day", "left_anti").join(shut, ["station_key", "day"], "left_anti")
    return c.groupBy("station_key", "tod").agg(F.avg("reading").alias("mean"), F.count(F.lit(1)).alias("days"))


# -- windows ----------------------------------------------------------------------------------
cte("normal", "dense", "SELECT *, avg(reading) OVER (PARTITION BY station_key, daytype, tod) AS expected FROM dense")
cte("alerts", "normal caps", """SELECT *, CASE WHEN expected>0 THEN least(floor(-expected*ln(0.5::DOUBLE)),ceiling) ELSE 0 END AS q95, CASE WHEN expected>0 THEN least(floor(-expected*ln(0.3::DOUBLE)),ceiling) ELSE 0 END AS q99 FROM normal JOIN caps USING(station_key)""")
cte("fires", "alerts", """SELECT rule, station_key, slot, day, tod FROM (SELECT *, reading>q95 AND lag(reading) OVER w>lag(q95) OVER w AS r1, reading>q95 AND lag(reading) OVER w>lag(q95) OVER w AND lag(reading,2) OVER w>lag(q95,2) OVER w AS r2,
reading>q99 AND lag(reading) OVER w>lag(q99) OVER w AS r3, count(*) OVER v=4 AND (sum(reading) OVER v-sum(expected) OVER v)/sqrt(greatest(sum(expected*expected) OVER v,1))>3 AS r4
FROM alerts WINDOW w AS (PARTITION BY station_key, day ORDER BY tod), v AS (PARTITION BY station_key, day ORDER BY tod ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) UNPIVOT (fired FOR rule IN (r1 AS 'R1', r2 AS 'R2', r3 AS 'R3', r4 AS 'R4')) WHERE fired""")


def normal(n):
    from pyspark.sql import Window

    w = Window.partitionBy("station_key", "daytype", "tod")
    return n.dense.withColumn("expected", F.avg("reading").over(w))


def alert_cells(n):
    c = normal(n).join(st.ceilings(n.dense), "station_key")
    return c.withColumn("q95", noise.quantile("expected", "ceiling", 0.5)).withColumn("q99", noise.quantile("expected", "ceiling", 0.7))


@register("w1_rolling_z", "station_key day:d tod:i obs4:i exp4:f z:f", ctes="normal", sql="""
SELECT * FROM (SELECT station_key, day, tod, sum(reading) OVER v obs4, sum(expected) OVER v exp4, (sum(reading) OVER v-sum(expected) OVER v)/sqrt(sum(expected*expected) OVER v+1) z FROM normal WINDOW v AS (PARTITION BY station_key, day ORDER BY tod ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER v=4)
QUALIFY row_number() OVER (PARTITION BY station_key, day ORDER BY z DESC, tod)=1""")
def _(n):
    return win.best_window(win.rolling_z(normal(n)))


@register("w2_alert_rules", "rule station_key slot:t", ctes="fires", sql="SELECT rule, station_key, slot FROM fires")
def _(n):
    return win.long_rules(win.alert_rules(alert_cells(n)))


@register("w3_alert_episodes", "rule station_key slot:t", ctes="fires", sql="""
SELECT rule, station_key, slot FROM (SELECT *, CAST(day - DATE '1970-01-01' AS BIGINT)*80+tod op FROM fires) QUALIFY op-coalesce(lag(op) OVER (PARTITION BY rule, station_key ORDER BY op),-1000)>4""")
def _(n):
    return win.episodes(win.long_rules(win.alert_rules(alert_cells(n))), clock=n.clock)


@register("w4_islands", "station_key day:d tod_from:i tod_to:i n:i", ctes="normal", sql="""
SELECT station_key, day, min(tod) tod_from, max(tod) tod_to, count(*) n FROM (SELECT *, sum(nw) OVER (PARTITION BY station_key, day ORDER BY tod) g FROM (SELECT *, CASE WHEN tod-lag(tod) OVER (PARTITION BY station_key, day ORDER BY tod)<=2 THEN 0 ELSE 1 END nw FROM normal WHERE reading>expected)) GROUP BY station_key, day, g""")
def _(n):
    f = win.islands(normal(n).filter("reading > expected"), ["station_key", "day"], "tod", 2)
    return f.groupBy("station_key", "day", "island").agg(F.min("tod").alias("tod_from"), F.max("tod").alias("tod_to"), F.count(F.lit(1)).alias("n"))


cte("rainy", "weather", "SELECT * FROM weather WHERE prcp>=1.0")


@register("w5_rain_episodes", "day:d start:t last_slot:t max_rain:f mm:f", ctes="rainy", sql="""
SELECT day, date_trunc('hour',min(slot)) AS start, max(slot) last_slot, max(prcp) max_rain, sum(prcp)/4 mm FROM (SELECT *, sum(nw) OVER (PARTITION BY day ORDER BY slot) g FROM (SELECT *, CASE WHEN slot-lag(slot) OVER (PARTITION BY day ORDER BY slot)<=INTERVAL 30 MINUTE THEN 0 ELSE 1 END nw FROM rainy))
GROUP BY day, g HAVING max(slot)-date_trunc('hour',min(slot))>=INTERVAL 30 MINUTE""")
def _(n):
    return win.rain_episodes(n.weather.filter("prcp >= 1.0"))


@register("w6_wet_window", "day:d max_rain:f start:t last_slot:t slots:i", ctes="weather", sql="""
WITH g AS (SELECT *, sum(nw) OVER (PARTITION BY day ORDER BY slot) g FROM (SELECT *, CASE WHEN slot-lag(slot) OVER (PARTITION BY day ORDER BY slot)<=INTERVAL 15 MINUTE THEN 0 ELSE 1 END nw FROM weather WHERE prcp>0)),
b AS (SELECT day, max(prcp) max_rain, first(g ORDER BY prcp DESC, slot) g FROM g GROUP BY 1)
SELECT day, max_rain, min(slot) AS start, max(slot) last_slot, count(*) slots FROM g JOIN b USING(day, g) GROUP BY 1,2""")
def _(n):
    return win.wet_window_at_peak(n.weather)


@register("w7_zero_runs", "station_key day:d tod_from:i zero_slots:i", ctes="normal", sql="""
SELECT station_key, day, min(tod) tod_from, count(*) zero_slots FROM (SELECT *, tod-row_number() OVER (PARTITION BY station_key, day ORDER BY tod) g FROM normal WHERE reading=0 AND expected>20) GROUP BY station_key, day, g HAVING count(*)>=3""")
def _(n):
    return win.zero_runs(normal(n))


@register("w8_merged_closures", "station_key start:t end:t n:i", ctes="closures", sql="""
SELECT station_key, min(start) AS start, max("end") AS "end", count(*) n FROM (SELECT *, sum(nw) OVER (PARTITION BY station_key ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) g FROM (
SELECT *, CASE WHEN start<max("end") OVER (PARTITION BY station_key ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END nw FROM closures)) GROUP BY station_key, g""")
def _(n):
    return win.merge_intervals(n.closures.select(F.explode("stations").alias("station_key"), "start", "end"), ["station_key"])


@register("w9_residuals", "station_key daytype:i n:i sd:f", ctes="normal", sql="SELECT station_key, daytype, count(*) n, stddev_pop(reading-expected) AS sd FROM normal GROUP BY 1,2")
def _(n):
    return win.residuals(n.dense).groupBy("station_key", "daytype").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("residual").alias("sd"))


@register("w11_best_block", "station_key day:d block:i tod_from:i", ctes="dense", sql="""
SELECT station_key, day, block, tod AS tod_from FROM (SELECT station_key, day, tod, sum(reading) OVER w block, count(*) OVER w n FROM dense WINDOW w AS (PARTITION BY station_key, day ORDER BY tod ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n=8 QUALIFY row_number() OVER (PARTITION BY station_key, day ORDER BY block DESC, tod)=1""")
def _(n):
    return win.best_block(n.dense, "reading", 8)


@register("w12_fill_in_order", "trip_id:i stop_sequence:i filled:f", sql="""
WITH x AS (SELECT l_orderkey trip_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) stop_sequence, CASE WHEN l_quantity%3=0 THEN l_quantity END v FROM lineitem),
y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN stop_sequence END IGNORE NULLS) OVER a ap, last_value(v IGNORE NULLS) OVER a av, first_value(CASE WHEN v IS NOT NULL THEN stop_sequence END IGNORE NULLS) OVER b bp, first_value(v IGNORE NULLS) OVER b bv FROM x
WINDOW a AS (PARTITION BY trip_id ORDER BY stop_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY trip_id ORDER BY stop_sequence ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT trip_id, stop_sequence, CASE WHEN v IS NOT NULL THEN v WHEN ap IS NOT NULL AND bp IS NOT NULL THEN av+(bv-av)*(stop_sequence-ap)/(bp-ap) WHEN ap IS NOT NULL THEN av+stop_sequence-ap WHEN bp IS NOT NULL THEN greatest(0,bv-(bp-stop_sequence)) ELSE 0 END filled FROM y""")
def _(n):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    x = n.raw("lineitem").select(F.col("l_orderkey").alias("trip_id"), F.row_number().over(w).alias("stop_sequence"), F.when(F.col("l_quantity") % 3 == 0, F.col("l_quantity")).alias("v"))
    return win.fill_in_order(x, ["trip_id"], "stop_sequence", "v")


# -- ordering and sets ------------------------------------------------------------------------
@register("k4_natural_line_order", "pos:i line", ctes="stop_times", sql="""
SELECT row_number() OVER (ORDER BY regexp_extract(line,'^([A-Za-z]*)',1), coalesce(try_cast(regexp_extract(line,'^[A-Za-z]*(\\d+)',1) AS INT),0), line) pos, line FROM (SELECT DISTINCT line||CASE WHEN trip_id%2=0 THEN '0' ELSE '' END AS line FROM stop_times)""")
def _(n):
    from pyspark.sql import Window

    lines = n.stop_times.select(F.concat("line", F.when(F.col("trip_id") % 2 == 0, "0").otherwise("")).alias("line")).distinct()
    return lines.withColumn("pos", F.row_number().over(Window.orderBy(*tx.natural_key("line"))))


@register("u3_missing_slots", "station_key missing:i", ctes="dense flows", sql="SELECT station_key, count(*) AS missing FROM dense d WHERE NOT EXISTS (SELECT 1 FROM flows f WHERE f.station_key=d.station_key AND f.slot=d.slot) GROUP BY 1")
def _(n):
    return n.dense.select("station_key", "slot").join(n.flows, ["station_key", "slot"], "left_anti").groupBy("station_key").agg(F.count(F.lit(1)).alias("missing"))


@register("u4_common_lines", "src dst common:a overlap:f", ctes="edges stations", sql="""
SELECT DISTINCT src, dst, list_sort(list_intersect(a.lines, b.lines)) common, len(list_intersect(a.lines,b.lines))/len(list_distinct(list_concat(a.lines,b.lines))) overlap FROM edges JOIN stations a ON a.station_key=src JOIN stations b ON b.station_key=dst""")
def _(n):
    s = n.stations.select("station_key", "lines")
    e = n.edges.select("src", "dst").distinct().join(s.toDF("src", "la"), "src").join(s.toDF("dst", "lb"), "dst")
    i = F.array_sort(F.array_intersect("la", "lb"))
    return e.select("src", "dst", i.alias("common"), (F.size(i) / F.size(F.array_union("la", "lb"))).alias("overlap"))
