"""Timetable, text audit, sources and streams on the bound tables."""

from pyspark.sql import functions as F

from flowspark.bindings import station_of
from flowspark.catalog.ctes import cte, hav
from flowspark.catalog.registry import register
from flowspark.catalog.toolkit import alert_cells, gazetteer, normal
from flowspark.functions import text as tx
from flowspark.functions import time as t
from flowspark.functions.lineage import cut, shared_folder
from flowspark.operators import graph as g
from flowspark.operators import textaudit as ta
from flowspark.operators import timetable as tt
from flowspark.operators import windows as win
from flowspark.sources import quality as q
from flowspark.sources import tables as src
from flowspark.streaming import streams as sm

cte("trips", "stop_times", "SELECT *, CAST(epoch(departure)/1440 AS BIGINT) AS t FROM stop_times")
cte("segs", "trips", "SELECT line, trip_id, stop_sequence, least(stop_id, nxt) AS a, greatest(stop_id, nxt) AS b, CASE WHEN tn>=t THEN tn-t END AS dt FROM (SELECT *, lead(stop_id) OVER w AS nxt, lead(t) OVER w AS tn FROM trips WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)) WHERE nxt IS NOT NULL AND nxt<>stop_id")
cte("tte", "segs", "SELECT line, a, b, CAST(greatest(30, coalesce(floor(median(dt)),120)) AS BIGINT) AS travel_time, count(*) AS runs FROM segs GROUP BY 1,2,3")


def trips(n):
    day = F.unix_date(F.to_date("departure")).cast("long")
    return n.stop_times.withColumn("t", day * 60)


@register("n9_timetable_edges", "line a:i b:i travel_time:i runs:i", ctes="tte", sql="SELECT * FROM tte")
def _(n):
    return tt.timetable_edges(trips(n))


@register("n9_multimodal_edges", "mode edges:i seconds:i", ctes="tte stops", sql=f"""
SELECT "mode", count(*) edges, sum(travel_time) AS "seconds" FROM (SELECT CASE WHEN line LIKE 'U%' THEN 'subway' WHEN line LIKE 'M%' THEN 'tram' ELSE 'bus' END AS "mode", travel_time FROM tte UNION ALL
SELECT 'walk', CAST(floor(km*1000/1.2+60) AS BIGINT) FROM (SELECT x.stop_id a, y.stop_id b, {hav('x', 'y')} AS km FROM stops x JOIN stops y ON x.stop_id<y.stop_id) w WHERE km<=2.0 AND NOT EXISTS (SELECT 1 FROM tte WHERE tte.a=w.a AND tte.b=w.b)) GROUP BY 1""")
def _(n):
    e = tt.multimodal_edges(trips(n), n.stops, 2.0)
    return e.groupBy("mode").agg(F.count(F.lit(1)).alias("edges"), F.sum("travel_time").alias("seconds"))


@register("n9b_first_edges", "line a:i b:i travel_time:i", ctes="segs", sql="SELECT line, a, b, greatest(30, coalesce(first(dt ORDER BY trip_id, stop_sequence),120)) travel_time FROM segs GROUP BY 1,2,3")
def _(n):
    return tt.first_edges(trips(n))


@register("n9b_station_walks", "a:i b:i travel_time:i", ctes="stops", sql="SELECT x.stop_id a, y.stop_id b, 180 travel_time FROM stops x JOIN stops y ON x.stop_id//3=y.stop_id//3 AND x.stop_id<y.stop_id")
def _(n):
    return tt.station_walks(n.stops.select("stop_id", F.floor(F.col("stop_id") / 3).alias("station")))


@register("n10_network_stats", "mode edges:i lines:i stops:i", ctes="tte", sql="""
WITH e AS (SELECT CASE WHEN line LIKE 'U%' THEN 'subway' WHEN line LIKE 'M%' THEN 'tram' ELSE 'bus' END AS "mode", * FROM tte)
SELECT e."mode", count(*) edges, count(DISTINCT line) AS "lines", any_value(s.n) stops FROM e JOIN (SELECT "mode", count(DISTINCT stop) n FROM (SELECT "mode", a AS stop FROM e UNION ALL SELECT "mode", b FROM e) GROUP BY 1) s ON s."mode"=e."mode" GROUP BY 1""")
def _(n):
    e = tt.timetable_edges(trips(n)).withColumn("mode", tx.line_mode("line"))
    return tt.network_stats(e)


@register("n11_lines_at", "request mode lines:a stops:i", ctes="stops stop_times", sql="""
WITH r AS (SELECT DISTINCT CASE WHEN c_custkey%2=0 THEN 'Supplier#'||lpad(CAST(c_custkey%100 AS VARCHAR),9,'0') ELSE '0'||lpad(CAST(c_custkey%30 AS VARCHAR),3,'0') END request FROM customer), k AS (SELECT request, regexp_replace(lower(request),'[^a-z0-9]+','','g') rk FROM r),
s AS (SELECT stop_id, regexp_replace(lower(stop_name),'[^a-z0-9]+','','g') sk FROM stops), m AS (SELECT request, stop_id, strpos(sk, rk) p FROM k JOIN s ON contains(sk, rk)), f AS (SELECT *, min(p) OVER (PARTITION BY request) b FROM m)
SELECT request, CASE WHEN line LIKE 'U%' THEN 'subway' WHEN line LIKE 'M%' THEN 'tram' ELSE 'bus' END AS "mode", list_sort(list(DISTINCT line)) AS "lines", count(DISTINCT f.stop_id) stops FROM f JOIN stop_times st ON st.stop_id=f.stop_id WHERE b>1 OR p=1 GROUP BY 1,2""")
def _(n):
    c = F.col("c_custkey")
    r = n.raw("customer").select(F.when(c % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad((c % 100).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("0"), F.lpad((c % 30).cast("string"), 3, "0"))).alias("request"))
    return tt.lines_at(r, n.stops, tt.stop_routes(n.stop_times))


@register("n12_line_stops", "line trip_id:i stop_sequence:i stop_id:i t:i", ctes="trips", sql="""
SELECT line, trip_id, stop_sequence, stop_id, t FROM trips WHERE trip_id IN (SELECT first(trip_id ORDER BY n DESC, direction_id, trip_id) FROM (SELECT line, trip_id, direction_id, count(*) n FROM trips GROUP BY 1,2,3) GROUP BY line)""")
def _(n):
    return tt.line_stops(trips(n))


@register("n13_line_list", "line stops:i trips:i", ctes="stop_times", sql="SELECT line, max(n) stops, count(*) trips FROM (SELECT line, trip_id, count(*) n FROM stop_times GROUP BY 1,2) GROUP BY 1")
def _(n):
    return tt.line_list(n.stop_times)


@register("n13_direct_lines", "origin:i destination:i lines:a", ctes="stop_times segs", sql="""
WITH r AS (SELECT DISTINCT stop_id, line FROM stop_times), o AS (SELECT DISTINCT a, b FROM segs) SELECT a AS origin, b AS destination, list_sort(list(DISTINCT x.line)) AS "lines" FROM o JOIN r x ON x.stop_id=a JOIN r y ON y.stop_id=b AND y.line=x.line GROUP BY 1,2""")
def _(n):
    od = tt.segments(trips(n)).select(F.col("a").alias("origin"), F.col("b").alias("destination"))
    return tt.direct_lines(od, tt.stop_routes(n.stop_times))


FOLDT = "translate(replace(lower(text),'ß','ss'),'äöüáàâéèêëíìîïóòôúùûçñ','aouaaaeeeeiiiiooouuucn')"


@register("n14_stations_in_text", "doc_id:i rank:i alias", ctes="gaz", sql=f"""
WITH m AS (SELECT doc_id, alias, strpos(t, alias) p FROM (SELECT doc_id, {FOLDT} t FROM documents) JOIN gaz ON contains(t, alias))
SELECT doc_id, rank, alias FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, alias) rank FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.doc_id=a.doc_id AND length(b.alias)>length(a.alias) AND contains(b.alias, a.alias))) WHERE rank<=2""")
def _(n):
    return tt.stations_in_text(n.raw("documents").select("doc_id", "text"), gazetteer(n), "doc_id")


# -- text audit -------------------------------------------------------------------------------
def doc_figures(n):
    """Figures of all documents with a running id per document."""
    from pyspark.sql import Window

    f = ta.figures(n.raw("documents").select("doc_id", "text"), ["doc_id"])
    return f.groupBy("doc_id", "kind", "raw", "value", "unit", "decimals", "tol").agg(F.count(F.lit(1)).alias("times")).withColumn(
        "fig_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "raw")))


@register("x1_figures", "doc_id:i kind raw value:f unit tol:f times:i")
def _(n):
    """Figures of whole texts; the patterns need look-behind, so the tests compare with plain regular expressions."""
    return doc_figures(n)


@register("x1b_flatten_json", "path number:i n:i", sql="SELECT 'k' path, CAST(json_extract_string(props,'$.k') AS BIGINT) number, count(*) n FROM events GROUP BY 1,2")
def _(n):
    f = ta.flatten_json(n.raw("events").select("event_id", "props"), "event_id", "props", 2)
    return f.groupBy("path", "number").agg(F.count(F.lit(1)).alias("n"))


SENTENCES = """(SELECT {key}, unnest(CASE WHEN regexp_matches(line,'^\\s*\\|') THEN [line] ELSE string_split_regex(regexp_replace(line,'([.!?])\\s+','\\1'||chr(1),'g'),chr(1)) END) AS s, regexp_matches(line,'^\\s*\\|') AS is_row FROM (SELECT {key}, unnest(string_split(text, chr(10))) line FROM {table}))"""


@register("x1d_sentences", "conv_id:i turn:i sentences:i table_rows:i", sql=f"SELECT conv_id, turn, count_if(NOT is_row) sentences, count_if(is_row) table_rows FROM {SENTENCES.format(key='conv_id, turn', table='conversations')} WHERE trim(s)<>'' GROUP BY 1,2")
def _(n):
    s = ta.sentences(n.raw("conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    return s.groupBy("conv_id", "turn").agg(F.count_if(F.col("header").isNull()).alias("sentences"), F.count_if(F.col("header").isNotNull()).alias("table_rows"))


@register("x1c_sentence_mentions", "alias n:i docs:i", ctes="gaz", sql=f"""
SELECT alias, count(*) n, count(DISTINCT doc_id) docs FROM (SELECT doc_id, translate(replace(lower(s),'ß','ss'),'äöüáàâéèêëíìîïóòôúùûçñ','aouaaaeeeeiiiiooouuucn') t FROM {SENTENCES.format(key='doc_id', table='documents')} WHERE trim(s)<>'')
JOIN gaz ON contains(t, alias) AND regexp_matches(t, '(^|[^a-z0-9])'||regexp_escape(alias)||'([^a-z0-9]|$)') GROUP BY 1""")
def _(n):
    """Sentences of whole documents with the names in them, word by word."""
    from flowspark.operators.joins import mentions

    s = ta.sentences(n.raw("documents").select("doc_id", "text"), ["doc_id"]).select("doc_id", "line_no", "sentence_no", F.col("sentence").alias("text"))
    m = mentions(s, gazetteer(n), word_bounded=True, longest=False).select("doc_id", "line_no", "sentence_no", "alias").distinct()
    return m.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@register("x2_check_figures", "status n:i", sql="""
WITH f AS (SELECT o_orderkey doc, 0 id, round(o_totalprice/1000) v FROM orders UNION ALL SELECT l_orderkey, 1, max(l_quantity)-min(l_quantity) FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 2, round(max(l_quantity)/min(l_quantity), 1) FROM lineitem GROUP BY 1),
t AS (SELECT *, CASE WHEN id=2 THEN 0.05 WHEN v>=100 AND v%10=0 THEN greatest(0.5, 0.012*v) ELSE 0.5 END tol FROM f WHERE v IS NOT NULL), n AS (SELECT DISTINCT l_orderkey doc, l_returnflag parent, l_quantity x, CAST(l_linenumber%2 AS VARCHAR) st FROM lineitem),
s AS (SELECT doc, id, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.doc=t.doc AND abs(x-v)<=tol+1e-9 AND (id<>0 OR st='1')) THEN 'verified'
WHEN EXISTS (SELECT 1 FROM n a JOIN n b ON a.doc=b.doc AND a.parent=b.parent AND a.x<>b.x WHERE a.doc=t.doc AND (id<>0 OR a.st='1') AND (abs(abs(a.x-b.x)-v)<=tol+1e-9 OR abs(a.x/b.x-v)<=tol+1e-9 OR abs(abs(a.x/b.x-1)*100-v)<=tol+1e-9)) THEN 'calculated' ELSE 'not_found' END status FROM t)
SELECT status, count(*) n FROM s GROUP BY 1""")
def _(n):
    """Figures of orders against quantities of their lines, with stations in the context of one of the figures."""
    o, li = n.raw("orders"), n.raw("lineitem")
    none = F.array().cast("array<string>")
    f = o.select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("fig_id"), F.round(F.col("o_totalprice") / 1000).alias("value"), F.array(F.lit("1")).alias("stations"))
    g = li.groupBy(F.col("l_orderkey").alias("doc")).agg((F.max("l_quantity") - F.min("l_quantity")).alias("d"), F.round(F.max("l_quantity") / F.min("l_quantity"), 1).alias("q"))
    f = f.unionByName(g.select("doc", F.lit(1).alias("fig_id"), F.col("d").alias("value"), none.alias("stations"))).unionByName(g.select("doc", F.lit(2).alias("fig_id"), F.col("q").alias("value"), none.alias("stations"))).filter("value IS NOT NULL")
    v = F.col("value")
    tol = F.when(F.col("fig_id") == 2, 0.05).when((v >= 100) & (v % 10 == 0), F.greatest(F.lit(0.5), 0.012 * v)).otherwise(0.5)
    figs = f.select("doc", "fig_id", "value", F.lit("").alias("unit"), tol.alias("tol"), "stations")
    facts = li.select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("parent"), F.col("l_quantity").alias("number"), F.array((F.col("l_linenumber") % 2).cast("string")).alias("stations"))
    return ta.check_figures(figs, facts, "doc").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("x3_consistency", "lang runs:i in_common:i in_any:i share_identical:f")
def _(n):
    """Figures that all sources of a language share."""
    d = n.raw("documents").select("lang", "source", "doc_id", "text")
    return ta.consistency(ta.figures(d, ["lang", "source", "doc_id"]), "lang", "source")


# -- sources ----------------------------------------------------------------------------------
@register("s7_last_wins", "user_id:i event_type event_id:i value:f", sql="SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)=1")
def _(n):
    return src.last_wins(n.raw("events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])


@register("s10_closure_ends", "dur end:t n:i", sql="SELECT dur, CAST(ts AS DATE)+to_minutes(CAST((user_id%5)*60+user_id%60 AS BIGINT)) AS \"end\", count(*) n FROM (SELECT *, CAST(user_id%5 AS VARCHAR)||'h'||CAST(user_id%60 AS VARCHAR)||'min' dur FROM events) GROUP BY 1,2")
def _(n):
    u = F.col("user_id")
    dur = F.concat((u % 5).cast("string"), F.lit("h"), (u % 60).cast("string"), F.lit("min"))
    e = n.raw("events").select(dur.alias("dur"), F.to_date("ts").cast("timestamp_ntz").alias("start"))
    return e.groupBy("dur", tx.closure_end("start", "dur").alias("end")).agg(F.count(F.lit(1)).alias("n"))


@register("s11_energy_long", "day:d line kwh:f", ctes="energy", sql="SELECT day, line, mwh*1000 AS kwh FROM energy")
def _(n):
    lines = [f"L{i}" for i in range(5)]
    wide = n.energy.groupBy("day").pivot("line", lines).agg(F.first("mwh"))
    return wide.unpivot("day", lines, "line", "mwh").filter("mwh IS NOT NULL").withColumn("kwh", F.col("mwh") * 1000)


@register("s16_dataset_kinds", "table kind n:i", sql="SELECT 'events' AS \"table\", 'events' kind, count(*) n FROM events UNION ALL SELECT 'lineitem','energy',count(*) FROM lineitem UNION ALL SELECT 'documents','energy',count(*) FROM documents")
def _(n):
    out = None
    for name in ("events", "lineitem", "documents"):
        d = n.raw(name)
        x = d.agg(F.lit(name).alias("table"), F.lit(q.dataset_kind(d.columns, name)).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


@register("s17_grain", "station_key modal_step:i duplicates:i missing:i", ctes="fd", sql="""
WITH s AS (SELECT *, (hour(slot)*60+minute(slot))//15+CAST(CAST(slot AS DATE)-DATE '1970-01-01' AS BIGINT)*96 n FROM fd), d AS (SELECT station_key, (n-lag(n) OVER (PARTITION BY station_key, n//96 ORDER BY n))*15 step FROM s),
m AS (SELECT station_key, first(step ORDER BY c DESC, step) modal_step FROM (SELECT station_key, step, count(*) c FROM d WHERE step IS NOT NULL GROUP BY 1,2) GROUP BY 1)
SELECT s.station_key, any_value(modal_step) modal_step, 0 duplicates, CAST(max(day)-min(day) AS BIGINT)*80+first(tod ORDER BY slot DESC)-first(tod ORDER BY slot)+1-count(*) AS missing FROM s LEFT JOIN m ON m.station_key=s.station_key GROUP BY 1""")
def _(n):
    return q.grain(n.flows, n.clock)


@register("s18_validate_readings", "file rule severity n:i", sql="""
WITH r AS (SELECT event_type AS file, CASE WHEN event_id%7=0 THEN 'soon' ELSE CAST(ts AS VARCHAR) END ts, CASE WHEN event_id%11=0 THEN 'x' WHEN event_id%13=0 THEN '-5' ELSE '1' END AS value, user_id%30 k FROM events),
c AS (SELECT file, count_if(ts='soon') a, count_if(k>=25) b, count_if(value='x') c, count_if(value='-5') d, count_if(ts<>'soon' AND time_bucket(INTERVAL 15 MINUTE, try_cast(ts AS TIMESTAMP))<>try_cast(ts AS TIMESTAMP)) e FROM r GROUP BY 1)
SELECT file, rule, 'error' severity, n FROM (SELECT file, unnest(['unparsable timestamp','unknown station','non-numeric','negative','off grid']) rule, unnest([a,b,c,d,e]) n FROM c) WHERE n>0""")
def _(n):
    i = F.col("event_id")
    raw = n.raw("events").select(
        F.col("event_type").alias("file"), F.when(i % 7 == 0, "soon").otherwise(F.col("ts").cast("string")).alias("ts"),
        F.when(i % 11 == 0, "x").when(i % 13 == 0, "-5").otherwise("1").alias("value"), station_of(F.col("user_id") % 30).alias("station_key"))
    return q.validate_readings(raw, n.stations, n.clock)


@register("s18_validate_events", "rule severity n:i", ctes="crowd", sql="SELECT rule, 'warning' severity, n FROM (SELECT unnest(['unlocated venue','attendance above limit','ends before start']) rule, unnest([0, count_if(attendance>2500), count_if(\"end\"<=start)]) n FROM crowd)")
def _(n):
    return q.validate_events(n.crowd_events, n.venues, 2500)


@register("s20_load_status", "table rows:i first:t last:t issues:i", ctes="flows weather crowd closures", sql="""
SELECT 'flows' AS "table", count(*) AS "rows", min(slot) AS "first", max(slot) AS "last", 0 issues FROM flows UNION ALL SELECT 'weather', count(*), min(slot), max(slot), 0 FROM weather UNION ALL SELECT 'events', count(*), min(start), max("end"), 0 FROM crowd UNION ALL SELECT 'closures', count(*), min(start), max("end"), 0 FROM closures""")
def _(n):
    return q.load_status(n.flows, n.weather, n.crowd_events, n.closures, n.venues)


@register("s21_adjacency", "src neighbours:i first_dst riders:i", ctes="e2 flows", sql="SELECT src, count(*) neighbours, min(dst) first_dst, (SELECT sum(reading) FROM flows WHERE station_key=src) riders FROM e2 GROUP BY 1")
def _(n):
    a = g.adjacency(g.undirected(n.edges).select("src", "dst", F.lit("").alias("line"), F.lit(1.0).alias("cost")))
    r = n.flows.groupBy(F.col("station_key").alias("src")).agg(F.sum("reading").alias("riders"))
    return a.select("src", F.size("neighbours").alias("neighbours"), F.col("neighbours")[0]["dst"].alias("first_dst")).join(r, "src", "left")


# -- streams ----------------------------------------------------------------------------------
def folder(n):
    """Scratch folder for one stream, below the folder that the cluster shares."""
    return shared_folder(n.spark, "stream")


def event_stream(n):
    s = sm.read_stream(n.spark, n.sf_dir, sm.EVENT_SCHEMA, "events.parquet")
    return sm.readings(s, station_of(F.col("user_id") % 25), F.round(F.col("value") * 100).cast("long"))


CLOSED = "(SELECT max(ts) FROM events)-INTERVAL 30 MINUTE"


@register("t2_stream_slot_totals", "station_key slot:t reading:i n:i", sql=f"""
SELECT * FROM (SELECT 'S'||lpad(CAST(user_id%25 AS VARCHAR),2,'0') station_key, time_bucket(INTERVAL 15 MINUTE, ts) slot, sum(CAST(round(value*100) AS BIGINT)) reading, count(*) n FROM events GROUP BY 1,2) WHERE slot+INTERVAL 15 MINUTE<={CLOSED}""")
def _(n):
    out = sm.run_to_table(sm.slot_totals(event_stream(n)), folder(n))
    return out.withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@register("t3_stream_last_hour", "station_key slot:t hour_total:i", sql=f"""
SELECT station_key, e-INTERVAL 15 MINUTE AS slot, sum(v) hour_total FROM (SELECT 'S'||lpad(CAST(user_id%25 AS VARCHAR),2,'0') station_key, time_bucket(INTERVAL 15 MINUTE, ts)+to_minutes(CAST(15*i AS BIGINT)) e, CAST(round(value*100) AS BIGINT) v FROM events, range(1,5) r(i)) WHERE e<={CLOSED} GROUP BY 1,2""")
def _(n):
    out = sm.run_to_table(sm.last_hour(event_stream(n)), folder(n))
    return out.withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@register("t3_stream_hour_risk", "station_key slot:t hour_total:i hour_expected:f z:f above:b", ctes="normal flows", sql="""
WITH e AS (SELECT station_key, slot, sum(expected) OVER v hour_expected, sum(expected*expected) OVER v hv FROM normal WINDOW v AS (PARTITION BY station_key, day ORDER BY tod ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER v=4),
h AS (SELECT station_key, e-INTERVAL 15 MINUTE AS slot, sum(v) hour_total FROM (SELECT 'S'||lpad(CAST(user_id%25 AS VARCHAR),2,'0') station_key, time_bucket(INTERVAL 15 MINUTE, ts)+to_minutes(CAST(15*i AS BIGINT)) e, CAST(round(value*100) AS BIGINT) v FROM events, range(1,5) r(i)) WHERE e<=(SELECT max(ts) FROM events)-INTERVAL 30 MINUTE GROUP BY 1,2)
SELECT station_key, slot, hour_total, hour_expected, (hour_total-hour_expected)/sqrt(greatest(hv,1)) z, (hour_total-hour_expected)/sqrt(greatest(hv,1))>3 above FROM h JOIN e USING(station_key, slot)""")
def _(n):
    """Live hour totals against the expectation of the hour: the streamed form of rule R4."""
    live = sm.against_expected(sm.last_hour(event_stream(n)), sm.expected_hours(normal(n), n.clock))
    out = sm.run_to_table(live, folder(n))
    return out.withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@register("t4_stream_alerts", "rule station_key slot:t", ctes="fires dense", sql="""
SELECT rule, station_key, slot FROM (SELECT *, CAST(day - DATE '1970-01-01' AS BIGINT)*80+tod op FROM fires WHERE rule<>'R4') WHERE slot<=(SELECT max(slot) FROM dense)-INTERVAL 1 DAY
QUALIFY op-coalesce(lag(op) OVER (PARTITION BY rule, station_key ORDER BY op),-1000)>4""")
def _(n):
    """Files whose rows are shuffled and up to a day out of order; alerts come once the watermark has passed a slot."""
    d = folder(n)
    c = alert_cells(n).select("station_key", F.col("slot").cast("timestamp").alias("slot"), win.op_index(n.clock).alias("op"), F.col("reading").cast("long").alias("reading"), "q95", "q99")
    late = F.col("op") + F.pmod(F.xxhash64("station_key", "op"), F.lit(n.clock.slots_per_day - 10))
    lo, hi = F.min("late"), F.max("late") + 1
    c = cut(c.withColumn("late", late))
    ends = c.agg(*[(lo + (hi - lo) * k / 5).alias(f"e{k}") for k in range(6)]).first()
    for a, b in zip(ends, ends[1:]):  # one file after the other, so that they arrive in this order
        c.filter((F.col("late") >= a) & (F.col("late") < b)).drop("late").coalesce(1).write.mode("append").parquet(f"{d}/cells")
    sm.use_rocksdb(n.spark)
    s = sm.read_stream(n.spark, f"{d}/cells", "station_key string, slot timestamp, op long, reading long, q95 double, q99 double", files_per_trigger=1)
    out = sm.run_to_table(sm.alert_state(s, "1 day", slots_per_day=n.clock.slots_per_day), d)
    return out.withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@register("t5_stream_corrections", "event_type day:d rows:i total:i newest:i", sql="""
WITH v AS (SELECT event_id, event_type, ts, CAST(round(value*100) AS BIGINT) val, 1 ver FROM events UNION ALL SELECT event_id, event_type, ts, 7, 3 FROM events WHERE event_id%10=0 UNION ALL SELECT event_id, event_type, ts, 5, 2 FROM events WHERE event_id%5=0)
SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS "rows", sum(val) total, max(ver) newest FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ver DESC)=1) GROUP BY 1,2""")
def _(n):
    """Readings, their corrections and repeated files arrive in one folder, old versions after new ones; the newest version stays."""
    from flowspark.sources.ingest import VersionedTable

    d = folder(n)
    e = n.raw("events").select("event_id", "event_type", F.to_date("ts").alias("day"), F.round(F.col("value") * 100).cast("long").alias("val"), F.lit(1).cast("long").alias("ver"))
    for k, part in enumerate((e.filter("event_id % 10 = 0").withColumn("val", F.lit(7).cast("long")).withColumn("ver", F.lit(3).cast("long")), e, e.filter("event_id % 5 = 0").withColumn("val", F.lit(5).cast("long")).withColumn("ver", F.lit(2).cast("long")), e.filter("event_id % 3 = 0"))):
        part.coalesce(1).write.mode("append").parquet(f"{d}/in") if k else part.coalesce(1).write.parquet(f"{d}/in")
    table = VersionedTable(n.spark, f"{d}/table", "event_id long, event_type string, day date, val long, ver long", ["event_id"], newest="ver")
    s = n.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    sm.upsert_stream(s, table, f"{d}/ck")
    sm.upsert_stream(s, table, f"{d}/ck")  # nothing new: the table stays as it is
    return table.read().groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("rows"), F.sum("val").alias("total"), F.max("ver").alias("newest"))


@register("t5_stream_deduplicated", "event_type n:i", sql="SELECT event_type, count(*) n FROM events GROUP BY 1")
def _(n):
    s = sm.read_stream(n.spark, n.sf_dir, sm.EVENT_SCHEMA, "events.parquet")
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = sm.run_to_table(sm.without_duplicates(twice, ["event_id"]).drop("copy"), folder(n))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("t6_stream_sessions", "station_key start:t n:i total:i", sql=f"""
SELECT station_key, min(ts) AS start, count(*) n, sum(v) total FROM (SELECT *, sum(nw) OVER (PARTITION BY station_key ORDER BY ts, event_id) g FROM (SELECT event_id, 'S'||lpad(CAST(user_id%25 AS VARCHAR),2,'0') station_key, ts, CAST(round(value*100) AS BIGINT) v, CASE WHEN ts-lag(ts) OVER (PARTITION BY user_id%25 ORDER BY ts, event_id)<=INTERVAL 30 MINUTE THEN 0 ELSE 1 END nw FROM events)) GROUP BY station_key, g HAVING max(ts)+INTERVAL 30 MINUTE<={CLOSED}""")
def _(n):
    out = sm.run_to_table(sm.sessions(event_stream(n)), folder(n))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
