"""Readers, file checks and the ingest on files that Spark writes from the test tables."""

from pyspark.sql import functions as F

from flowspark.catalog.ctes import cte
from flowspark.catalog.registry import register
from flowspark.functions import text as tx
from flowspark.functions import time as t
from flowspark.functions.lineage import shared_folder
from flowspark.sources import folders as fo
from flowspark.sources import ingest as ing
from flowspark.sources import quality as q
from flowspark.sources import tables as src

US_TIME = "M/d/yyyy H:mm"


def put(df, path, sep=",", encoding="UTF-8", header=True):
    df.write.option("sep", sep).option("encoding", encoding).option("header", header).csv(path)


def us(c):
    return F.date_format(c, US_TIME)


# -- S1, S2: folders of several dialects ----------------------------------------------------------
def mixed_folder(n):
    """The cells as files of four dialects with their columns in different order; readings in hundredths, names with an umlaut."""
    root = shared_folder(n.spark, "mixed")
    c = n.flow_days.select("tod", F.concat(F.lit("Bhf Mühle "), "station_key").alias("station"), us("slot").alias("slot"), F.format_string("%d.%02d", F.floor(F.col("reading") / 100), F.col("reading") % 100).alias("reading"))
    part = lambda k: c.filter(F.col("tod") % 4 == k)
    put(part(0).select("station", "slot", "reading"), f"{root}/a")
    put(part(1).select("slot", F.translate("reading", ".", ",").alias("reading"), "station"), f"{root}/b/deeper", sep=";")
    put(part(2).select("reading", "station", "slot"), f"{root}/c", sep="\t", encoding="ISO-8859-1")
    put(part(3).select("slot", "station", "reading"), f"{root}/d", encoding="ISO-8859-1")
    return root


@register("s1_mixed_folder", "station day:d total:f2 n:i", ctes="fd", sql="SELECT 'Bhf Mühle '||station_key station, CAST(slot AS DATE) AS day, sum(reading)/100.0 total, count(*) n FROM fd GROUP BY 1,2")
def _(n):
    rows = src.read_csv_any(n.spark, mixed_folder(n)).withColumn("slot", src.parse_ts("slot"))
    return rows.groupBy("station", F.to_date("slot").alias("day")).agg(F.sum(src.number("reading")).alias("total"), F.count(F.lit(1)).alias("n"))


@register("s2_file_dialects", "sep encoding rows:i", ctes="fd", sql="""
SELECT ['comma','semicolon','tab','comma'][tod%4+1] sep, ['UTF-8','UTF-8','windows-1252','windows-1252'][tod%4+1] AS "encoding", count(*) AS "rows" FROM fd GROUP BY 1,2""")
def _(n):
    d = fo.file_dialects(n.spark, mixed_folder(n))
    name = F.when(F.col("sep") == ";", "semicolon").when(F.col("sep") == "\t", "tab").otherwise("comma")
    return d.groupBy(name.alias("sep"), "encoding").agg(F.sum(F.col("lines") - 1).alias("rows"))


# -- S3-S6 ------------------------------------------------------------------------------------------
@register("s3_rescued_rows", "custkey:i name segment", sql="SELECT c_custkey custkey, c_name AS name, c_mktsegment segment FROM customer")
def _(n):
    """Every fifth line is quoted as a whole."""
    path = shared_folder(n.spark, "quoted")
    line = F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment")
    n.raw("customer").select(F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('"'), line, F.lit('"'))).otherwise(line)).write.text(path)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("custkey", "name", "segment")])
    return src.read_csv_any(n.spark, path, schema, header=False)


@register("s5_repaired_text", "doc_id:i digest", sql="SELECT doc_id, md5(text) digest FROM documents")
def _(n):
    """Texts that were read as Windows-1252 and saved again."""
    garbled = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), tx.WINDOWS_AS_LATIN, tx.WINDOWS_ONLY)
    return n.raw("documents").select("doc_id", F.md5(tx.repair(garbled).cast("binary")).alias("digest"))


@register("s6_wide_counters", "station_key day:d total:i n:i", ctes="fd", sql="""
SELECT station_key, CAST(slot AS DATE) AS day, sum(reading+CASE WHEN CAST(slot AS DATE)>=DATE '2024-01-20' THEN 1 ELSE 0 END) total, count(*) n FROM fd GROUP BY 1,2""")
def _(n):
    """Two wide files: a repeated station name, and a newer file with corrected late days."""
    root, wide = shared_folder(n.spark, "wide"), [f"S{i:02d}" for i in range(25)]
    title = ["Doppelhof", *wide[1:-1], "Doppelhof.1"]
    table = lambda c: c.groupBy(us("slot").alias("t")).pivot("station_key", wide).agg(F.first("reading")).toDF("t", *title)
    put(table(n.flows), f"{root}/flows_old")
    put(table(n.flows.filter("slot >= DATE'2024-01-20'").withColumn("reading", F.col("reading") + 1)), f"{root}/flows_new")
    names = n.spark.createDataFrame([("Doppelhof", 0, "S00"), ("Doppelhof", 1, "S24"), *[(k, 0, k) for k in wide[1:-1]]], "header string, occurrence int, station_key string")
    long = src.wide_to_long(src.read_csv_any(n.spark, root), "t", names)
    return long.groupBy("station_key", F.to_date("slot").alias("day")).agg(F.sum("reading").alias("total"), F.count(F.lit(1)).alias("n"))


# -- S8, S9, S11 ------------------------------------------------------------------------------------
@register("s8_weather_file", "slot:t temp:f prcp:f wspd:f coco:f", ctes="weather", sql="SELECT slot, temp+CASE WHEN day(slot)%5=0 THEN 0.5::DOUBLE ELSE 0 END AS temp, prcp, wspd, coco FROM weather")
def _(n):
    """First column without a name; a newer file corrects every fifth day."""
    root = shared_folder(n.spark, "weather")
    w = n.weather.select(us("slot").alias(""), "slot", "temp", "prcp", "wspd", "coco")
    put(w.drop("slot"), f"{root}/weather_1")
    put(w.filter(F.dayofmonth("slot") % 5 == 0).withColumn("temp", F.col("temp") + 0.5).drop("slot"), f"{root}/weather_2", sep=";")
    return src.read_weather(n.spark, root)


@register("s9_event_files", "event_name start:t end:t attendance:i venue_key n:i", ctes="crowd", sql="""
SELECT event_name, start+INTERVAL 1 HOUR AS start, CASE WHEN crowd_id%3=0 THEN "end" ELSE "end"+INTERVAL 30 MINUTE END+INTERVAL 1 HOUR AS "end", max(attendance) attendance, venue_key, 1 n FROM crowd
GROUP BY event_name, start, venue_key, CASE WHEN crowd_id%3=0 THEN "end" ELSE "end"+INTERVAL 30 MINUTE END QUALIFY row_number() OVER (PARTITION BY event_name, start, venue_key ORDER BY 3)=1""")
def _(n):
    """Listings with UTC offsets, half of the files without a header, some without an end; places found by name in the address."""
    root = shared_folder(n.spark, "events")
    utc = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    third = F.col("crowd_id") % 3 == 0
    full = n.crowd_events.select(
        "crowd_id", "event_name", utc("start").alias("began_local"), F.when(~third, utc(F.col("end") + t.minutes(30))).alias("estimated_end_local"), F.lit("Hall").alias("venue_name"),
        F.concat(F.lit("12 Long Street, Arena "), "venue_key").alias("address"), F.lit("B").alias("city"), F.lit("DE").alias("country"), "segment", F.lit("x").alias("genre"), F.lit("text").alias("description"),
        F.col("attendance").cast("string").alias("estimated_attendance"), F.lit("u").alias("event_url"),
    )
    # one row per show, as the files would list it
    full = src.last_wins(full, ["event_name", "began_local", "address"], [F.col("estimated_end_local").asc_nulls_first(), F.col("estimated_attendance").cast("long").desc()])
    put(full.filter("crowd_id % 2 = 0").drop("crowd_id"), f"{root}/berlin_events_1")
    put(full.filter("crowd_id % 2 = 1").drop("crowd_id"), f"{root}/berlin_events_2", header=False)
    gaz = n.venues.select(F.concat(F.lit("arena "), F.lower("venue_key")).alias("alias"), "venue_key")
    e = src.locate_events(src.read_events(n.spark, root), gaz)
    return e.groupBy("event_name", "start", "end", "attendance", "venue_key").agg(F.count(F.lit(1)).alias("n"))


@register("s11_energy_file", "day:d line kwh:f", ctes="energy", sql="SELECT day, line, mwh*1000 AS kwh FROM energy")
def _(n):
    path, lines = shared_folder(n.spark, "energy"), [f"L{i}" for i in range(5)]
    put(n.energy.groupBy(us(F.col("day").cast("timestamp")).alias("date")).pivot("line", lines).agg(F.first("mwh")), path)
    return src.read_daily_wide(n.spark, path).withColumn("kwh", F.col("mwh") * 1000)


# -- S12-S14, S22 -----------------------------------------------------------------------------------
@register("s12_network_files", "a b transfer:b lines:i", ctes="stations edges", sql="""
WITH n AS (SELECT station_key, CASE WHEN k IN (3,20) THEN 'NATION_3' ELSE 'NATION_'||k END AS name FROM stations), c AS (SELECT DISTINCT least(src,dst) a, greatest(src,dst) b FROM edges)
SELECT a, b, false AS "transfer", (SELECT count(DISTINCT line) FROM edges e WHERE least(e.src,e.dst)=c.a AND greatest(e.src,e.dst)=c.b) AS "lines" FROM c
UNION ALL SELECT x.station_key, y.station_key, true, 0 FROM n x JOIN n y ON x.name=y.name AND x.station_key<y.station_key WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.a=x.station_key AND c.b=y.station_key)""")
def _(n):
    """Stations, connections and lines from their files; stations of one name get a transfer edge."""
    root = shared_folder(n.spark, "network")
    k = F.substring("station_key", 2, 2).cast("int")
    put(n.stations.select(F.col("station_key").alias("station_id"), F.concat(F.lit("NATION_"), F.when(k == 20, 3).otherwise(k).cast("string")).alias("station_name"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), F.concat_ws(",", "lines").alias("u_bahn_lines")), f"{root}/stations")
    put(n.edges.select(F.col("src").alias("station_id_1"), F.col("dst").alias("station_id_2")), f"{root}/connections")
    put(n.line_stops.select(F.col("line").alias("line_id"), F.concat(F.lit("Line "), "line").alias("line_name")).distinct(), f"{root}/lines")
    st, lines = src.read_stations(n.spark, f"{root}/stations"), src.read_lines(n.spark, f"{root}/lines")
    e = src.network_edges(st, src.read_connections(n.spark, f"{root}/connections"))
    on = n.edges.join(lines, F.col("line") == F.col("line_id")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "line_id").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("lines"))
    return e.join(on, ["a", "b"], "left").withColumn("lines", F.when(F.col("transfer"), 0).otherwise(F.col("lines")))


@register("s13_venue_overrides", "venue_key lat:f lon:f", ctes="venues", sql="SELECT venue_key, CASE WHEN venue_key='V1' THEN 52.5 ELSE lat END lat, lon FROM venues UNION ALL SELECT 'X'||n_regionkey, 50.0+n_regionkey, 10.0 FROM (SELECT DISTINCT n_regionkey FROM nation)")
def _(n):
    """A side file moves one venue and adds others."""
    path = shared_folder(n.spark, "venues")
    moved = n.venues.filter("venue_key = 'V1'").select(F.col("venue_key").alias("name"), F.lit(52.5).alias("lat"), "lon")
    more = n.raw("nation").select(F.concat(F.lit("X"), F.col("n_regionkey").cast("string")).alias("name"), (F.lit(50.0) + F.col("n_regionkey")).alias("lat"), F.lit(10.0).alias("lon")).distinct()
    put(moved.unionByName(more), path)
    extra = src.read_csv_any(n.spark, path).select(F.col("name").alias("venue_key"), src.number("lat").alias("lat"), src.number("lon").alias("lon"))
    return src.merge_side_table(n.venues, extra, "venue_key")


@register("s14_timetable_file", "line trips:i stops:i last:i", ctes="stop_times", sql="""
SELECT line, count(DISTINCT trip_id) trips, count(*) stops, max(stop_sequence*3600+(stop_id%60)*60) AS "last" FROM stop_times GROUP BY 1""")
def _(n):
    """Route stops with hours beyond 24; rows without a trip are dropped."""
    path = shared_folder(n.spark, "timetable")
    s = n.stop_times.select("line", F.lit("x").alias("mode"), "direction_id", "trip_id", "stop_sequence", F.format_string("%02d:%02d:00", "stop_sequence", (F.col("stop_id") % 60).cast("int")).alias("departure_time"), F.col("stop_id").alias("station_key"))
    put(s.unionByName(s.filter("stop_sequence = 1").withColumn("trip_id", F.lit(None).cast("long"))), path, sep=";")
    tt = src.read_timetable(n.spark, path)
    return tt.groupBy("line").agg(F.count_distinct("trip_id").alias("trips"), F.count(F.lit(1)).alias("stops"), F.max("seconds").alias("last"))


@register("s22_log_lines", "kind rating n:i", sql="SELECT role AS kind, CASE WHEN turn%2=0 THEN 'up' ELSE 'down' END rating, 2*count(*) n FROM conversations GROUP BY 1,2")
def _(n):
    """A feedback log appended twice, with broken lines between."""
    path = shared_folder(n.spark, "log")
    rows = n.raw("conversations").select(F.lit("2024-01-01T00:00:00").alias("time"), F.col("role").alias("kind"), F.when(F.col("turn") % 2 == 0, "up").otherwise("down").alias("rating"), F.col("text").alias("comment"))
    src.append_log(rows, path)
    n.raw("conversations").select(F.concat(F.lit('{"kind": "'), F.col("role"))).write.mode("append").text(path)
    src.append_log(rows, path)
    return src.read_log(n.spark, path, src.FEEDBACK_SCHEMA).groupBy("kind", "rating").agg(F.count(F.lit(1)).alias("n"))


# -- S18 ----------------------------------------------------------------------------------------------
@register("s18_validate_weather", "file rule severity n:i", ctes="weather", sql="""
WITH c AS (SELECT 'w'||day(slot)%3 AS file, count_if(minute(slot)=15 AND hour(slot)=7) a, count_if(hour(slot)=8) b, count_if(hour(slot)=9) c, count_if(hour(slot)=10) d FROM weather GROUP BY 1)
SELECT * FROM (SELECT file, unnest(['unparsable timestamp','off grid','no temperature','negative precipitation']) AS "rule", unnest(['error','warning','warning','error']) severity, unnest([a,b,c,d]) n FROM c) WHERE n>0""")
def _(n):
    h = F.hour("slot")
    ts = F.when((F.minute("slot") == 15) & (h == 7), "soon").when(h == 8, (F.col("slot") + t.minutes(1)).cast("string")).otherwise(F.col("slot").cast("string"))
    w = n.weather.select(F.concat(F.lit("w"), (F.dayofmonth("slot") % 3).cast("string")).alias("file"), ts.alias("ts"), F.when(h == 9, "warm").otherwise(F.col("temp").cast("string")).alias("temp"), F.when(h == 10, "-0.5").otherwise(F.col("prcp").cast("string")).alias("prcp"))
    return q.validate_weather(w, n.clock)


@register("s18_validate_energy", "file rule severity n:i", ctes="energy", sql="""
WITH c AS (SELECT 'e' AS file, count_if(day(day)=3) a, count_if(line='L4') b, count_if(day(day)=5) c, count_if(day(day)=7) d FROM energy)
SELECT * FROM (SELECT file, unnest(['unparsable date','unknown line','empty or non-numeric','negative']) AS "rule", unnest(['error','error','warning','warning']) severity, unnest([a,b,c,d]) n FROM c) WHERE n>0""")
def _(n):
    d = F.dayofmonth("day")
    rows = n.energy.select(F.lit("e").alias("file"), F.when(d == 3, "some day").otherwise(F.col("day").cast("string")).alias("day"), "line", F.when(d == 5, "").when(d == 7, "-1").otherwise(F.col("mwh").cast("string")).alias("value"))
    return q.validate_energy(rows, n.line_stops.filter("line <> 'L4'").select("line"))


@register("s18_validate_closures", "file rule severity n:i", ctes="closures", sql="""
WITH c AS (SELECT 'c'||closure_id%2 AS file, count_if(closure_id%7=0) a, count_if(closure_id%5=0) b, count_if(closure_id%3=0) c FROM closures GROUP BY 1)
SELECT * FROM (SELECT file, unnest(['unparsable start','unparsable duration','not understood']) AS "rule", unnest(['error','error','warning']) severity, unnest([a,b,c]) n FROM c) WHERE n>0""")
def _(n):
    i = F.col("closure_id")
    rows = n.closures.select(
        F.concat(F.lit("c"), (i % 2).cast("string")).alias("file"), F.when(i % 7 == 0, "tomorrow").otherwise(F.col("start").cast("string")).alias("when"), F.when(i % 5 == 0, "long").otherwise("1h30min").alias("duration"),
        F.when(i % 3 == 0, F.lit("Something happens somewhere")).otherwise(F.col("description")).alias("description"))
    st = n.stations.withColumn("name", F.concat(F.lit("NATION_"), F.substring("station_key", 2, 2).cast("int").cast("string")))
    return q.validate_closure_rows(rows, st, n.line_stops)


# -- S19 ----------------------------------------------------------------------------------------------
DELIVERY = "SELECT station_key, slot, day, reading+1 AS reading FROM fd WHERE day>=DATE '2024-01-10' AND tod%2=0"
cte("s19_old", "fd", "SELECT station_key, slot, day, reading FROM fd WHERE day<=DATE '2024-01-15'")
cte("s19_new", "fd", DELIVERY)


@register("s19_ingest_report", "attempt accepted:b committed:b version:i errors:i day:d rows_before:i rows_after:i added:i replaced:i changed:i sum_before:i sum_after:i", ctes="s19_old s19_new", sql="""
WITH r AS (SELECT coalesce(n.day, o.day) AS day, count(o.slot) rows_before, count(*) rows_after, count_if(o.slot IS NULL) added, count(CASE WHEN n.slot IS NOT NULL THEN o.slot END) replaced, sum(o.reading) sum_before, sum(coalesce(n.reading, o.reading)) sum_after
FROM s19_old o FULL JOIN s19_new n ON n.station_key=o.station_key AND n.slot=o.slot GROUP BY 1 HAVING count(n.slot)>0)
SELECT 'broken file' attempt, false accepted, false committed, 1 AS "version", (SELECT count(*) FROM s19_new WHERE station_key='S07') errors, CAST(NULL AS DATE) AS day, NULL rows_before, NULL rows_after, NULL added, NULL replaced, NULL changed, NULL sum_before, NULL sum_after
UNION ALL SELECT 'dry run', true, false, 1, 0, day, rows_before, rows_after, added, replaced, replaced, sum_before, sum_after FROM r
UNION ALL SELECT 'delivery', true, true, 2, 0, day, rows_before, rows_after, added, replaced, replaced, sum_before, sum_after FROM r""")
def _(n):
    """A broken delivery, a dry run and the delivery itself against a table that holds the first half of the month."""
    table, new = ingested(n)
    bad, good = new(True), new(False)
    checks = lambda rows: q.validate_readings(rows.select(F.col("source_file").alias("file"), "station_key", F.col("slot").alias("ts"), F.col("reading").alias("value")), n.stations, n.clock)
    typed = lambda rows: rows.select("station_key", F.col("slot").cast("timestamp_ntz").alias("slot"), t.service_day(F.col("slot").cast("timestamp_ntz"), n.clock).alias("day"), F.col("reading").try_cast("long").alias("reading"), "source_rank", "source_file")
    out = None
    for attempt, rows, dry in (("broken file", bad, False), ("dry run", good, True), ("delivery", good, False)):
        r = ing.ingest(table, typed(rows), checks(rows), "reading", dry).withColumn("attempt", F.lit(attempt))
        out = r if out is None else out.unionByName(r)
    return out


def ingested(n):
    """A versioned table with the first half of the month, and the delivery's files in two dialects, whole or with negative readings."""
    table = ing.VersionedTable(n.spark, shared_folder(n.spark, "table"), "station_key string, slot timestamp_ntz, day date, reading long", ["station_key", "slot"])
    first = n.flow_days.filter("day <= DATE'2024-01-15'").select("station_key", "slot", "day", "reading")
    table.commit(table.version(), (table.stage(first, 1),))

    def new(broken: bool):
        root = shared_folder(n.spark, "delivery")
        c = n.flow_days.filter("day >= DATE'2024-01-10' AND tod % 2 = 0")
        value = F.when(F.lit(broken) & (F.col("station_key") == "S07"), -5).otherwise(F.col("reading") + 1)
        c = c.select("station_key", F.col("slot").cast("string").alias("slot"), value.alias("reading"))
        put(c.filter("station_key < 'S12'"), f"{root}/flows_a")
        put(c.filter("station_key >= 'S12'").select("slot", "reading", "station_key"), f"{root}/flows_b", sep="\t")
        return src.read_csv_any(n.spark, root)

    return table, new


@register("s19_versions", "version:i n_days:i rows:i total:i", ctes="s19_old s19_new", sql="""
WITH u AS (SELECT station_key, slot, day, reading FROM s19_new UNION ALL SELECT * FROM s19_old o WHERE NOT EXISTS (SELECT 1 FROM s19_new n WHERE n.station_key=o.station_key AND n.slot=o.slot))
SELECT 1 AS "version", count(DISTINCT day) n_days, count(*) AS "rows", sum(reading) total FROM s19_old UNION ALL SELECT 2, count(DISTINCT day), count(*), sum(reading) FROM u""")
def _(n):
    """The table as it was and as it is after the delivery: both versions stay readable."""
    table, new = ingested(n)
    seen = table.version()
    rows = new(False)
    typed = rows.select("station_key", F.col("slot").cast("timestamp_ntz").alias("slot"), t.service_day(F.col("slot").cast("timestamp_ntz"), n.clock).alias("day"), F.col("reading").cast("long").alias("reading"), "source_rank", "source_file")
    now = table.commit(seen, (*seen.batches, table.stage(typed, 2)))
    out = None
    for v in (seen, now):
        r = table.read(v).agg(F.lit(v.number).alias("version"), F.count_distinct("day").alias("n_days"), F.count(F.lit(1)).alias("rows"), F.sum("reading").alias("total"))
        out = r if out is None else out.unionByName(r)
    return out
