"""The multimodal build on the bound tables: stops of a bus graph, timetable services, a connection list."""

from pyspark.sql import functions as F

from flowspark.catalog.ctes import cte, hav
from flowspark.catalog.records import trips
from flowspark.catalog.registry import register
from flowspark.functions import text as tx
from flowspark.operators import multimodal as mm

# stops of remainder 0-2 modulo 4 are in the bus graph; the timetable spells them alike, with another line kind, with a letter less
cte("mm_st", "stops", """SELECT stop_id, lat, lon, h, stop_id%4 k, CASE WHEN stop_id%4=1 THEN 'suhalt'||h ELSE 'halt'||h END AS base,
CASE stop_id%4 WHEN 0 THEN 'halt'||h WHEN 1 THEN 'suhalt'||h WHEN 2 THEN 'halt'||h ELSE 'halt'||h END AS node, CASE stop_id%4 WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' WHEN 2 THEN 'fuzzy' ELSE 'new' END AS how FROM (SELECT *, substr(md5(CAST(stop_id AS VARCHAR)),1,20) h FROM stops)""")
cte("mm_times", "trips", """SELECT * FROM (SELECT CASE WHEN m='bus' AND line LIKE 'U%' THEN line||' SEV' ELSE line END AS line, CASE WHEN m='bus' AND line LIKE 'U%' THEN 'replacement' ELSE m END AS "mode", trip_id, stop_sequence, stop_id, t, line AS own FROM (
SELECT *, CASE WHEN line LIKE 'U%' AND trip_id%50<>0 THEN 'subway' WHEN line LIKE 'M%' THEN 'tram' ELSE 'bus' END AS m FROM trips)) WHERE "mode"<>'bus' OR own NOT IN ('X1','X2')""")
cte("mm_rides", "mm_times mm_st", """SELECT line, "mode", a, b, CAST(greatest(30, coalesce(floor(median(dt)),120)) AS BIGINT) AS travel_time FROM (SELECT line, "mode", least(node,nxt) a, greatest(node,nxt) b, CASE WHEN tn>=t THEN tn-t END AS dt FROM (
SELECT line, "mode", node, t, lead(node) OVER w AS nxt, lead(t) OVER w AS tn FROM mm_times JOIN mm_st USING(stop_id) WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)) WHERE nxt IS NOT NULL AND nxt<>node) GROUP BY 1,2,3,4""")
cte("mm_fill", "mm_st mm_rides", f"""SELECT 'U1' AS line, 'subway' AS "mode", least(x.node,y.node) a, greatest(x.node,y.node) b, CAST(floor(30+({hav('x','y')})/30.0*3600) AS BIGINT) AS travel_time FROM mm_st x JOIN mm_st y ON y.stop_id=x.stop_id+1 AND x.stop_id%10=0
WHERE x.node NOT IN (SELECT a FROM mm_rides WHERE "mode"='subway' UNION SELECT b FROM mm_rides WHERE "mode"='subway') OR y.node NOT IN (SELECT a FROM mm_rides WHERE "mode"='subway' UNION SELECT b FROM mm_rides WHERE "mode"='subway')""")
cte("mm_base", "mm_st", """SELECT 'X1' AS line, 'bus' AS "mode", least(x.base,y.base) a, greatest(x.base,y.base) b, 90 AS travel_time FROM mm_st x JOIN mm_st y ON y.stop_id=x.stop_id+4 AND x.k=0""")
cte("mm_walk", "mm_st", """SELECT DISTINCT 'walk' AS line, 'walk' AS "mode", least(x.base,y.base) a, greatest(x.base,y.base) b, 180 AS travel_time FROM mm_st x JOIN mm_st y ON x.stop_id//5=y.stop_id//5 AND x.k<3 AND y.k<3 AND x.base<>y.base""")
cte("mm_edges", "mm_base mm_rides mm_fill mm_walk", "SELECT *, 'bus graph' AS origin FROM mm_base UNION ALL SELECT *, 'timetable' FROM mm_rides UNION ALL SELECT *, 'connections' FROM mm_fill UNION ALL SELECT *, 'station' FROM mm_walk")


def inputs(n):
    """Services, stations, connections and the bus graph."""
    h, k = F.substring(F.md5(F.col("stop_id").cast("string").cast("binary")), 1, 20), F.col("stop_id") % 4
    t = trips(n).withColumn("mode", tx.line_mode("line"))
    t = t.withColumn("mode", F.when(F.col("line").startswith("U") & (F.col("trip_id") % 50 == 0), "bus").otherwise(F.col("mode"))).withColumnRenamed("stop_id", "station_key")
    base_lines = n.spark.createDataFrame([("X1",), ("X2",)], "line string")
    times = mm.services(t, base_lines)
    short = F.substring(h, 1, 19)
    name = F.when(k == 0, F.concat(F.lit("Halt "), h)).when(k == 1, F.concat(F.lit("U Halt "), h)).when(k == 2, F.concat(F.lit("Halt "), short, F.lit(" Bhf (Berlin)"))).otherwise(F.concat(F.lit("Halt "), h, F.lit(" [neu]")))
    stations = n.stops.select(F.col("stop_id").alias("station_key"), name.alias("stop_name"), "lat", "lon", F.array(F.lit("U1")).alias("lines"))
    base = F.when(k == 1, F.concat(F.lit("S+U Halt "), h)).otherwise(F.concat(F.lit("Halt "), h))
    nodes = n.stops.filter(k < 3).select("stop_id", tx.stop_key(base).alias("node"), base.alias("name"), F.floor(F.col("stop_id") / 5).alias("station"))
    con = n.stops.filter("stop_id % 10 = 0").select(F.col("stop_id").alias("a"), (F.col("stop_id") + 1).alias("b"))
    at = nodes.filter("stop_id % 4 = 0").select("stop_id", "node")
    nxt = at.select((F.col("stop_id") - 4).alias("stop_id"), F.col("node").alias("other"))
    base_edges = at.join(nxt, "stop_id").select(F.lit("X1").alias("line"), F.lit("bus").alias("mode"), F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), F.lit(90).cast("long").alias("travel_time"))
    return times, stations, con, nodes.drop("stop_id"), base_edges


@register("n9_station_matches", "station_key:i node how", ctes="mm_st", sql="SELECT stop_id AS station_key, node, how FROM mm_st")
def _(n):
    _, stations, _, nodes, _ = inputs(n)
    return mm.match_stops(stations, nodes)


@register("n9_multimodal_build", "line mode a b travel_time:i origin", ctes="mm_edges", sql="SELECT * FROM mm_edges")
def _(n):
    """The whole edge table."""
    return mm.build(*inputs(n))[0]


@register("n9_served_nodes", "node name lines:a modes:a", ctes="mm_edges mm_st", sql="""
WITH s AS (SELECT node, list_sort(list(DISTINCT line)) AS "lines", list_sort(list(DISTINCT "mode")) modes FROM (SELECT a AS node, line, "mode" FROM mm_edges UNION ALL SELECT b, line, "mode" FROM mm_edges) WHERE "mode"<>'walk' GROUP BY 1),
a AS (SELECT DISTINCT node, CASE k WHEN 1 THEN 'S+U Halt ' ELSE 'Halt ' END||h AS name FROM mm_st)
SELECT a.node, a.name, coalesce(s."lines", []) AS "lines", coalesce(s.modes, []) modes FROM a LEFT JOIN s ON s.node=a.node""")
def _(n):
    """Nodes with the lines and modes that serve them."""
    return mm.build(*inputs(n))[1]
