"""Timetable operators over stop times (trip_id, stop_sequence, stop_id, t seconds, line, direction_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions import text as tx
from flowspark.functions.geo import haversine_km
from flowspark.functions.lineage import cut, spread
from flowspark.operators.joins import mentions, within_km

MIN_EDGE_S, DEFAULT_EDGE_S, STATION_WALK_S = 30, 120, 180
WALK_MPS, WALK_EXTRA_S = 1.2, 60


def segments(stop_times: DataFrame) -> DataFrame:
    """Consecutive stops of every trip, ends in key order, with the travel time when it is not negative."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    s = stop_times.withColumn("nxt", F.lead("stop_id").over(w)).withColumn("tn", F.lead("t").over(w))
    s = s.filter("nxt IS NOT NULL AND nxt <> stop_id")
    dt = F.when(F.col("tn") >= F.col("t"), F.col("tn") - F.col("t"))
    return s.select("line", "trip_id", "stop_sequence", F.least("stop_id", "nxt").alias("a"), F.greatest("stop_id", "nxt").alias("b"), dt.alias("dt"))


def timetable_edges(stop_times: DataFrame) -> DataFrame:
    """Median travel time per (line, a, b), never below the minimum; a default where no time is usable."""
    g = spread(segments(stop_times), stop_times.count(), "line", "a", "b").groupBy("line", "a", "b").agg(F.median("dt").alias("m"), F.count(F.lit(1)).alias("runs"))
    tt = F.greatest(F.lit(MIN_EDGE_S), F.coalesce(F.floor("m"), F.lit(DEFAULT_EDGE_S))).cast("long")
    return g.select("line", "a", "b", tt.alias("travel_time"), "runs")


def first_edges(stop_times: DataFrame) -> DataFrame:
    """Line graph in which the first occurrence of a stop pair decides its time."""
    s = spread(segments(stop_times), stop_times.count(), "line", "a", "b")
    g = s.groupBy("line", "a", "b").agg(F.min_by(F.struct("dt"), F.struct("trip_id", "stop_sequence")).alias("x"))
    return g.select("line", "a", "b", F.greatest(F.lit(MIN_EDGE_S), F.coalesce("x.dt", F.lit(DEFAULT_EDGE_S))).cast("long").alias("travel_time"))


def station_walks(stops: DataFrame) -> DataFrame:
    """Walk edges between the stops of one station (stop_id, station)."""
    a, b = stops.select("station", F.col("stop_id").alias("a")), stops.select("station", F.col("stop_id").alias("b"))
    return a.join(b, "station").filter("a < b").select("a", "b", F.lit(STATION_WALK_S).cast("long").alias("travel_time"))


def proximity_walks(stops: DataFrame, radius_km: float, edges: DataFrame | None = None) -> DataFrame:
    """Walk edges between stops within the radius that have no edge yet.

    The ends of those edges that are short enough to matter travel with the stop, so the many pairs are never shuffled.
    """
    left, right = stops.select(F.col("stop_id").alias("a"), "lat", "lon"), stops.select(F.col("stop_id").alias("b"), "lat", "lon")
    new = F.col("a") < F.col("b")
    if edges is not None:
        short = edges.select("a", "b").join(left, "a").join(right.withColumnsRenamed({"lat": "rlat", "lon": "rlon"}), "b")
        short = short.filter(haversine_km("lat", "lon", "rlat", "rlon") <= radius_km + 1e-6).groupBy("a").agg(F.collect_set("b").alias("_have"))
        left, new = cut(left.join(short, "a", "left")), new & ~F.coalesce(F.array_contains("_have", F.col("b")), F.lit(False))
    j = within_km(left, right, radius_km, new)
    return j.select("a", "b", F.floor(F.col("km") * 1000 / WALK_MPS + WALK_EXTRA_S).cast("long").alias("travel_time"), F.floor(F.col("km") * 1000).cast("long").alias("distance_m"))


def multimodal_edges(stop_times: DataFrame, stops: DataFrame, radius_km: float) -> DataFrame:
    """Ride edges plus walk edges as one table (line, mode, a, b, travel_time)."""
    r = timetable_edges(stop_times)
    ride = r.select("line", tx.line_mode("line").alias("mode"), "a", "b", "travel_time")
    walk = proximity_walks(stops, radius_km, r).select(F.lit("walk").alias("line"), F.lit("walk").alias("mode"), "a", "b", "travel_time")
    return ride.unionByName(walk)


def network_stats(edges: DataFrame) -> DataFrame:
    """Edges, lines and stops per mode."""
    e = edges.groupBy("mode").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("line").alias("lines"))
    s = edges.select("mode", F.explode(F.array("a", "b")).alias("stop")).distinct().groupBy("mode").agg(F.count(F.lit(1)).alias("stops"))
    return e.join(s, "mode")


def stop_routes(stop_times: DataFrame) -> DataFrame:
    return stop_times.select("stop_id", "line").distinct()


def match_names(requests: DataFrame, stops: DataFrame) -> DataFrame:
    """(request, stop_id): names that begin with the request, else names that contain it.

    Containment is an equi-join on the substrings whose lengths some request has.
    """
    r = requests.select("request", tx.compact_key("request").alias("rk")).distinct().filter("rk <> ''")
    s = stops.select("stop_id", tx.compact_key("stop_name").alias("sk"))
    lens = r.agg(F.collect_set(F.length("rk"))).scalar()
    g = s.withColumn("l", F.explode(lens)).filter(F.length("sk") >= F.col("l"))
    g = g.withColumn("p", F.explode(F.sequence(F.lit(1), F.length("sk") - F.col("l") + 1)))
    g = g.select("stop_id", "p", F.substring(F.col("sk"), F.col("p"), F.col("l")).alias("rk"))
    j = r.join(g, "rk").groupBy("request", "stop_id").agg(F.min("p").alias("p"))
    j = j.withColumn("best", F.min("p").over(Window.partitionBy("request")))
    return j.filter("best > 1 OR p = 1").select("request", "stop_id")


def lines_at(requests: DataFrame, stops: DataFrame, routes: DataFrame, rail_lines: DataFrame | None = None) -> DataFrame:
    """Lines by mode at every requested station; buses under rail line names are set apart."""
    j = match_names(requests, stops).join(routes, "stop_id").withColumn("mode", tx.line_mode("line"))
    if rail_lines is not None:
        j = j.join(rail_lines.select("line", F.lit(True).alias("rail")), "line", "left")
        j = j.withColumn("mode", F.when(F.col("rail") & (F.col("mode") == "bus"), "replacement").otherwise(F.col("mode")))
    return j.groupBy("request", "mode").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.countDistinct("stop_id").alias("stops"))


def line_stops(stop_times: DataFrame) -> DataFrame:
    """Stops of the longest trip of every line (direction 0 first, then the smaller trip id)."""
    n = stop_times.groupBy("line", "trip_id", "direction_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("line").orderBy(F.col("n").desc(), "direction_id", "trip_id")
    pick = n.withColumn("r", F.row_number().over(w)).filter("r = 1").select("line", "trip_id")
    return stop_times.join(pick, ["line", "trip_id"]).select("line", "trip_id", "stop_sequence", "stop_id", "t")


def line_list(stop_times: DataFrame) -> DataFrame:
    """Largest trip size per line."""
    n = stop_times.groupBy("line", "trip_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("line").agg(F.max("n").alias("stops"), F.count(F.lit(1)).alias("trips"))


def direct_lines(od: DataFrame, routes: DataFrame) -> DataFrame:
    """Lines serving both ends of each (origin, destination); a stop has one row with all its lines, so a pair is never copied per line."""
    at = routes.toDF("stop", "line").groupBy("stop").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    od = cut(od.select("origin", "destination").distinct())
    rows = od.count()
    side = lambda end, name: spread(at.toDF(end, name), rows, end)
    j = spread(spread(od, rows, "origin").join(side("origin", "_a"), "origin"), rows, "destination").join(side("destination", "_b"), "destination")
    return j.select("origin", "destination", F.array_sort(F.array_intersect("_a", "_b")).alias("lines")).filter(F.size("lines") > 0)


def stations_in_text(texts: DataFrame, aliases: DataFrame, key: str, limit: int | None = 2, text_col: str = "text") -> DataFrame:
    """Station aliases in order of mention; an alias inside a longer found one is skipped."""
    m = mentions(texts, aliases, text_col).groupBy(key, "alias").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy(key)
    longer = F.collect_set("alias").over(w)
    m = m.withColumn("_all", longer).filter(~F.exists("_all", lambda a: (F.length(a) > F.length("alias")) & F.contains(a, F.col("alias")))).drop("_all")
    m = m.withColumn("rank", F.row_number().over(w.orderBy("pos", "alias")))
    return m.filter(F.col("rank") <= limit) if limit else m
