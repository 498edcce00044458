"""One graph of several modes: timetable services matched to the stops of an existing bus graph.

Stations are resolved once per station, never per stop time; every step is a join or an aggregation over stop times or edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions import text as tx
from flowspark.functions.geo import haversine_km
from flowspark.operators.joins import close_names
from flowspark.operators.timetable import STATION_WALK_S, timetable_edges

RAIL_KMH, RAIL_STOP_S = 30.0, 30


def services(times: DataFrame, base_lines: DataFrame, night: str = "^N[0-9]") -> DataFrame:
    """Timetable rows (line, mode, ...) to add to a bus graph with ``base_lines`` (line).

    All rail services; buses of lines the graph lacks, but for night lines, since the graph knows no time of day; buses that run under a rail
    line's name become a line of their own ("U6 SEV", mode replacement).
    """
    bus = F.col("mode") == "bus"
    rail = times.filter(~bus).select("line").distinct().withColumn("_rail", F.lit(True))
    known = base_lines.select("line").distinct().withColumn("_base", F.lit(True))
    x = times.join(rail, "line", "left").join(known, "line", "left")
    instead = bus & F.col("_rail").isNotNull()
    keep = ~bus | instead | (F.col("_base").isNull() & ~F.col("line").rlike(night))
    x = x.filter(keep).withColumns({"mode": F.when(instead, "replacement").otherwise(F.col("mode")), "line": F.when(instead, F.concat("line", F.lit(" SEV"))).otherwise(F.col("line"))})
    return x.drop("_rail", "_base")


def match_stops(stations: DataFrame, nodes: DataFrame, cutoff: float = 0.92, same_first: bool = True) -> DataFrame:
    """(station_key, node, how) of every station (station_key, stop_name) among the ``nodes`` (node, name) of a graph.

    Cascade: the same key; the same key without a line kind, if one node has it; one close key (``block_ratio`` of at least ``cutoff``, and the same
    first letter unless told otherwise) that one node has; else a new node, shared by the stations of one key.
    """
    s = stations.select("station_key", tx.display_name("stop_name").alias("name")).select("station_key", tx.stop_key("name").alias("sk"), tx.unprefixed_key("name").alias("uk"))
    g = nodes.select("node", tx.unprefixed_key("name").alias("uk"))
    single = g.groupBy("uk").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    exact = s.join(nodes.select(F.col("node").alias("sk")), "sk").select("station_key", F.col("sk").alias("node"), F.lit(1).alias("step"))
    prefix = s.join(single.filter("n = 1"), "uk").select("station_key", "node", F.lit(2).alias("step"))
    near = close_names(s.select(F.col("uk").alias("lk")), single.select(F.col("uk").alias("rk")), cutoff, "blocks")
    if same_first:
        near = near.filter(F.substring("lk", 1, 1) == F.substring("rk", 1, 1))
    one = near.groupBy("lk").agg(F.min("rk").alias("rk"), F.count(F.lit(1)).alias("k")).filter("k = 1")
    close = s.join(one, F.col("uk") == F.col("lk")).join(single.filter("n = 1").select(F.col("uk").alias("rk"), "node"), "rk").select("station_key", "node", F.lit(3).alias("step"))
    new = s.select("station_key", F.col("sk").alias("node"), F.lit(4).alias("step"))
    best = exact.unionByName(prefix).unionByName(close).unionByName(new).groupBy("station_key").agg(F.min(F.struct("step", "node")).alias("b"))
    how = F.element_at(F.array(*map(F.lit, ("exact", "prefix", "fuzzy", "new"))), F.col("b.step"))
    return best.select("station_key", F.col("b.node").alias("node"), how.alias("how"))


def ride_edges(times: DataFrame, match: DataFrame) -> DataFrame:
    """Median travel time per (line, mode, a, b) between matched nodes; ``times`` has trip_id, stop_sequence, station_key, t, line, mode."""
    x = times.join(match.select("station_key", "node"), "station_key").select("trip_id", "stop_sequence", "t", F.col("node").alias("stop_id"), F.concat_ws("|", "line", "mode").alias("line"))
    e = timetable_edges(x)
    return e.select(F.substring_index("line", "|", 1).alias("line"), F.substring_index("line", "|", -1).alias("mode"), "a", "b", "travel_time", F.lit("timetable").alias("origin"))


def fill_edges(connections: DataFrame, stations: DataFrame, match: DataFrame, rides: DataFrame, mode: str = "subway", kmh: float = RAIL_KMH) -> DataFrame:
    """Edges of the network's own connection list (a, b as station keys) that the timetable lacks, timed by their length.

    A connection between two nodes that the mode serves already is left out: it skips a stop the timetable has. The edge exists once for each line both
    stations (station_key, lat, lon, lines) share, or for the line "?" if they share none.
    """
    st = stations.join(match.select("station_key", "node"), "station_key").select("station_key", "node", "lat", "lon", "lines")
    side = lambda p: st.select(*[F.col(c).alias(f"{p}_{c}") for c in st.columns])
    c = connections.select("a", "b").join(side("x"), F.col("a") == F.col("x_station_key")).join(side("y"), F.col("b") == F.col("y_station_key")).filter("x_node <> y_node")
    served = rides.filter(F.col("mode") == mode).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    both = lambda p: served.select(F.col("node").alias(f"{p}_node"), F.lit(True).alias(f"{p}_served"))
    c = c.join(both("x"), "x_node", "left").join(both("y"), "y_node", "left").filter("x_served IS NULL OR y_served IS NULL")
    common = F.array_sort(F.array_intersect("x_lines", "y_lines"))
    seconds = F.floor(RAIL_STOP_S + haversine_km("x_lat", "x_lon", "y_lat", "y_lon") / kmh * 3600).cast("long")
    e = c.select(F.explode(F.when(F.size(common) > 0, common).otherwise(F.array(F.lit("?")))).alias("line"), F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"), seconds.alias("travel_time"))
    return e.groupBy("line", "a", "b").agg(F.min("travel_time").alias("travel_time")).select("line", F.lit(mode).alias("mode"), "a", "b", "travel_time", F.lit("connections").alias("origin"))


def station_walk_edges(match: DataFrame, nodes: DataFrame) -> DataFrame:
    """Walks between a matched node and the other nodes (node, station) of its station."""
    st = nodes.select("node", "station").filter("station IS NOT NULL")
    rail = match.select("node").distinct().join(st, "node")
    j = rail.select(F.col("node").alias("x"), "station").join(st.select(F.col("node").alias("y"), "station"), "station").filter("x <> y")
    return j.select(F.lit("walk").alias("line"), F.lit("walk").alias("mode"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(STATION_WALK_S).cast("long").alias("travel_time"), F.lit("station").alias("origin")).distinct()


def build(times: DataFrame, stations: DataFrame, connections: DataFrame, nodes: DataFrame, base_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole graph: edges (line, mode, a, b, travel_time, origin), nodes with the lines and modes that serve them, and how stations were matched.

    ``times`` are the services to add, ``stations`` (station_key, stop_name, lat, lon, lines) their stations, ``nodes`` (node, name, station) and
    ``base_edges`` (line, mode, a, b, travel_time) the bus graph. A line whose name the bus graph uses for another mode gets its mode behind the name.
    """
    match = match_stops(stations, nodes)
    rides = ride_edges(times, match)
    taken = base_edges.select("line", F.col("mode").alias("_other")).distinct()
    clash = F.col("_other").isNotNull() & (F.col("_other") != F.col("mode"))
    rides = rides.join(taken.groupBy("line").agg(F.min("_other").alias("_other")), "line", "left").withColumn("line", F.when(clash, F.concat("line", F.lit(" ("), "mode", F.lit(")"))).otherwise(F.col("line"))).drop("_other")
    edges = base_edges.select("line", "mode", "a", "b", "travel_time", F.lit("bus graph").alias("origin")).unionByName(rides)
    edges = edges.unionByName(fill_edges(connections, stations, match, rides)).unionByName(station_walk_edges(match, nodes))
    served = edges.filter("mode <> 'walk'").select(F.explode(F.array("a", "b")).alias("node"), "line", "mode").groupBy("node").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.array_sort(F.collect_set("mode")).alias("modes"))
    named = match.join(stations.select("station_key", tx.display_name("stop_name").alias("name"), "lat", "lon"), "station_key").groupBy("node").agg(F.min("name").alias("_name"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    all_nodes = nodes.select("node", "name").join(named, "node", "full_outer").select("node", F.coalesce("name", "_name").alias("name"), "lat", "lon")
    return edges, all_nodes.join(served, "node", "left"), match
