"""Network analytics: the station graph under demand that the trade tables supply."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowspark.catalog.ctes import cte, hav, station_of
from flowspark.catalog.model import risk
from flowspark.catalog.registry import register
from flowspark.functions import time as t
from flowspark.functions.geo import haversine_km
from flowspark.functions.lineage import cut
from flowspark.operators import dependencies as dp
from flowspark.operators import graph as g
from flowspark.operators import stats as st

cte("e2", "edges", "SELECT DISTINCT src, dst FROM edges")
cte("nodes", "e2", "SELECT DISTINCT src AS node FROM e2")
cte("levels", "dense", "SELECT station_key, avg(CASE WHEN daytype=0 THEN v END) weekday_mean, avg(CASE WHEN daytype>0 THEN v END) weekend_mean FROM (SELECT station_key, day, daytype, sum(reading) v FROM dense GROUP BY 1,2,3) GROUP BY 1")
cte("od", "", f"SELECT {station_of('c_nationkey')} AS origin, {station_of('s_nationkey')} AS destination, count(*) AS riders FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey JOIN supplier ON s_suppkey=l_suppkey WHERE c_nationkey<>s_nationkey GROUP BY 1,2")
cte("tedges", "edges stations", f"SELECT e.src, e.dst, e.line, round({hav('a', 'b')}*120)+30 AS cost FROM edges e JOIN stations a ON a.station_key=e.src JOIN stations b ON b.station_key=e.dst")


def levels(n):
    return st.station_levels(st.daily_totals(n.dense))


def od(n):
    """Distinct (origin, destination) with the riders behind them; the many order lines are shuffled once, and the result is kept."""
    li = n.raw("lineitem").select("l_orderkey", "l_suppkey")
    c = n.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = n.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey").drop("o_custkey")
    per = li.join(o, "l_orderkey").groupBy("c_nationkey", "l_suppkey").agg(F.count(F.lit(1)).alias("k"))
    s = n.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    from flowspark.bindings import station_of as so

    j = per.join(s, "l_suppkey").filter("c_nationkey <> s_nationkey")
    j = j.groupBy(so(F.col("c_nationkey")).alias("origin"), so(F.col("s_nationkey")).alias("destination")).agg(F.sum("k").alias("riders"))
    return cut(j.withColumn("od_id", F.concat("origin", F.lit(">"), "destination")))


def ride_edges(n):
    return n.edges.select("src", "dst", "line", F.lit(1.0).alias("cost"))


def timed_edges(n):
    s = n.stations.select("station_key", "lat", "lon")
    e = n.edges.join(s.toDF("src", "lat", "lon"), "src").join(s.toDF("dst", "rlat", "rlon"), "dst")
    return e.select("src", "dst", "line", (F.round(haversine_km("lat", "lon", "rlat", "rlon") * 120) + 30).alias("cost"))


@register("n0_line_order", "line station_key seq:i total:i", ctes="line_stops flows", sql="""
SELECT line, l.station_key, seq, coalesce(total,0) total FROM line_stops l LEFT JOIN (SELECT station_key, sum(reading) total FROM flows GROUP BY 1) f ON f.station_key=l.station_key""")
def _(n):
    chord = n.line_stops.withColumn("far", F.lead("station_key", 2).over(Window.partitionBy("line").orderBy("seq")))
    chord = chord.filter("far IS NOT NULL AND seq > 1 AND seq < 4").select("line", F.col("station_key").alias("src"), F.col("far").alias("dst"))
    chord = chord.filter("line <> 'L9'")
    one = chord.withColumn("r", F.row_number().over(Window.partitionBy("line").orderBy("src"))).filter("r = 1").drop("r")
    e = n.edges.select("line", "src", "dst").unionByName(one).unionByName(one.select("line", F.col("dst").alias("src"), F.col("src").alias("dst")))
    order = g.line_order(e)
    f = n.flows.groupBy("station_key").agg(F.sum("reading").alias("total"))
    return order.join(f, "station_key", "left").na.fill(0, ["total"])


@register("n1_sections", "closure_id:i line station_key pos:i", ctes="suspensions line_stops", sql="SELECT closure_id, s.line, l.station_key, abs(l.seq-s.sa)+1 pos FROM suspensions s JOIN line_stops l ON l.line=s.line AND l.seq BETWEEN least(sa,sb) AND greatest(sa,sb)")
def _(n):
    from flowspark.operators.closures import parse_closures

    c = parse_closures(n.suspensions, n.stations, n.line_stops)
    return c.filter("kind = 'line'").select("closure_id", "line", F.posexplode("stations").alias("p", "station_key")).withColumn("pos", F.col("p") + 1)


@register("n1_off_line", "od_id line station_key", ctes="od line_stops", sql="""
SELECT origin||'>'||destination od_id, 'L1' AS line, x station_key FROM (SELECT origin, destination, unnest([origin, destination]) x FROM od) WHERE x NOT IN (SELECT station_key FROM line_stops WHERE line='L1')""")
def _(n):
    r = od(n).select("od_id", F.lit("L1").alias("line"), F.col("origin").alias("a"), F.col("destination").alias("b"))
    return g.off_line(n.line_stops, r, "od_id")


@register("n2_hops", "source node d:i riders:i", ctes="e2 nodes od", sql="""
WITH RECURSIVE b AS (SELECT node AS source, node, 0 AS d FROM nodes UNION SELECT source, dst, d+1 FROM b JOIN e2 ON src=node WHERE d<24)
SELECT source, node, min(d) d, coalesce(any_value(riders),0) riders FROM b LEFT JOIN od ON origin=source AND destination=node GROUP BY 1,2""")
def _(n):
    h = g.all_pairs_hops(n.edges)
    return h.join(od(n).select(F.col("origin").alias("source"), F.col("destination").alias("node"), "riders"), ["source", "node"], "left").na.fill(0, ["riders"])


cte("alts", "stations", f"SELECT a.station_key, b.station_key AS other, {hav('a', 'b')} AS km, a.lines AS la, b.lines AS lb FROM stations a JOIN stations b ON a.station_key<>b.station_key")


@register("n3_reroute_alternatives", "closure_id:i station_key other km:f rank:i", ctes="suspensions line_stops alts", sql="""
SELECT closure_id, station_key, other, km, rank FROM (SELECT s.closure_id, a.station_key, other, km, row_number() OVER (PARTITION BY s.closure_id, a.station_key ORDER BY km, other) rank FROM suspensions s JOIN line_stops l ON l.line=s.line AND l.seq BETWEEN sa AND sb JOIN alts a ON a.station_key=l.station_key AND km<=3.0 WHERE len(list_filter(lb, lambda x: x<>s.line))>0) WHERE rank<=4""")
def _(n):
    from flowspark.operators.closures import parse_closures, walk_alternatives

    c = parse_closures(n.suspensions, n.stations, n.line_stops)
    return walk_alternatives(c, n.stations, 3.0)


cte("sections", "suspensions", "SELECT DISTINCT line, a, b, sa, sb FROM suspensions")


@register("n3_detours", "line a b stops:i", ctes="sections e2 line_stops", sql="""
WITH RECURSIVE blk AS (SELECT s.line, s.a, s.b, x.station_key u, y.station_key v FROM sections s JOIN line_stops x ON x.line=s.line AND x.seq BETWEEN sa AND sb JOIN line_stops y ON y.line=s.line AND y.seq BETWEEN sa AND sb AND abs(x.seq-y.seq)=1),
w AS (SELECT line, a, b, a AS here, 0 AS d FROM sections UNION SELECT w.line, w.a, w.b, dst, d+1 FROM w JOIN e2 ON src=here WHERE d<24 AND NOT EXISTS (SELECT 1 FROM blk k WHERE k.line=w.line AND k.a=w.a AND k.b=w.b AND k.u=w.here AND k.v=e2.dst))
SELECT s.line, s.a, s.b, min(d) stops FROM sections s LEFT JOIN w ON w.line=s.line AND w.a=s.a AND w.b=s.b AND w.here=s.b GROUP BY 1,2,3""")
def _(n):
    from flowspark.operators.closures import detours, parse_closures

    c = parse_closures(n.suspensions, n.stations, n.line_stops)
    return detours(c, n.edges)


cte("reach", "e2 nodes", "SELECT * FROM (WITH RECURSIVE r AS (SELECT v.node AS removed, a.node AS a, a.node AS b FROM nodes v JOIN nodes a ON a.node<>v.node UNION SELECT removed, a, dst FROM r JOIN e2 ON src=b WHERE dst<>removed) SELECT * FROM r)")
cte("lbl", "reach", "SELECT removed, a AS node, min(b) AS label FROM reach GROUP BY 1,2")
cte("comps", "lbl levels", "SELECT *, row_number() OVER (PARTITION BY removed ORDER BY size DESC, label) AS r FROM (SELECT removed, label, count(*) AS size, sum(weekday_mean) AS wd, sum(weekend_mean) AS we FROM lbl JOIN levels ON station_key=node GROUP BY 1,2)")


@register("n4_fragmentation", "station_key pieces:i lost_pairs:i lost_share:f stations_cut_off:i affected_weekday:f affected_weekend:f", ctes="comps levels", sql="""
SELECT removed station_key, pieces, lost lost_pairs, lost/allp lost_share, off stations_cut_off, weekday_mean+wdc affected_weekday, weekend_mean+wec affected_weekend FROM (
SELECT removed, count(*) pieces, sum(size)*(sum(size)-1)/2-sum(size*(size-1)/2) lost, sum(size)*(sum(size)-1)/2 allp, coalesce(sum(size) FILTER (r>1),0) off, coalesce(sum(wd) FILTER (r>1),0) wdc, coalesce(sum(we) FILTER (r>1),0) wec FROM comps GROUP BY 1) JOIN levels ON station_key=removed""")
def _(n):
    return g.fragmentation(g.removal_components(n.edges), levels(n))


@register("n4_same_branch", "station_key", ctes="comps lbl levels", sql="""
WITH c AS (SELECT l.removed, l.node FROM lbl l JOIN comps k ON k.removed=l.removed AND k.label=l.label WHERE k.r>1),
rk AS (SELECT removed, row_number() OVER (ORDER BY count(*) DESC, removed) rank FROM c GROUP BY 1), s AS (SELECT removed, count(*) n FROM c GROUP BY 1),
o AS (SELECT a.removed, b.removed higher, count(*) i FROM c a JOIN c b ON a.node=b.node JOIN rk ra ON ra.removed=a.removed JOIN rk rb ON rb.removed=b.removed WHERE rb.rank<ra.rank GROUP BY 1,2)
SELECT DISTINCT o.removed station_key FROM o JOIN s x ON x.removed=o.removed JOIN s y ON y.removed=o.higher WHERE i/(x.n+y.n-i)>0.3""")
def _(n):
    cuts = g.cut_sets(g.removal_components(n.edges))
    rank = cuts.groupBy("removed").count().select(F.col("removed").alias("station_key"), F.row_number().over(Window.orderBy(F.col("count").desc(), "removed")).alias("rank"))
    return g.same_branch(cuts, rank, 0.3)


@register("n4b_efficiency_loss", "station_key efficiency_loss:f", ctes="e2 nodes", sql="""
WITH RECURSIVE b AS (SELECT v.node AS removed, a.node AS source, a.node AS node, 0 AS d FROM (SELECT node FROM nodes UNION ALL SELECT '') v JOIN nodes a ON a.node<>v.node UNION SELECT removed, source, dst, d+1 FROM b JOIN e2 ON src=b.node WHERE d<24 AND dst<>removed),
h AS (SELECT removed, source, node, min(d) d FROM b GROUP BY 1,2,3), n AS (SELECT count(*) n FROM nodes),
e AS (SELECT removed, sum(1.0/d) FILTER (d>0)/CASE WHEN removed='' THEN any_value(n)*(any_value(n)-1) ELSE (any_value(n)-1)*(any_value(n)-2) END ef FROM h, n GROUP BY 1)
SELECT removed station_key, 1-ef/(SELECT ef FROM e WHERE removed='') efficiency_loss FROM e WHERE removed<>''""")
def _(n):
    return g.efficiency_loss(n.edges)


cte("rstates", "edges od", """SELECT * FROM (WITH RECURSIVE r AS (SELECT DISTINCT origin, origin AS here, '' AS line, 0 AS rides, 0 AS changes FROM od UNION SELECT origin, dst, e.line, rides+1, changes+CASE WHEN r.line<>'' AND r.line<>e.line THEN 1 ELSE 0 END FROM r JOIN edges e ON e.src=r.here WHERE rides<16 AND changes+CASE WHEN r.line<>'' AND r.line<>e.line THEN 1 ELSE 0 END<=4) SELECT * FROM r)""")


@register("n5_routes", "origin destination stops:i changes:i cost:f riders:i", ctes="rstates od", sql="""
SELECT o.origin, o.destination, first(rides ORDER BY rides+3*changes, changes) stops, first(changes ORDER BY rides+3*changes, changes) changes, min(rides+3*changes) AS cost, any_value(riders) riders FROM od o JOIN rstates r ON r.origin=o.origin AND r.here=o.destination GROUP BY 1,2""")
def _(n):
    o = od(n)
    return g.routes(o, ride_edges(n), 3.0).join(o.select("od_id", "origin", "riders"), "od_id")


@register("n5_legs", "od_id leg:i line from_station to_station stops:i")
def _(n):
    """Legs of every route; which of several equal routes is chosen is fixed by path order, so rows only."""
    return g.legs(g.routes(od(n), ride_edges(n), 3.0))


@register("n5b_timed_routes", "origin destination cost:f riders:i", ctes="tedges od", sql="""
WITH RECURSIVE r USING KEY (origin, here, line) AS (SELECT DISTINCT origin, origin AS here, '' AS line, 0.0::DOUBLE AS cost, 0 AS changes FROM od
UNION SELECT origin, here, line, min(cost), min(changes) FROM (SELECT q.origin, e.dst AS here, e.line, q.cost+e.cost+CASE WHEN q.line<>'' AND q.line<>e.line THEN 180 ELSE 0 END AS cost, 0 AS changes FROM r q JOIN tedges e ON e.src=q.here) n WHERE NOT EXISTS (SELECT 1 FROM recurring.r o WHERE o.origin=n.origin AND o.here=n.here AND o.line=n.line AND o.cost<=n.cost) GROUP BY 1,2,3)
SELECT o.origin, o.destination, min(cost) AS cost, any_value(riders) riders FROM od o JOIN r ON r.origin=o.origin AND r.here=o.destination GROUP BY 1,2""")
def _(n):
    o = od(n)
    return g.routes(o, timed_edges(n), 180.0).join(o.select("od_id", "origin", "riders"), "od_id")


@register("n5b_without_line", "origin destination stops:i changes:i", ctes="edges od", sql="""
WITH RECURSIVE r AS (SELECT DISTINCT origin, origin AS here, '' AS line, 0 AS rides, 0 AS changes FROM od UNION SELECT origin, dst, e.line, rides+1, changes+CASE WHEN r.line<>'' AND r.line<>e.line THEN 1 ELSE 0 END FROM r JOIN edges e ON e.src=r.here WHERE e.line<>'L2' AND rides<16 AND changes+CASE WHEN r.line<>'' AND r.line<>e.line THEN 1 ELSE 0 END<=4)
SELECT o.origin, o.destination, first(rides ORDER BY rides+3*changes, changes) stops, first(changes ORDER BY rides+3*changes, changes) changes FROM od o JOIN r ON r.origin=o.origin AND r.here=o.destination GROUP BY 1,2""")
def _(n):
    o = od(n)
    ban = o.select(F.col("origin").alias("req"), F.lit("L2").alias("line")).distinct()
    st_ = g.cheapest_states(o.select(F.col("origin").alias("req"), "origin"), ride_edges(n), 3.0, banned_lines=ban)
    return g.pick_routes(st_, o.select("od_id", F.col("origin").alias("req"), "destination")).join(o.select("od_id", "origin"), "od_id")


@register("n5c_alternative_paths", "od_id rank:i stops:i", ctes="e2 od", sql="""
WITH RECURSIVE p AS (SELECT origin||'>'||destination od_id, destination, origin AS here, [origin] AS path FROM od UNION ALL SELECT od_id, destination, dst, list_append(path, dst) FROM p JOIN e2 ON src=here WHERE here<>destination AND NOT list_contains(path, dst) AND len(path)<=16)
SELECT od_id, rank, stops FROM (SELECT od_id, len(path)-1 stops, row_number() OVER (PARTITION BY od_id ORDER BY len(path), path) rank FROM p WHERE here=destination) WHERE rank<=3""")
def _(n):
    return g.k_simple_paths(od(n), n.edges, 3)


@register("n5c_closed_line", "src dst", ctes="e2 stations", sql="SELECT src, dst FROM e2 JOIN stations a ON a.station_key=src JOIN stations b ON b.station_key=dst WHERE list_sort(list_intersect(a.lines,b.lines))=['L2']")
def _(n):
    return g.closed_line_edges(n.edges, n.stations, "L2")


@register("n5d_diverse_routes", "od_id rank:i cost:f changes:i stops:i")
def _(n):
    """Repeated searches with growing bans: rows only; the tests compare the first route with a sequential search."""
    return g.diverse_routes(od(n), timed_edges(n), 3)


cte("cand", "alts e2", "SELECT station_key AS a, other AS b, km FROM alts WHERE station_key<other AND km<=2.5 AND NOT list_has_any(la, lb) AND NOT EXISTS (SELECT 1 FROM e2 WHERE src=station_key AND dst=other)")


@register("j13_link_candidates", "a b km:f riders:i", ctes="cand od", sql="SELECT a, b, km, coalesce((SELECT sum(riders) FROM od WHERE origin=a AND destination=b),0) riders FROM cand")
def _(n):
    c = g.link_candidates(n.stations, n.edges, 2.5)
    return c.join(od(n).select(F.col("origin").alias("a"), F.col("destination").alias("b"), "riders"), ["a", "b"], "left").na.fill(0, ["riders"])


@register("n8_best_new_link", "a b km:f pairs_reduction:f exposure_reduction:f", ctes="cand e2 nodes levels comps", sql="""
WITH RECURSIVE r AS (SELECT c.a, c.b, v.node AS removed, s.node AS s, s.node AS t FROM cand c, nodes v JOIN nodes s ON s.node<>v.node UNION SELECT r.a, r.b, removed, s, x.dst FROM r JOIN (SELECT src, dst, '' AS ca, '' AS cb FROM e2 UNION ALL SELECT a, b, a, b FROM cand UNION ALL SELECT b, a, a, b FROM cand) x ON x.src=r.t AND x.dst<>removed AND (x.ca='' OR (x.ca=r.a AND x.cb=r.b))),
l AS (SELECT a, b, removed, s AS node, min(t) label FROM r GROUP BY 1,2,3,4), k AS (SELECT a, b, removed, label, count(*) size, sum(weekday_mean) wd FROM l JOIN levels ON station_key=node GROUP BY 1,2,3,4),
z AS (SELECT *, row_number() OVER (PARTITION BY a, b, removed ORDER BY size DESC, label) q FROM k), f AS (SELECT a, b, sum(CASE WHEN q>1 THEN wd ELSE 0 END) x FROM z GROUP BY 1,2), pp AS (SELECT a, b, sum(lost) p FROM (SELECT a, b, removed, sum(size)*(sum(size)-1)/2-sum(size*(size-1)/2) lost FROM z GROUP BY 1,2,3) GROUP BY 1,2),
base AS (SELECT sum(CASE WHEN r>1 THEN wd ELSE 0 END) x0, (SELECT sum(lost) FROM (SELECT removed, sum(size)*(sum(size)-1)/2-sum(size*(size-1)/2) lost FROM comps GROUP BY 1)) p0 FROM comps)
SELECT c.a, c.b, km, (p0-p)/p0 pairs_reduction, (x0-x)/x0 exposure_reduction FROM cand c JOIN f USING(a,b) JOIN pp USING(a,b), base""")
def _(n):
    return g.best_new_links(g.removal_components(n.edges), g.link_candidates(n.stations, n.edges, 2.5), levels(n))


@register("n10_degrees", "stop degree:i neighbours:i riders:i", ctes="edges flows", sql="SELECT src AS stop, count(*) degree, count(DISTINCT dst) neighbours, (SELECT sum(reading) FROM flows WHERE station_key=src) riders FROM edges GROUP BY 1")
def _(n):
    r = n.flows.groupBy(F.col("station_key").alias("stop")).agg(F.sum("reading").alias("riders"))
    return g.degrees(n.edges).join(r, "stop", "left")


# -- dependencies -----------------------------------------------------------------------------
cte("hz", "risk", """SELECT station_key, hour, zb-avg(zb) OVER (PARTITION BY hour) AS zb, zf-avg(zf) OVER (PARTITION BY hour) AS zf FROM (SELECT station_key, date_trunc('hour',slot) AS hour, greatest(-10,least(10,(sum(reading)-sum(expected0))/sqrt(sum(expected0*expected0)+1))) zb, greatest(-10,least(10,(sum(reading)-sum(expected))/sqrt(sum(expected*expected)+1))) zf FROM risk GROUP BY 1,2)""")


@register("n6_dependencies", "a b r:f r_model:f r_calm:f venue_key pull:f", ctes="hz crowd e2", sql="""
WITH bz AS (SELECT DISTINCT date_trunc('hour', start-INTERVAL 120 MINUTE)+to_hours(CAST(i AS BIGINT)) AS hour FROM crowd, range(10) t(i) WHERE date_trunc('hour', start-INTERVAL 120 MINUTE)+to_hours(CAST(i AS BIGINT))<="end"+INTERVAL 120 MINUTE),
p AS (SELECT x.station_key a, y.station_key b, corr(x.zb,y.zb) r, corr(x.zf,y.zf) r_model, corr(x.zb,y.zb) FILTER (x.hour NOT IN (SELECT hour FROM bz)) r_calm FROM hz x JOIN hz y ON x.hour=y.hour AND x.station_key<y.station_key GROUP BY 1,2),
best AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM e2 WHERE src=a AND dst=b) ORDER BY r DESC, a, b LIMIT 8),
vh AS (SELECT DISTINCT venue_key, start, "end", date_trunc('hour',"end")+to_hours(CAST(i AS BIGINT)) AS hour FROM crowd, range(3) t(i)),
d AS (SELECT a, b, venue_key, sum(x.zb*y.zb) pull FROM best JOIN hz x ON x.station_key=a JOIN hz y ON y.station_key=b AND y.hour=x.hour JOIN vh ON vh.hour=x.hour GROUP BY 1,2,3)
SELECT best.*, venue_key, pull FROM best JOIN (SELECT a, b, first(venue_key ORDER BY pull DESC) venue_key, max(pull) pull FROM d GROUP BY 1,2) USING(a,b)""")
def _(n):
    return dp.station_dependencies(dp.hourly_z(risk(n)), n.crowd_events, n.edges, 8)


cte("spec", "fulld", """SELECT station_key, n, z-c*sum(z*c) OVER (PARTITION BY station_key)/sum(c*c) OVER (PARTITION BY station_key) AS x FROM (SELECT *, avg(z) OVER (PARTITION BY n) AS c FROM (SELECT station_key, n, res/nullif(stddev_pop(res) OVER (PARTITION BY station_key),0) AS z FROM (
SELECT station_key, dense_rank() OVER (ORDER BY slot) AS n, reading-avg(reading) OVER (PARTITION BY station_key, CASE WHEN wd<5 THEN 0 WHEN wd=5 THEN 1 ELSE 2 END, hm) AS res FROM fulld)))""")
cte("hops", "e2 nodes", "SELECT * FROM (WITH RECURSIVE b AS (SELECT node AS source, node, 0 AS d FROM nodes UNION SELECT source, dst, d+1 FROM b JOIN e2 ON src=node WHERE d<24) SELECT source, node, min(d) AS hops FROM b GROUP BY 1,2)")


@register("n7_residual_dependencies", "a b r:f hops:i best_lag:i best_r:f", ctes="spec hops", sql="""
WITH p AS (SELECT x.station_key a, y.station_key b, corr(x.x,y.x) r FROM spec x JOIN spec y ON x.n=y.n AND x.station_key<y.station_key GROUP BY 1,2),
c AS (SELECT p.*, hops FROM p JOIN hops ON source=a AND node=b WHERE hops>=3 ORDER BY r DESC, a DESC, b DESC LIMIT 5),
l AS (SELECT a, b, lag, corr(x.x,y.x) rl FROM c, range(-2,3) t(lag), spec x, spec y WHERE x.station_key=a AND y.station_key=b AND y.n=x.n+lag GROUP BY 1,2,3)
SELECT c.*, best_lag, best_r FROM c JOIN (SELECT a, b, first(lag ORDER BY rl DESC) best_lag, max(rl) best_r FROM l GROUP BY 1,2) USING(a,b)""")
def _(n):
    spec = dp.specific_residuals(st.full_calendar_days(n.dense))
    return dp.residual_dependencies(spec, g.all_pairs_hops(n.edges))
