"""Graph operators as iterated joins.

Every loop advances all sources and scenarios together and materialises one state table per round
through the reliable checkpoint, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.lineage import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) in both directions."""
    e = edges.select("src", "dst").filter("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def transfer_edges(stations: DataFrame) -> DataFrame:
    """Edges between different stations that carry the same name."""
    a = stations.select("name", F.col("station_key").alias("src"))
    b = stations.select("name", F.col("station_key").alias("dst"))
    return a.join(b, "name").filter("src <> dst").select("src", "dst", F.lit("transfer").alias("kind"))


# -- line order -------------------------------------------------------------------------------


def drop_chords(line_edges: DataFrame) -> DataFrame:
    """Remove triangle chords (line, src, dst): the chord's ends lead elsewhere, the third stop does not."""
    e = line_edges.select("line", "src", "dst").distinct()
    ab = e.filter("src < dst")
    ac = e.select("line", "src", F.col("dst").alias("c"))
    bc = e.select("line", F.col("src").alias("dst"), F.col("dst").alias("c"))
    tri = ab.join(ac, ["line", "src"]).join(bc, ["line", "dst", "c"])
    deg = e.groupBy("line", "src").agg(F.count(F.lit(1)).alias("deg"))
    for col, name in (("src", "da"), ("dst", "db"), ("c", "dc")):
        tri = tri.join(deg.select("line", F.col("src").alias(col), F.col("deg").alias(name)), ["line", col])
    # Inside the triangle every stop has two neighbours; more means a way out.
    chord = tri.filter("da > 2 AND db > 2 AND dc = 2").select("line", "src", "dst").distinct()
    both = chord.unionByName(chord.select("line", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return e.join(both, ["line", "src", "dst"], "left_anti")


def line_order(line_edges: DataFrame) -> DataFrame:
    """Stop order of every line from its edges, starting at the end stop with the smaller key."""
    e = drop_chords(line_edges)
    ends = e.groupBy("line", "src").count().filter("count = 1").groupBy("line").agg(F.min("src").alias("node"))
    starts = ends.select("line", F.col("node").alias("source"), "node")
    d = bfs(e.select("line", "src", "dst"), starts, ["line"], edge_keys=["line"])
    return d.select("line", F.col("node").alias("station_key"), (F.col("d") + 1).alias("seq"))


def section(line_stops: DataFrame, requests: DataFrame) -> DataFrame:
    """Stops of a line between a and b in travel order: (request columns, station_key, pos).

    Requests whose stations are not both on the line yield no rows; see ``off_line``.
    """
    a = line_stops.select("line", F.col("station_key").alias("a"), F.col("seq").alias("_i"))
    b = line_stops.select("line", F.col("station_key").alias("b"), F.col("seq").alias("_j"))
    r = requests.join(a, ["line", "a"]).join(b, ["line", "b"])
    j = r.join(line_stops, "line").filter(F.col("seq").between(F.least("_i", "_j"), F.greatest("_i", "_j")))
    return j.withColumn("pos", F.abs(F.col("seq") - F.col("_i")) + 1).drop("_i", "_j", "seq")


def off_line(line_stops: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Premise check: requested stations that the line does not serve."""
    x = requests.select(key, "line", F.explode(F.array("a", "b")).alias("station_key"))
    return x.join(line_stops.select("line", "station_key"), ["line", "station_key"], "left_anti")


# -- hops and components ----------------------------------------------------------------------


def bfs(edges: DataFrame, starts: DataFrame, keys: list[str] = (), edge_keys: list[str] = (), max_hops: int | None = None) -> DataFrame:
    """Hop distances from all sources: (keys, source, node, d). ``starts`` has (keys, source, node).

    ``edge_keys`` are scenario columns the edges carry. A key named ``removed`` names a node that
    paths must avoid.
    """
    k = list(keys)
    e = edges.select(*edge_keys, F.col("src").alias("node"), F.col("dst").alias("_n"))
    seen = cut(starts.select(*k, "source", "node").distinct().withColumn("d", F.lit(0)))
    hop = 0
    while max_hops is None or hop < max_hops:
        front = seen.filter(F.col("d") == hop)
        nxt = front.join(e, [*edge_keys, "node"])
        if "removed" in k:
            nxt = nxt.filter("_n <> removed")
        nxt = nxt.select(*k, "source", F.col("_n").alias("node"), F.lit(hop + 1).alias("d"))
        new = cut(seen.unionByName(nxt).groupBy(*k, "source", "node").agg(F.min("d").alias("d")))
        hop += 1
        seen = new
        if seen.filter(F.col("d") == hop).isEmpty():
            break
    return seen


def all_pairs_hops(edges: DataFrame) -> DataFrame:
    e = undirected(edges)
    s = e.select(F.col("src").alias("source"), F.col("src").alias("node")).distinct()
    return bfs(e, s)


def components(nodes: DataFrame, edges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Connected components by label propagation with pointer jumping: (keys, node, label).

    Jumping to the label's own label halves the distance to the root each round, so long chains
    settle in a logarithmic number of rounds. A key named ``removed`` excludes that node.
    """
    k = list(keys)
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("_n"))
    lab = cut(nodes.select(*k, "node").withColumn("label", F.col("node")).withColumn("moved", F.lit(True)))
    while True:
        msg = lab.join(e, "node")
        if "removed" in k:
            msg = msg.filter("_n <> removed")
        msg = msg.select(*k, F.col("_n").alias("node"), "label")
        old = lab.select(*k, "node", "label")
        m = old.withColumn("o", F.col("label")).unionByName(msg.withColumn("o", F.lit(None).cast("string")))
        m = m.groupBy(*k, "node").agg(F.min("label").alias("label"), F.max("o").alias("o"))
        hop = m.select(*k, F.col("node").alias("label"), F.col("label").alias("_l2"))
        m = m.join(hop, [*k, "label"], "left").withColumn("label", F.coalesce("_l2", "label"))
        lab = cut(m.select(*k, "node", "label", (F.col("label") != F.col("o")).alias("moved")))
        if lab.filter("moved").isEmpty():
            return lab.select(*k, "node", "label")


def without_each_node(edges: DataFrame) -> DataFrame:
    """(removed, node): every node under the removal of every other one."""
    n = edges.select(F.col("src").alias("node")).distinct()
    others = n.agg(F.array_sort(F.collect_set("node"))).scalar()
    return n.withColumn("removed", F.explode(others)).filter("removed <> node").select("removed", "node")


def removal_components(edges: DataFrame) -> DataFrame:
    """Components of the network under every single removal: (removed, node, label)."""
    e = undirected(edges)
    return components(without_each_node(e), e, ["removed"])


def fragmentation(labels: DataFrame, levels: DataFrame) -> DataFrame:
    """Per removed node: pieces, lost pairs, stations cut off and the passengers concerned.

    ``levels`` holds (station_key, weekday_mean, weekend_mean).
    """
    lv = levels.select(F.col("station_key").alias("node"), "weekday_mean", "weekend_mean")
    comp = labels.join(lv, "node", "left").groupBy("removed", "label").agg(
        F.count(F.lit(1)).alias("size"), F.sum("weekday_mean").alias("wd"), F.sum("weekend_mean").alias("we")
    )
    w = Window.partitionBy("removed").orderBy(F.col("size").desc(), "label")
    comp = comp.withColumn("r", F.row_number().over(w))
    n = F.sum("size")
    cut_off = F.col("r") > 1
    g = comp.groupBy("removed").agg(
        F.count(F.lit(1)).alias("pieces"),
        (n * (n - 1) / 2 - F.sum(F.col("size") * (F.col("size") - 1) / 2)).cast("long").alias("lost_pairs"),
        (n * (n - 1) / 2).cast("long").alias("all_pairs"),
        F.coalesce(F.sum(F.when(cut_off, F.col("size"))), F.lit(0)).alias("stations_cut_off"),
        F.coalesce(F.sum(F.when(cut_off, F.col("wd"))), F.lit(0.0)).alias("wd_cut"),
        F.coalesce(F.sum(F.when(cut_off, F.col("we"))), F.lit(0.0)).alias("we_cut"),
    )
    own = levels.select(F.col("station_key").alias("removed"), F.col("weekday_mean").alias("own_wd"), F.col("weekend_mean").alias("own_we"))
    g = g.join(own, "removed", "left")
    return g.select(
        F.col("removed").alias("station_key"), "pieces", "lost_pairs", (F.col("lost_pairs") / F.col("all_pairs")).alias("lost_share"), "stations_cut_off",
        (F.coalesce("own_wd", F.lit(0.0)) + F.col("wd_cut")).alias("affected_weekday"), (F.coalesce("own_we", F.lit(0.0)) + F.col("we_cut")).alias("affected_weekend"),
    )


def cut_sets(labels: DataFrame) -> DataFrame:
    """Stations outside the largest piece, per removed node."""
    size = labels.groupBy("removed", "label").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("removed").orderBy(F.col("size").desc(), "label")
    rest = size.withColumn("r", F.row_number().over(w)).filter("r > 1")
    return labels.join(rest, ["removed", "label"]).select("removed", "node", "label")


def same_branch(cuts: DataFrame, ranking: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Stations whose cut set overlaps a higher-ranked one's by more than the threshold.

    ``ranking`` has (station_key, rank). The overlap is counted by an equi-join on cut-off nodes.
    """
    r = ranking.select(F.col("station_key").alias("removed"), "rank")
    c = cuts.join(r, "removed").select("removed", "node", "rank")
    n = c.groupBy("removed").agg(F.count(F.lit(1)).alias("n"))
    o = c.select(F.col("removed").alias("higher"), "node", F.col("rank").alias("hr"))
    i = c.join(o, "node").filter("hr < rank").groupBy("removed", "higher").agg(F.count(F.lit(1)).alias("i"))
    i = i.join(n, "removed").join(n.toDF("higher", "m"), "higher")
    return i.filter(F.col("i") / (F.col("n") + F.col("m") - F.col("i")) > threshold).select(F.col("removed").alias("station_key")).distinct()


def global_efficiency(hops: DataFrame, n_nodes, keys: list[str] = ()) -> DataFrame:
    """Mean of 1/d over ordered pairs; ``n_nodes`` is the number of nodes in a scenario (column or int)."""
    n = n_nodes if not isinstance(n_nodes, int) else F.lit(n_nodes)
    s = hops.filter("d > 0").groupBy(*keys).agg(F.sum(1 / F.col("d")).alias("s"))
    return s.select(*keys, (F.col("s") / (n * (n - 1))).alias("efficiency"))


def efficiency_loss(edges: DataFrame) -> DataFrame:
    """Relative loss of global efficiency when a node is removed."""
    e = undirected(edges)
    n = e.select("src").distinct().agg(F.count(F.lit(1)).alias("n"))
    base = global_efficiency(all_pairs_hops(e), n.scalar())
    s = without_each_node(e).select("removed", F.col("node").alias("source"), "node")
    per = global_efficiency(bfs(e, s, ["removed"]), n.scalar() - 1, ["removed"])
    return per.select(F.col("removed").alias("station_key"), (1 - F.col("efficiency") / base.scalar()).alias("efficiency_loss"))


def best_new_links(labels: DataFrame, candidates: DataFrame, levels: DataFrame) -> DataFrame:
    """Effect of each candidate link (a, b) on passengers and pairs cut off over all removals.

    A link only merges the pieces of its two ends, so the result under a removal follows from the
    component sizes; no component search per candidate is needed.
    """
    lv = levels.select(F.col("station_key").alias("node"), F.coalesce("weekday_mean", F.lit(0.0)).alias("wd"))
    comp = labels.join(lv, "node", "left").groupBy("removed", "label").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("wd"), F.lit(0.0)).alias("wd"))
    tot = comp.groupBy("removed").agg(F.sum("size").alias("n"), F.sum("wd").alias("wd_all"), F.sum(F.col("size") * (F.col("size") - 1) / 2).alias("kept"))
    main = comp.groupBy("removed").agg(F.max("size").alias("max_size"))
    main = comp.join(main, "removed").filter("size = max_size").groupBy("removed").agg(F.min(F.struct("label", "size", "wd")).alias("main"))
    tot = tot.join(main, "removed")
    base = tot.agg(
        F.sum(F.col("n") * (F.col("n") - 1) / 2 - F.col("kept")).alias("p0"), F.sum(F.col("wd_all") - F.col("main.wd")).alias("x0")
    )
    ends = candidates.select("a", "b")
    la = labels.select("removed", F.col("node").alias("a"), F.col("label").alias("la"))
    lb = labels.select("removed", F.col("node").alias("b"), F.col("label").alias("lb"))
    ca = comp.select("removed", F.col("label").alias("la"), F.col("size").alias("sa"), F.col("wd").alias("wa"))
    cb = comp.select("removed", F.col("label").alias("lb"), F.col("size").alias("sb"), F.col("wd").alias("wb"))
    j = ends.join(la, "a").join(lb, ["b", "removed"]).filter("la <> lb").join(ca, ["removed", "la"]).join(cb, ["removed", "lb"]).join(tot, "removed")
    merged = F.col("sa") + F.col("sb")
    has_main = (F.col("la") == F.col("main.label")) | (F.col("lb") == F.col("main.label"))
    new_main = F.when(has_main, F.col("main.wd") + F.when(F.col("la") == F.col("main.label"), F.col("wb")).otherwise(F.col("wa")))
    # A merged piece that outgrows the old main one takes its place (on equal size the old one stays).
    new_main = new_main.when(merged > F.col("main.size"), F.col("wa") + F.col("wb")).otherwise(F.col("main.wd"))
    g = j.groupBy("a", "b").agg(F.sum(F.col("sa") * F.col("sb")).alias("dp"), F.sum(new_main - F.col("main.wd")).alias("dx"))
    out = candidates.join(g, ["a", "b"], "left").na.fill(0, ["dp", "dx"])
    p0, x0 = base.select("p0").scalar(), base.select("x0").scalar()
    return out.withColumn("pairs_reduction", F.try_divide("dp", p0)).withColumn("exposure_reduction", F.try_divide("dx", x0)).drop("dp", "dx")


def link_candidates(stations: DataFrame, edges: DataFrame, max_km: float) -> DataFrame:
    """Unlinked station pairs on disjoint lines within ``max_km``: (a, b, km)."""
    from flowspark.operators.joins import too_close_pairs

    s = stations.select("station_key", "lines")
    p = too_close_pairs(stations, "station_key", max_km).select(F.col("station_key").alias("a"), F.col("other").alias("b"), "km")
    p = p.join(s.toDF("a", "la"), "a").join(s.toDF("b", "lb"), "b").filter(~F.arrays_overlap("la", "lb"))
    e = undirected(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return p.join(e, ["a", "b"], "left_anti").select("a", "b", "km")


# -- routes -----------------------------------------------------------------------------------


def cheapest_states(requests: DataFrame, edges: DataFrame, penalty: float, banned_stops: DataFrame | None = None, blocked: DataFrame | None = None, banned_lines: DataFrame | None = None) -> DataFrame:
    """Cheapest way from each request's origin to every (station, line): cost, changes, path.

    ``requests`` has (req, origin); ``edges`` (src, dst, line, cost). A change of line adds the
    penalty. Paths are arrays of 'line|station'. Ties prefer fewer changes. ``banned_stops``
    (req, station), ``blocked`` (req, src, dst) and ``banned_lines`` (req, line) restrict single
    requests. Each round relaxes only the states improved by the round before. Edges and
    restrictions are materialised, since every round reads them.
    """
    banned_stops, blocked, banned_lines = (None if b is None else cut(b) for b in (banned_stops, blocked, banned_lines))
    e = edges.select(F.col("src").alias("station"), F.col("dst").alias("_to"), F.col("line").alias("_l"), F.col("cost").alias("_c"))
    e = cut(e)
    best = requests.select("req", F.col("origin").alias("station")).distinct()
    best = best.select(
        "req", "station", F.lit("").alias("line"), F.lit(0.0).alias("cost"), F.lit(0).alias("changes"),
        F.lit(0).alias("it"), F.array(F.concat(F.lit("|"), "station")).alias("path"),
    )
    best = cut(best)
    it = 0
    while True:
        f = best.filter(F.col("it") == it).join(e, "station")
        if banned_stops is not None:
            f = f.join(banned_stops.select("req", F.col("station").alias("_to")), ["req", "_to"], "left_anti")
        if blocked is not None:
            f = f.join(blocked.select("req", F.col("src").alias("station"), F.col("dst").alias("_to")), ["req", "station", "_to"], "left_anti")
        if banned_lines is not None:
            f = f.join(banned_lines.select("req", F.col("line").alias("_l")), ["req", "_l"], "left_anti")
        change = (F.col("line") != "") & (F.col("line") != F.col("_l"))
        nxt = f.select(
            "req", F.col("_to").alias("station"), F.col("_l").alias("line"),
            (F.col("cost") + F.col("_c") + F.when(change, F.lit(float(penalty))).otherwise(F.lit(0.0))).alias("cost"),
            (F.col("changes") + change.cast("int")).alias("changes"), F.lit(it + 1).alias("it"),
            F.concat("path", F.array(F.concat("_l", F.lit("|"), "_to"))).alias("path"),
        )
        m = best.unionByName(nxt).groupBy("req", "station", "line").agg(F.min(F.struct("cost", "changes", "it", "path")).alias("s"))
        best = cut(m.select("req", "station", "line", "s.*"))
        it += 1
        if best.filter(F.col("it") == it).isEmpty():
            return best


def pick_routes(states: DataFrame, od: DataFrame) -> DataFrame:
    """Best state at each destination: od has (od_id, req, destination)."""
    j = od.join(states.select("req", F.col("station").alias("destination"), "cost", "changes", "path"), ["req", "destination"])
    g = j.groupBy("od_id", "req", "destination").agg(F.min(F.struct("cost", "changes", "path")).alias("s"))
    return g.select("od_id", "req", "destination", "s.*").withColumn("stops", F.size("path") - 1)


def routes(od: DataFrame, edges: DataFrame, penalty: float = 3.0, **bans) -> DataFrame:
    """Routes for a table of (od_id, origin, destination). Without bans, equal origins share one search."""
    if bans:
        r = od.withColumn("req", F.col("od_id").cast("string"))
    else:
        r = od.withColumn("req", F.col("origin").cast("string"))
    st = cheapest_states(r.select("req", "origin").distinct(), edges, penalty, **bans)
    return pick_routes(st, r.select("od_id", "req", "destination"))


def legs(found: DataFrame, key: str = "od_id") -> DataFrame:
    """One row per leg of a route: (key, leg, line, from_station, to_station, stops, via)."""
    x = found.select(key, F.posexplode("path").alias("pos", "s"))
    x = x.select(key, "pos", F.substring_index("s", "|", 1).alias("line"), F.substring_index("s", "|", -1).alias("station"))
    w = Window.partitionBy(key).orderBy("pos")
    x = x.withColumn("prev", F.lag("station").over(w)).withColumn("pl", F.lag("line").over(w)).filter("pos > 0")
    x = x.withColumn("leg", F.sum(F.when(F.col("line") == F.col("pl"), 0).otherwise(1)).over(w))
    return x.groupBy(key, "leg", "line").agg(
        F.min_by("prev", "pos").alias("from_station"), F.max_by("station", "pos").alias("to_station"), F.count(F.lit(1)).alias("stops"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "station"))), lambda s: s.station).alias("stations"),
    ).withColumn("via", F.expr("slice(stations, 1, size(stations) - 1)")).drop("stations")


def fewest_stops(requests: DataFrame, edges: DataFrame, blocked: DataFrame | None = None, levels: int = 6) -> DataFrame:
    """(req, path): the path with the fewest stops of every request (req, root, destination), the first one by name among equals.

    A path starts at the last stop of ``root`` and meets no stop of it again; ``blocked`` (req, src, dst) takes edges from single requests. All requests
    advance together, ``levels`` stops between two materialisations; a stop keeps one path per request, and requests that have arrived leave.
    """
    start = F.element_at("root", -1)
    seen = cut(requests.select("req", "root", "destination", start.alias("at"), F.lit(0).alias("d"), F.array(start).alias("path")))
    done, depth = None, 0
    while True:
        for _ in range(levels):
            step = seen.filter((F.col("d") == depth) & (F.col("at") != F.col("destination"))).join(edges.select(F.col("src").alias("at"), F.col("dst").alias("_to")), "at")
            step = step.filter(~F.array_contains("root", F.col("_to")))
            if blocked is not None:
                step = step.join(blocked.select("req", F.col("src").alias("at"), F.col("dst").alias("_to")), ["req", "at", "_to"], "left_anti")
            step = step.select("req", "root", "destination", F.col("_to").alias("at"), F.lit(depth + 1).alias("d"), F.concat("path", F.array("_to")).alias("path"))
            best = F.min(F.struct("d", "path", "root", "destination")).alias("s")
            seen = seen.unionByName(step).groupBy("req", "at").agg(best).select("req", "s.root", "s.destination", "at", "s.d", "s.path")
            depth += 1
        seen = cut(seen)
        there = seen.filter("at = destination").select("req", "path")
        done = there if done is None else done.unionByName(there)
        seen = cut(seen.join(there, "req", "left_anti"))
        if seen.filter(F.col("d") == depth).isEmpty():
            return cut(done)


def k_simple_paths(od: DataFrame, edges: DataFrame, k: int = 3, blocked: DataFrame | None = None, avoid: DataFrame | None = None) -> DataFrame:
    """The k simple paths with the fewest stops per (od_id, origin, destination): (od_id, rank, stops, path); ties by path.

    Deviations of all requests are searched together: each stop of the path found last, from where it left its own parent on, is a spur; the search
    from it may not use the stops before it, nor the edges by which paths found so far leave the same beginning. The best candidate of each request is its next
    path. So k - 1 batched searches find k paths, however many simple paths there are. ``blocked`` (od_id, src, dst) and ``avoid``
    (od_id, station) restrict single requests.
    """
    e = cut(undirected(edges).select("src", "dst").distinct())
    todo = od.select("od_id", "origin", "destination").distinct()

    def restricted(reqs: DataFrame, more: DataFrame | None) -> DataFrame | None:
        """Edges that single searches (req, od_id) may not use."""
        parts = [more] if more is not None else []
        if blocked is not None:
            parts.append(reqs.select("req", "od_id").join(blocked.select("od_id", "src", "dst"), "od_id").select("req", "src", "dst"))
        if avoid is not None:
            closed = avoid.select("od_id", F.col("station").alias("dst")).join(e, "dst")
            parts.append(reqs.select("req", "od_id").join(closed, "od_id").select("req", "src", "dst"))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return None if out is None else out.distinct()

    first = todo.select(F.col("od_id").cast("string").alias("req"), "od_id", F.array("origin").alias("root"), "destination").filter(F.element_at("root", 1) != F.col("destination"))
    found = fewest_stops(first, e, restricted(first, None))
    new = cut(first.join(found, "req").select("od_id", "destination", "path", F.lit(0).alias("dev"), F.lit(1).alias("rank")))
    kept, pool = new, None
    for rank in range(2, k + 1):
        spur = new.select("od_id", "destination", "path", F.explode(F.sequence("dev", F.size("path") - 2)).alias("dev"))
        root = F.slice("path", 1, F.col("dev") + 1)
        spur = cut(spur.select(F.concat_ws("#", F.col("od_id").cast("string"), F.lit(str(rank)), F.col("dev").cast("string")).alias("req"), "od_id", "destination", "dev", root.alias("root")))
        same = spur.join(kept.select("od_id", F.col("path").alias("_p")), "od_id").filter((F.size("_p") > F.size("root")) & (F.slice("_p", 1, F.size("root")) == F.col("root")))
        leaves = same.select("req", F.element_at("root", -1).alias("src"), F.get("_p", F.size("root")).alias("dst"))
        got = fewest_stops(spur.select("req", "root", "destination"), e, restricted(spur, leaves))
        fresh = spur.join(got, "req").select("od_id", "destination", F.concat(F.slice("root", 1, F.size("root") - 1), "path").alias("path"), "dev")
        pool = cut(fresh if pool is None else pool.unionByName(fresh))
        w = Window.partitionBy("od_id").orderBy(F.size("path"), "path")
        ranked = cut(pool.withColumn("_r", F.row_number().over(w)))
        new = cut(ranked.filter("_r = 1").drop("_r").withColumn("rank", F.lit(rank)))
        if new.isEmpty():
            break
        pool = ranked.filter("_r > 1").drop("_r")
        kept = cut(kept.unionByName(new.select(kept.columns)))
    return kept.select("od_id", "rank", (F.size("path") - 1).alias("stops"), "path")


def closed_line_edges(edges: DataFrame, stations: DataFrame, line: str) -> DataFrame:
    """Edges that only the closed line serves."""
    s = stations.select("station_key", "lines")
    e = undirected(edges).join(s.toDF("src", "la"), "src").join(s.toDF("dst", "lb"), "dst")
    common = F.array_intersect("la", "lb")
    return e.filter(F.array_contains(common, line) & (F.size(common) == 1)).select("src", "dst")


def diverse_routes(od: DataFrame, edges: DataFrame, n_routes: int = 3, penalty: float = 180.0) -> DataFrame:
    """Up to ``n_routes`` (1 to 5) routes per request; each bans the intermediate stops of the main legs before it.

    The main leg is the one with the highest ride cost. A main leg without intermediate stops bans
    its line instead. A request ends when no route is left.
    """
    if not 1 <= n_routes <= 5:
        raise ValueError("n_routes must be 1 to 5")
    ban_s = ban_l = out = None
    live, edges = cut(od), cut(edges)
    for rank in range(1, n_routes + 1):
        bans = {}
        if ban_s is not None:
            bans["banned_stops"], bans["banned_lines"] = ban_s, ban_l
        found = routes(live, edges, penalty, **bans) if bans else pick_routes(
            cheapest_states(live.select(F.col("od_id").cast("string").alias("req"), "origin"), edges, penalty), live.withColumn("req", F.col("od_id").cast("string")).select("od_id", "req", "destination")
        )
        found = cut(found.withColumn("rank", F.lit(rank)))
        out = found if out is None else out.unionByName(found)
        if rank == n_routes or found.isEmpty():
            break
        lg = legs(found).join(_leg_costs(found, edges), ["od_id", "leg"])
        main = lg.groupBy("od_id").agg(F.max_by(F.struct("line", "via"), F.struct("leg_cost", -F.col("leg"))).alias("m"))
        req = F.col("od_id").cast("string").alias("req")
        s = main.select(req, F.explode("m.via").alias("station"))
        ln = main.filter(F.size("m.via") == 0).select(req, F.col("m.line").alias("line"))
        ends = live.select(req, F.explode(F.array("origin", "destination")).alias("station"))
        s = s.join(ends, ["req", "station"], "left_anti")
        ban_s = cut(s if ban_s is None else ban_s.unionByName(s).distinct())
        ban_l = cut(ln if ban_l is None else ban_l.unionByName(ln).distinct())
        live = cut(live.join(found.select("od_id"), "od_id", "left_semi"))
    return out


def _leg_costs(found: DataFrame, edges: DataFrame) -> DataFrame:
    x = found.select("od_id", F.posexplode("path").alias("pos", "s"))
    x = x.select("od_id", "pos", F.substring_index("s", "|", 1).alias("line"), F.substring_index("s", "|", -1).alias("dst"))
    w = Window.partitionBy("od_id").orderBy("pos")
    x = x.withColumn("src", F.lag("dst").over(w)).withColumn("pl", F.lag("line").over(w)).filter("pos > 0")
    x = x.withColumn("leg", F.sum(F.when(F.col("line") == F.col("pl"), 0).otherwise(1)).over(w))
    c = edges.groupBy("src", "dst", "line").agg(F.min("cost").alias("cost"))
    return x.join(c, ["src", "dst", "line"]).groupBy("od_id", "leg").agg(F.sum("cost").alias("leg_cost"))


# -- lookups ----------------------------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """Edges and distinct neighbours per stop."""
    return edges.groupBy(F.col("src").alias("stop")).agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("dst").alias("neighbours"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Adjacency export: one row per stop with its sorted neighbour list."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "line", "cost"))).alias("neighbours"))
