"""Closure texts, summaries and their measured effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock
from flowspark.functions import text as tx
from flowspark.functions.lineage import cut
from flowspark.functions import time as t
from flowspark.operators.graph import cheapest_states, bfs, undirected
from flowspark.operators.grid import window_spine
from flowspark.operators.joins import resolve_names, within_km
from flowspark.operators.stats import calendar, full_calendar_days

#: What a notice says of a closed thing, and what may follow a name in it.
CLOSED = ("closed", "suspended", "interrupted", "blocked")
FOLLOWS = ("due to", "because", "for", "on line", "on the", "of line")
_LINE = r"(?i)\bline\s+([a-z]\d+)\b"


def _any(words) -> str:
    return "(?i)\\b(?:" + "|".join(w.replace(" ", "\\s+") for w in words) + ")\\b"


def _piece(c: Column, pattern: str, i: int) -> Column:
    """Part ``i`` of the text around the first place that matches."""
    return F.trim(F.get(F.split(c, pattern, 2), F.lit(i)))


def _name(c: Column, ends, points: bool = False) -> Column:
    """The text up to the first of ``ends`` (or the first point, comma or semicolon); null when nothing is left."""
    cut = _piece(c, _any(ends), 0)
    return F.nullif(_piece(cut, "[.,;]", 0) if points else cut, F.lit(""))


def closure_fields(closures: DataFrame) -> DataFrame:
    """Form, line and the station names each notice states.

    A notice is read by its parts: what stands before "between", the two names around "and", a platform's station after
    "at" or before "platform", a station's name after "Station". The first form that all its parts allow holds.
    """
    d = F.col("description")
    says = lambda c, words: F.coalesce(c.rlike(_any(words)), F.lit(False))
    head, tail = _piece(d, _any(["between"]), 0), _piece(d, _any(["between"]), 1)
    first, second = _piece(tail, _any(["and"]), 0), _piece(tail, _any(["and"]), 1)
    line_of = lambda c: F.nullif(F.regexp_extract(c, _LINE, 1), F.lit(""))
    states = ("is", "are", *CLOSED)
    side_line = F.nullif(F.regexp_extract(second, r"(?i)\b(?:on|of)\s+(?:line\s+)?([a-z]\d+)\b", 1), F.lit(""))
    from_line = _piece(d, _LINE, 1)
    platform, after = _piece(d, _any(["platform"]), 0), _piece(d, _any(["platform"]), 1)
    at = _piece(after, _any(["at"]), 1)
    station = _piece(d, _any(["station"]), 1)
    forms = {
        "line_section": second.isNotNull() & line_of(head).isNotNull() & says(head, CLOSED),
        "segment": second.isNotNull() & says(head, ("segments?", "sections?", "tracks?")) & says(second, CLOSED),
        "whole_line": tail.isNull() & line_of(d).isNotNull() & says(_piece(from_line, "[.,;]", 0), CLOSED),
        "platform": says(at, CLOSED),
        "platform_first": says(after, CLOSED) & (F.length(platform) > 0),
        "station": says(station, CLOSED),
    }
    form = F.lit("unknown")
    for name in reversed(list(forms)):
        form = F.when(forms[name], F.lit(name)).otherwise(form)
    c = closures.withColumn("form", form)
    f = F.col("form")
    line = F.when(f == "line_section", line_of(head)).when(f == "segment", side_line).when(f == "whole_line", line_of(d)).otherwise(F.nullif(F.regexp_extract(d, r"\b([A-Z]\d)\b", 1), F.lit("")))
    before = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(platform, r"(?i)^station\s+", ""), r"[\s,]+$", "")), F.lit(""))
    a = (
        F.when(f.isin("line_section", "segment"), F.nullif(first, F.lit(""))).when(f == "platform", _name(at, states))
        .when(f == "platform_first", before).when(f == "station", _name(station, states))
    )
    b = F.when(f == "line_section", _name(second, FOLLOWS, points=True)).when(f == "segment", _name(second, (*states, "(?:on|of)(?:\\s+line)?\\s+[a-z]\\d+")))
    return c.withColumn("line", F.upper(line)).withColumn("name_a", a).withColumn("name_b", b)


def parse_closures(closures: DataFrame, stations: DataFrame, line_stops: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Structured closures: kind, line, stations (in order), issues.

    Names are resolved once per distinct spelling. A section whose ends are not on the line, or a
    name that is unknown or ambiguous, yields no stations and an issue.
    """
    c = closure_fields(closures)
    names = c.select(F.explode(F.array_compact(F.array("name_a", "name_b"))).alias("request"))
    res = cut(resolve_names(names, stations).select("request", "candidates", "match_kind"))
    ra = res.select(F.col("request").alias("name_a"), F.col("candidates").alias("ca"), F.col("match_kind").alias("ka"))
    rb = res.select(F.col("request").alias("name_b"), F.col("candidates").alias("cb"), F.col("match_kind").alias("kb"))
    c = c.join(ra, "name_a", "left").join(rb, "name_b", "left")
    seqs = line_stops.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "station_key"))), lambda s: s.station_key).alias("line_seq"))
    c = c.join(seqs, "line", "left")
    on_line = lambda col: F.array_intersect("line_seq", F.coalesce(F.col(col), F.array().cast("array<string>")))
    i = F.array_position("line_seq", F.get(on_line("ca"), F.lit(0)))
    j = F.array_position("line_seq", F.get(on_line("cb"), F.lit(0)))
    c = c.withColumn("i", i).withColumn("j", j)
    ok = (F.col("i") > 0) & (F.col("j") > 0)
    part = F.slice("line_seq", F.least("i", "j").cast("int"), (F.abs(F.col("i") - F.col("j")) + 1).cast("int"))
    sect = F.when(ok, F.when(F.col("i") <= F.col("j"), part).otherwise(F.reverse(part)))
    f = F.col("form")
    sectioned = (f == "line_section") | ((f == "segment") & F.col("line").isNotNull())
    none = F.array().cast("array<string>")
    kind = (
        F.when(sectioned | ((f == "whole_line") & F.col("line_seq").isNotNull()), "line").when(f == "segment", "segment")
        .when(f.startswith("platform"), "platform").when(f == "station", "station").otherwise("unknown")
    )
    st = F.when(sectioned, F.coalesce(sect, none)).when(f == "whole_line", F.coalesce("line_seq", none)).when(f == "segment", none).otherwise(F.coalesce("ca", none))
    issue = (
        F.when(sectioned & ~F.coalesce(ok, F.lit(False)), F.lit("section ends are not served by the line"))
        .when(f.isin("station", "platform", "platform_first") & (F.coalesce(F.size("ca"), F.lit(0)) == 0), F.lit("unknown station"))
        .when(f == "unknown", F.lit("description not in a known pattern"))
    )
    out = c.withColumn("kind", kind).withColumn("stations", st).withColumn("issues", F.array_compact(F.array(issue)))
    if edges is not None:
        out = _fill_segments(out, edges)
    keep = [x for x in closures.columns if x not in ("kind", "line", "stations", "issues")]
    return out.select(*keep, "kind", "line", "stations", "issues")


def _fill_segments(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """Stations of line-less segments: fewest stops between the two ends."""
    one = (F.col("kind") == "segment") & (F.size("ca") == 1) & (F.size("cb") == 1)
    seg = parsed.filter(one).select("closure_id", F.col("ca")[0].alias("origin"), F.col("cb")[0].alias("destination"))
    e = undirected(edges).select("src", "dst", F.lit("").alias("line"), F.lit(1.0).alias("cost"))
    st = cheapest_states(seg.select(F.col("origin").alias("req"), "origin"), e, 0.0)
    p = st.select(F.col("req").alias("origin"), F.col("station").alias("destination"), F.transform("path", lambda s: F.substring_index(s, "|", -1)).alias("_path"))
    seg = seg.join(p, ["origin", "destination"]).select("closure_id", "_path")
    return parsed.join(seg, "closure_id", "left").withColumn("stations", F.coalesce("_path", "stations")).drop("_path")


def walk_alternatives(parsed: DataFrame, stations: DataFrame, walk_km: float = 1.2, k: int = 4) -> DataFrame:
    """Per suspended section and station: nearest stations that keep another line, at most ``k``."""
    s = stations.select("station_key", "lat", "lon")
    o = stations.select(F.col("station_key").alias("other"), "lat", "lon", F.col("lines").alias("other_lines"))
    near = within_km(s, o, walk_km).filter("station_key <> other").select("station_key", "other", "km", "other_lines")
    c = parsed.filter(F.size("stations") > 0).select("closure_id", "line", F.explode("stations").alias("station_key"))
    j = c.join(near, "station_key").filter(F.size(F.array_except("other_lines", F.array("line"))) > 0)
    w = Window.partitionBy("closure_id", "station_key").orderBy("km", "other")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("closure_id", "station_key", "other", "km", "rank")


def section_roles(parsed: DataFrame) -> DataFrame:
    """(closure_id, line, station_key, role): end or interior of a suspended section."""
    c = parsed.filter((F.col("kind") == "line") & (F.size("stations") > 0))
    x = c.select("closure_id", "line", F.size("stations").alias("n"), F.posexplode("stations").alias("p", "station_key"))
    return x.select("closure_id", "line", "station_key", F.when((F.col("p") == 0) | (F.col("p") == F.col("n") - 1), "end").otherwise("interior").alias("role"))


def detours(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """Fewest stops between the ends of each distinct suspended section without its own track; null if cut off."""
    c = parsed.filter((F.col("kind") == "line") & (F.size("stations") > 1))
    c = c.select("line", "stations", F.col("stations")[0].alias("a"), F.element_at("stations", -1).alias("b")).distinct()
    c = c.withColumn("req", F.concat_ws(">", "line", "a", "b"))
    pairs = F.arrays_zip(F.expr("slice(stations, 1, size(stations) - 1)").alias("u"), F.expr("slice(stations, 2, size(stations) - 1)").alias("v"))
    x = c.select("req", F.explode(pairs).alias("x")).select("req", F.col("x.u").alias("src"), F.col("x.v").alias("dst"))
    blocked = x.unionByName(x.select("req", F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = undirected(edges).select("src", "dst", F.lit("").alias("line"), F.lit(1.0).alias("cost"))
    st = cheapest_states(c.select("req", F.col("a").alias("origin")), e, 0.0, blocked=blocked)
    hit = st.select("req", F.col("station").alias("b"), (F.size("path") - 1).alias("stops"), F.transform("path", lambda s: F.substring_index(s, "|", -1)).alias("path"))
    return c.select("req", "line", "a", "b").join(hit, ["req", "b"], "left")


# -- summaries --------------------------------------------------------------------------------


def hours(start="start", end="end") -> Column:
    return (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 3.6e9


def closures_summary(closures: DataFrame) -> DataFrame:
    """Count and hours by (dimension, value): kind, cause, line."""
    c = closures.withColumn("h", hours()).withColumn("cause", tx.cause("description"))
    d = F.array(
        F.struct(F.lit("kind").alias("dimension"), F.col("kind").alias("value")), F.struct(F.lit("cause").alias("dimension"), F.col("cause").alias("value")),
        F.struct(F.lit("line").alias("dimension"), F.coalesce("line", F.lit("-")).alias("value")),
    )
    x = c.select("h", F.explode(d).alias("x")).select("h", "x.*")
    return x.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("hours"))


def disruptions_per_line(closures: DataFrame, stations: DataFrame) -> DataFrame:
    """Count and hours per line; a station closure counts for each of its first station's lines."""
    s = stations.select(F.col("station_key").alias("first"), F.col("lines").alias("_ls"))
    c = closures.withColumn("first", F.get("stations", F.lit(0))).join(s, "first", "left")
    ls = F.when(F.col("kind") == "line", F.array("line")).otherwise(F.coalesce("_ls", F.array().cast("array<string>")))
    return c.select(F.explode(ls).alias("line"), hours().alias("h")).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("hours"))


def list_closures(closures: DataFrame, date_from=None, date_to=None, line=None, station=None, kind=None, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Filtered closures with duration and reason."""
    d = t.service_day("start", clock)
    c = closures.withColumn("day", d)
    if date_from:
        c = c.filter(F.col("day") >= F.lit(date_from).cast("date"))
    if date_to:
        c = c.filter(F.col("day") <= F.lit(date_to).cast("date"))
    if line:
        c = c.filter(F.col("line") == line.upper())
    if kind:
        c = c.filter(F.col("kind") == kind)
    if station:
        c = c.filter(F.array_contains("stations", station))
    mins = F.floor(hours() * 60)
    return c.withColumn("minutes", mins.cast("long")).withColumn("duration", tx.hours_minutes(mins)).withColumn("reason", tx.reason("description"))


def closed_and_silent(cells: DataFrame, closures: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Per closure and station: slots inside it, how many read zero, and whether all did."""
    from flowspark.operators.joins import closed_slots

    j = closed_slots(closures, clock).join(cells.select("station_key", "slot", "reading"), ["station_key", "slot"])
    return j.groupBy("closure_id", "station_key").agg(
        F.count(F.lit(1)).alias("slots"), F.count_if(F.col("reading") == 0).alias("zero_slots"), F.bool_and(F.col("reading") == 0).alias("is_closed")
    )


# -- effects ----------------------------------------------------------------------------------


def closure_impact(cells: DataFrame, roles: DataFrame, closures: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Observed against the same slots on the other full same weekdays, per (closure, station, role).

    ``roles`` has (closure_id, station_key, role). Baselines are taken from per-(station, weekday,
    time) sums, subtracting the closure's own slot, so no day is scanned twice.
    """
    from flowspark.operators.stats import full_calendar_days

    full = full_calendar_days(cells)
    base = full.groupBy("station_key", "wd", t.service_minute("slot", clock).alias("m")).agg(F.sum("reading").alias("s"), F.count(F.lit(1)).alias("n"))
    win = window_spine(closures.select("closure_id", "start", "end"), clock, inclusive=False).filter(F.col("slot") >= F.col("start"))
    x = roles.join(win.select("closure_id", "slot"), "closure_id").withColumn("wd", F.weekday("slot")).withColumn("m", t.service_minute("slot", clock))
    x = x.join(cells.select("station_key", "slot", "reading"), ["station_key", "slot"])
    own = full.select("station_key", "slot", F.lit(1).alias("_own"))
    x = x.join(own, ["station_key", "slot"], "left").join(base, ["station_key", "wd", "m"])
    self_n = F.coalesce("_own", F.lit(0))
    x = x.withColumn("mean", F.try_divide(F.col("s") - F.col("reading") * self_n, F.col("n") - self_n))
    g = x.groupBy("closure_id", "station_key", "role").agg(F.sum("reading").alias("observed"), F.sum("mean").alias("expected"), F.count(F.lit(1)).alias("slots"))
    return g.withColumn("change_pct", F.when(F.col("expected") > 0, (F.col("observed") / F.col("expected") - 1) * 100))


def hop_bands(sections: DataFrame, edges: DataFrame) -> DataFrame:
    """Distance of every station to each suspended section: near (1-2 stops), far (5 or more)."""
    s = sections.select("closure_id", F.col("closure_id").cast("string").alias("source"), F.col("station_key").alias("node"))
    d = bfs(undirected(edges), s, ["closure_id"]).groupBy("closure_id", "node").agg(F.min("d").alias("hops"))
    band = F.when(F.col("hops").between(1, 2), "near").when(F.col("hops") >= 5, "far").when(F.col("hops") == 0, "section").otherwise("middle")
    return d.select("closure_id", F.col("node").alias("station_key"), "hops", band.alias("role"))


def routing_test(impact: DataFrame) -> DataFrame:
    """Mean change near and far per closure, and whether the near stations rose more."""
    near, far = F.col("role") == "near", F.col("role") == "far"
    g = impact.filter(F.col("expected") > 0).groupBy("closure_id").agg(F.avg(F.when(near, F.col("change_pct"))).alias("near_pct"), F.avg(F.when(far, F.col("change_pct"))).alias("far_pct"))
    return g.withColumn("near_rose_more", F.col("near_pct") > F.col("far_pct"))


def sign_test(tests: DataFrame) -> DataFrame:
    """Two-sided binomial test that near and far win equally often: k wins of n."""
    s = tests.filter("near_pct IS NOT NULL AND far_pct IS NOT NULL").agg(F.count_if("near_rose_more").alias("k"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("p_value", binomial_two_sided(F.col("k"), F.col("n")))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """min(1, 2 * P(X <= min(k, n-k))) for X ~ Binomial(n, 1/2), through log factorials."""
    m = F.least(k, n - k)
    logfact = lambda x: F.aggregate(F.sequence(F.lit(1), F.greatest(x, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    term = lambda i: F.exp(logfact(n) - logfact(i) - logfact(n - i) - n * F.log(F.lit(2.0)))
    tail = F.aggregate(F.sequence(F.lit(0), m.cast("int")), F.lit(0.0), lambda a, i: a + term(i))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail)).otherwise(F.lit(1.0))
