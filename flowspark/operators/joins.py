"""Joins the analytics need beyond plain equi-joins.

Interval joins become equi-joins by exploding the interval side into its slots; proximity
joins become equi-joins on grid cells; text joins run on folded keys. None falls back to a
nested loop. Small sides are left to the size-checked automatic broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from flowspark.config import DEFAULT_CLOCK, DEFAULT_PARAMS, Clock, ModelParams
from flowspark.functions import text as tx
from flowspark.functions import time as t
from flowspark.functions.geo import EARTH_KM, haversine_km
from flowspark.functions.lineage import broadcast_if_small, cut
from flowspark.operators.grid import window_spine

#: Names whose automaton one task holds at a time.
BLOCK_ALIASES = 200_000
#: Candidate pairs of a proximity join that one task looks at.
PAIRS_PER_TASK = 4_000_000
#: Columns of a cell in space.
CELL = ["_cx", "_cy", "_cz"]


# -- intervals --------------------------------------------------------------------------------


def closed_slots(closures: DataFrame, clock: Clock = DEFAULT_CLOCK, keys=()) -> DataFrame:
    """Station-slots inside a station closure: start <= slot < end, one row per cell and closure."""
    c = closures.filter((F.col("kind") == "station") & F.col("start").isNotNull())
    c = c.select(*keys, "closure_id", F.explode("stations").alias("station_key"), "start", "end")
    s = window_spine(c, clock, inclusive=False)
    return s.filter(F.col("slot") >= F.col("start")).select(*keys, "closure_id", "station_key", "slot", "day", "tod", "daytype")


def after_reopening(closures: DataFrame, slots: int, clock: Clock = DEFAULT_CLOCK, keys=()) -> DataFrame:
    """The first ``slots`` slots from the rounded-up end of each station closure, numbered from 0."""
    c = closures.filter((F.col("kind") == "station") & F.col("start").isNotNull())
    c = c.select(*keys, "closure_id", F.explode("stations").alias("station_key"), t.slot_ceil("end", clock).alias("reopen"))
    c = c.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    slot = F.col("reopen") + t.minutes(F.col("r") * clock.slot_minutes)
    return c.select(*keys, "closure_id", "station_key", slot.alias("slot"), "r")


def closed_cells(cells: DataFrame, closures: DataFrame, clock: Clock = DEFAULT_CLOCK, mask_slots: int = 4) -> DataFrame:
    """Cells with flags ``closed`` and ``after`` (within the slots after reopening)."""
    closed = closed_slots(closures, clock).select("station_key", "slot").distinct().withColumn("closed", F.lit(True))
    after = after_reopening(closures, mask_slots, clock).select("station_key", "slot").distinct().withColumn("after", F.lit(True))
    return (
        cells.join(closed, ["station_key", "slot"], "left").join(after, ["station_key", "slot"], "left")
        .na.fill(False, ["closed", "after"])
    )


def kernel_load(events: DataFrame, params: ModelParams = DEFAULT_PARAMS, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Attendance spread over the slots around start and end: (crowd_id, venue_key, slot, phase, load)."""

    def part(anchor: str, kernel: dict, phase: str) -> DataFrame:
        arr = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("f")) for k, f in sorted(kernel.items())])
        e = events.withColumn("kf", F.explode(arr))
        slot = t.slot_floor(anchor, clock) + t.minutes(F.col("kf.k") * clock.slot_minutes)
        return e.select("crowd_id", "venue_key", slot.alias("slot"), F.lit(phase).alias("phase"), (F.col("attendance") * F.col("kf.f")).alias("load"))

    return part("start", params.arrival_kernel, "arrival").unionByName(part("end", params.departure_kernel, "departure"))


def event_load(events: DataFrame, shares: DataFrame, params: ModelParams = DEFAULT_PARAMS, clock: Clock = DEFAULT_CLOCK, keys=()) -> DataFrame:
    """Additive event demand per (slot, station).

    Loads are summed per venue and slot before they meet the share table, so a venue with very
    many listings shuffles one row per slot and map task.
    """
    k = list(keys)
    per_venue = kernel_load(events, params, clock) if not k else _kernel_load_keyed(events, params, clock, k)
    per_venue = per_venue.groupBy(*k, "venue_key", "slot").agg(F.sum("load").alias("load"))
    return per_venue.join(shares, "venue_key").groupBy(*k, "station_key", "slot").agg(F.sum(F.col("load") * F.col("share")).alias("event_load"))


def _kernel_load_keyed(events, params, clock, keys):
    packed = events.withColumn("crowd_id", F.struct("crowd_id", *keys))
    out = kernel_load(packed, params, clock)
    return out.select("crowd_id.*", "venue_key", "slot", "phase", "load")


# -- space ------------------------------------------------------------------------------------


def _reach(radius_km: float) -> float:
    """Side of the cells: the chord of the radius."""
    return max(2 * math.sin(min(radius_km / EARTH_KM, math.pi) / 2), 1e-9) * (1 + 1e-9)


def _point() -> list[Column]:
    la, lo = F.radians("lat"), F.radians("lon")
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def _in_cells(df: DataFrame, side: float, prefix: str, spread: bool) -> DataFrame:
    """Rows with their point in space and its cell; with ``spread`` once for every neighbouring cell that a ball of radius ``side`` touches."""
    df = df.withColumns({f"{prefix}{i}": c for i, c in enumerate(_point())})
    df = df.withColumns({n: F.floor(F.col(f"{prefix}{i}") / side).cast("long") for i, n in enumerate(CELL)})
    if not spread:
        return df
    off = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    for n in CELL:
        df = df.withColumn("_d", F.explode(off)).withColumn(n, F.col(n) + F.col("_d")).drop("_d")
    gap = [F.greatest(F.col(n) * side - F.col(f"{prefix}{i}"), F.col(f"{prefix}{i}") - (F.col(n) + 1) * side, F.lit(0.0)) for i, n in enumerate(CELL)]
    return df.filter(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= side * side * (1 + 1e-6))


def _candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides per cell that both have: (cell, nl, nr); their products are the pairs a join has to look at."""
    n = lambda df, name: df.groupBy(*CELL).agg(F.count(F.lit(1)).alias(name))
    return n(left, "nl").join(n(right, "nr"), CELL)


def _pairs(cells: DataFrame) -> int:
    return int(cells.agg(F.coalesce(F.sum(F.col("nl") * F.col("nr")), F.lit(0))).first()[0])


def within_km(left: DataFrame, right: DataFrame, radius_km: float, where: Column | None = None, pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Pairs of rows at most ``radius_km`` apart; columns lat/lon on both sides (right as rlat/rlon). ``where`` holds for the wanted pairs.

    Equi-join on cells of a grid in space, whose side is the chord of the radius: the right side is copied into the neighbouring cells it reaches and
    the exact distance filters the candidates. Points in space know neither poles nor a date line, so no pair is lost anywhere. The candidates are
    counted by cell first: few cells with many rows would end in a few tasks, so the left rows of a cell with more than ``pairs_per_task`` are dealt out
    and all of them get as many partitions as the pairs need.
    """
    side = _reach(radius_km)
    lft = _in_cells(left, side, "_l", False)
    r = _in_cells(right, side, "_r", True).withColumnRenamed("lat", "rlat").withColumnRenamed("lon", "rlon")
    cells, keys = _candidates(lft, r), list(CELL)
    pairs = _pairs(cells)
    if pairs > pairs_per_task:
        heavy = cells.select(*CELL, F.ceil(F.col("nl") * F.col("nr") / pairs_per_task).cast("long").alias("_n")).filter("_n > 1")  # at most pairs / pairs_per_task rows
        heavy, keys = cut(heavy), [*CELL, "_s"]
        heavy = broadcast_if_small(heavy)
        parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * pairs // pairs_per_task))
        dealt = lft.join(heavy, CELL, "left").withColumn("_s", F.when(F.col("_n") > 1, F.pmod(F.xxhash64(*left.columns), F.col("_n"))).otherwise(F.lit(0).cast("long")))
        copies = r.join(heavy, CELL, "left").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_n", F.lit(1)) - 1)))
        lft, r = dealt.drop("_n").repartition(parts, *keys), copies.drop("_n").repartition(parts, *keys)
    j = lft.join(r, keys)
    if where is not None:
        j = j.filter(where)
    chord = [F.col(f"_l{i}") - F.col(f"_r{i}") for i in range(3)]
    j = j.filter(chord[0] * chord[0] + chord[1] * chord[1] + chord[2] * chord[2] <= side * side * (1 + 1e-6))
    j = j.withColumn("km", haversine_km("lat", "lon", "rlat", "rlon")).filter(F.col("km") <= radius_km)
    return j.drop(*keys, *[f"{p}{i}" for p in ("_l", "_r") for i in range(3)])


def _nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, start_km: float, max_km: float, k: int) -> DataFrame:
    """(key, right_key, km, rank) of the ``k`` nearest right rows up to ``max_km``, ties by right key.

    Of the right rows at one place the first ``k`` are kept, no other can be wanted. The first radius is the largest one at which the cells hold few
    candidates a row; it grows fourfold for the rows that have too few neighbours yet, so a dense place is settled by a local join.
    """
    here = Window.partitionBy("lat", "lon").orderBy(right_key)
    right = cut(right.select(right_key, "lat", "lon").withColumn("_n", F.row_number().over(here)).filter(F.col("_n") <= k).drop("_n"))
    todo, done, radius, w = cut(left.select(key, "lat", "lon")), None, start_km, Window.partitionBy(key).orderBy("km", right_key)
    rows = todo.count()
    while radius > 1e-4 and _pairs(_candidates(_in_cells(todo, _reach(radius), "_l", False), _in_cells(right, _reach(radius), "_r", True))) > max(16 * k * rows, PAIRS_PER_TASK):
        radius /= 4
    while True:
        j = within_km(todo, right, radius).select(key, right_key, "km")
        hit = cut(j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
        if radius < max_km:
            full = hit.filter(F.col("rank") == k).select(key)
            hit = hit.join(full, key, "left_semi")
        done = hit if done is None else done.unionByName(hit)
        if radius >= max_km:
            return done
        todo = cut(todo.join(hit.select(key).distinct(), key, "left_anti"))
        if todo.isEmpty():
            return done
        radius = min(radius * 4, max_km)


def nearest_k(left: DataFrame, right: DataFrame, key: str, right_key: str, radius_km: float, k: int) -> DataFrame:
    """Up to ``k`` nearest right rows within the radius per left key (ties by right key)."""
    return _nearest(left, right, key, right_key, radius_km, radius_km, k)


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, start_km: float = 1.0, max_km: float = 40000.0, k: int = 1) -> DataFrame:
    """The ``k`` nearest right rows of every left row, however far; fewer only if there are no more."""
    return _nearest(left, right, key, right_key, start_km, max_km, k).drop("rank")


def too_close_pairs(points: DataFrame, key: str, radius_km: float) -> DataFrame:
    """Unordered pairs of different points within the radius."""
    right = points.select(F.col(key).alias("other"), "lat", "lon")
    return within_km(points.select(key, "lat", "lon"), right, radius_km, F.col(key) < F.col("other")).select(key, "other", "km")


# -- text -------------------------------------------------------------------------------------


def mentions(texts: DataFrame, aliases: DataFrame, text_col: str = "text", word_bounded: bool = False, block_aliases: int = BLOCK_ALIASES, longest: bool = True) -> DataFrame:
    """All positions at which an alias occurs in a folded text, with the longest alias there or all of them: (text columns, alias, pos), 1-based.

    Each text is scanned once, character by character, by an automaton of the aliases that every task builds for itself. Larger gazetteers
    are dealt into blocks of at most about ``block_aliases`` names by a hash; each block scans the texts, and the longest name of all blocks stays. Every row
    of ``texts`` keeps its own mentions, equal rows too.
    """
    names = aliases.select("alias").filter(F.length("alias") > 0).distinct()
    blocks = max(1, -(-names.count() // block_aliases))
    rows = texts.withColumn("_row", F.monotonically_increasing_id()).withColumn("_t", tx.fold(text_col))
    if blocks > 1:
        rows = cut(rows)
    found = None
    for i in range(blocks):
        block = names if blocks == 1 else names.filter(F.pmod(F.xxhash64("alias"), F.lit(blocks)) == i)
        held = texts.sparkSession.sparkContext.broadcast(sorted(r[0] for r in block.collect()))  # about block_aliases names
        hits = rows.withColumn("_h", _scan(held, word_bounded, longest)(F.col("_t")))
        one = hits.select("*", F.explode("_h").alias("_x")).select("*", "_x.alias", "_x.pos").drop("_t", "_h", "_x")
        found = one if found is None else found.unionByName(one)
    if blocks > 1 and longest:
        w = Window.partitionBy("_row", "pos").orderBy(F.length("alias").desc())
        found = found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return found.drop("_row")


def _scan(held, word_bounded: bool, longest: bool):
    """Column function: places and names of the longest alias, or of all, at each place of a text."""

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        names = ahocorasick.Automaton()
        for name in held.value:
            names.add_word(name, name)
        ready = len(held.value) > 0
        if ready:
            names.make_automaton()
        for texts in batches:
            out = []
            for text in texts:
                best: dict[int, str] = {}
                every = []
                if ready and text:
                    for end, name in names.iter(text):
                        at = end - len(name) + 1
                        if word_bounded and (_in_word(text, at - 1) or _in_word(text, end + 1)):
                            continue
                        if not longest:
                            every.append((at, name))
                        elif len(name) > len(best.get(at, "")):
                            best[at] = name
                out.append([{"alias": name, "pos": at + 1} for at, name in sorted(every or best.items())])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(scan, "array<struct<alias:string,pos:int>>")


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at] in "abcdefghijklmnopqrstuvwxyz0123456789"


def longest_mention(texts: DataFrame, aliases: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Longest alias contained anywhere in each text; ties go to the earliest position."""
    m = mentions(texts, aliases, text_col)
    return m.groupBy(key).agg(F.max_by("alias", F.struct(F.length("alias"), -F.col("pos"))).alias("alias"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of all matching blocks over both lengths: longest common block first, then left and right of it."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, y, x, autojunk=False).ratio() if x and y else float(x == y) for x, y in zip(a, b)])


def _grams(k: str, sizes: Column) -> Column:
    """Pieces (g, p) of a name: all of the given sizes, with their places from 1."""
    of = lambda q: F.transform(F.sequence(F.lit(1), F.length(k) - q + 1), lambda p: F.struct(F.substring(F.col(k), p, q).alias("g"), p.alias("p")))
    return F.flatten(F.transform(F.filter(sizes, lambda q: q <= F.length(k)), of))


def name_candidates(left: DataFrame, right: DataFrame, cutoff: float, measure: str) -> DataFrame:
    """Pairs (lk, rk) that may reach the cutoff of ``close_names``: every pair that does, and few others."""
    edits = measure == "edits"
    slack = lambda x, y: ((1 - cutoff) * F.greatest(x, y) if edits else (1 - cutoff) * (x + y)) + 1e-9
    most = cutoff if edits else cutoff / (2 - cutoff)  # a name's length over that of its longest partner
    errors = lambda x: F.floor((1 - cutoff) * x * (1 / cutoff if edits else 2 / cutoff) + 1e-9).cast("int")
    longest = lambda x: F.floor(x / (errors(x) + 1)).cast("int")
    sizes = lambda x: F.sequence(F.greatest(longest(x) - 1, F.lit(1)), longest(x))
    names = lambda df, k: df.select(k).distinct().filter(F.length(k) > 0)
    y = F.length("rk")
    lens = F.sequence(F.ceil(y * most - 1e-9).cast("int"), F.floor(y / most + 1e-9).cast("int"))
    r = names(right, "rk").select("rk", F.explode(_grams("rk", F.array_distinct(F.flatten(F.transform(lens, sizes))))).alias("x")).select("rk", "x.g", F.col("x.p").alias("rp"))
    held = r.groupBy("g").agg(F.count_distinct("rk").alias("n"))
    l = names(left, "lk").withColumn("d", errors(F.length("lk"))).withColumn("q", F.explode(sizes(F.length("lk"))))
    l = l.withColumn("o", F.explode(F.sequence(F.lit(0), F.length("lk") - (F.col("d") + 1) * F.col("q"))))
    rows = lambda df: df.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d")))).withColumn("p", F.col("o") + F.col("i") * F.col("q") + 1).withColumn("g", F.substring(F.col("lk"), F.col("p"), F.col("q")))
    cost = rows(l).join(held, "g", "left").groupBy("lk", "d", "q", "o").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    best = cost.groupBy("lk", "d").agg(F.min(F.struct("n", (-F.col("q")).alias("q"), "o")).alias("b")).select("lk", "d", (-F.col("b.q")).alias("q"), "b.o")
    x = F.length("lk")
    near = (F.least(x, y) >= F.greatest(x, y) * most - 1e-9) & (F.abs(F.col("p") - F.col("rp")) <= slack(x, y))
    j = rows(best).select("lk", "g", "p").join(r, "g").filter((F.col("lk") != F.col("rk")) & near).select("lk", "rk").distinct()
    return j.filter(F.levenshtein("lk", "rk") <= slack(x, y))


def close_names(left: DataFrame, right: DataFrame, cutoff: float = 0.75, measure: str = "edits") -> DataFrame:
    """Pairs (lk, rk, score) of different keys of ``left`` (lk) and ``right`` (rk) with a similarity of at least ``cutoff``.

    ``measure`` is ``edits`` (1 - edit distance / longer length) or ``blocks`` (``block_ratio``). A pair that reaches the cutoff differs by at most d
    letters: (1 - cutoff) times the longer length, or times both lengths, of which each letter without a partner counts. Of d + 1 pieces of a name that don't
    overlap one is therefore whole in its partner, at most d letters further left or right. Every left name chooses, of all rows of adjoining
    pieces, those that the fewest right names hold, so letters that all names share bring no pairs. No letter has to be right, the first one included.
    """
    if measure not in ("edits", "blocks"):
        raise ValueError("measure must be edits or blocks")
    if not 0.67 < cutoff <= 1:
        raise ValueError("cutoff must lie above 0.67: below, too many letters may differ to choose pieces")
    j = name_candidates(left, right, cutoff, measure)
    score = similarity(F.col("lk"), F.col("rk")) if measure == "edits" else block_ratio(F.col("lk"), F.col("rk"))
    return j.select("lk", "rk", score.alias("score")).filter(F.col("score") >= cutoff)


def resolve_names(requests: DataFrame, stations: DataFrame, aliases: DataFrame | None = None, cutoff: float = 0.75, sure: float = 0.9, measure: str = "edits") -> DataFrame:
    """Station of each requested name: (request, match_kind, station_key, candidates).

    Cascade: exact key, alias, name before a bracket, close spelling (``close_names``: any letter may be wrong), whole-word part.
    Several stations at the deciding step make the request ambiguous. Distinct requests are resolved once.
    """
    req = requests.select("request").distinct().withColumn("nk", tx.name_key("request"))
    if aliases is not None:
        al = aliases.select(F.col("alias").alias("nk"), tx.name_key("target").alias("_target"))
        req = req.join(al, "nk", "left").withColumn("nk", F.coalesce("_target", "nk")).drop("_target")
    st = stations.select("station_key", tx.name_key("name").alias("sk"))
    st = st.withColumn("stem", F.trim(F.split("sk", r" \(")[0]))

    def found(j: DataFrame, kind: str, order: int) -> DataFrame:
        return j.select("request", "station_key", F.lit(kind).alias("kind"), F.lit(order).alias("ord"), F.lit(1.0).alias("score"))

    exact = found(req.join(st, F.col("nk") == F.col("sk")), "exact", 1)
    stem = found(req.join(st, F.col("nk") == F.col("stem")), "stem", 2)
    near = close_names(req.select(F.col("nk").alias("lk")), st.select(F.col("sk").alias("rk")), cutoff, measure)
    close = req.join(near, F.col("nk") == F.col("lk")).join(st, F.col("rk") == F.col("sk"))
    best = F.row_number().over(Window.partitionBy("request").orderBy(F.col("score").desc(), "sk"))
    close = close.withColumn("r", best).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("request")))
    close = close.filter((F.col("r") == 1) & ((F.col("n") == 1) | (F.col("score") > sure)))
    close = close.select("request", "station_key", F.lit("close").alias("kind"), F.lit(3).alias("ord"), "score")
    words = req.filter(F.length("nk") > 0).withColumn("w", F.split("nk", " ")[0])
    part = words.join(st.withColumn("w", F.explode(F.array_distinct(F.split("sk", " ")))), "w")
    part = found(part.filter(F.concat(F.lit(" "), "sk", F.lit(" ")).contains(F.concat(F.lit(" "), "nk", F.lit(" ")))), "part", 4)
    hits = exact.unionByName(stem).unionByName(close).unionByName(part)
    first = hits.withColumn("m", F.min("ord").over(Window.partitionBy("request"))).filter("ord = m")
    g = first.groupBy("request").agg(F.max("kind").alias("kind"), F.array_sort(F.collect_set("station_key")).alias("candidates"))
    out = req.select("request").join(g, "request", "left")
    n = F.size("candidates")
    return out.select(
        "request",
        F.when(F.col("kind").isNull(), "unknown").when(n > 1, "ambiguous").otherwise(F.col("kind")).alias("match_kind"),
        F.when(n == 1, F.col("candidates")[0]).alias("station_key"),
        F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"),
    )


def rare_token_join(texts: DataFrame, stations: DataFrame, key: str, text_col: str = "text", max_owners: int = 3) -> DataFrame:
    """Stations sharing rare words with a text; all names with the best hit count are returned."""
    owners = stations.select("name", F.explode(tx.name_tokens("name")).alias("token")).distinct()
    n = owners.groupBy("token").agg(F.count(F.lit(1)).alias("owners")).filter(F.col("owners") <= max_owners)
    owners = owners.join(n.select("token"), "token")
    words = texts.select(key, F.explode(tx.name_tokens(text_col)).alias("token")).distinct()
    hits = words.join(owners, "token").groupBy(key, "name").agg(F.count(F.lit(1)).alias("hits"))
    return hits.withColumn("r", F.rank().over(Window.partitionBy(key).orderBy(F.col("hits").desc()))).filter("r = 1").drop("r")
