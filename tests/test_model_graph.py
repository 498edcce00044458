"""Model fits against brute force, graph operators against small searches, plans against sequential ones."""

import datetime as dt
import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.model import fit as ft
from flowspark.operators import dependencies as dp
from flowspark.operators import graph as g
from flowspark.operators.closures import binomial_two_sided
from flowspark.plans import operations as op


def test_recovery_of_known_factors(spark):
    rng = np.random.default_rng(1)
    S, D = 12, 24
    w = rng.uniform(50, 200, S)
    P = 1 + 0.5 * np.sin(np.arange(80) / 12)
    rows, cap = [], 10**6
    for d in range(D):
        day = dt.date(2026, 6, 8) + dt.timedelta(days=d % 5)
        for k in range(80):
            slot = dt.datetime(2026, 6, 8) + dt.timedelta(days=d, minutes=300 + 15 * k)
            for s in range(S):
                rows.append((f"S{s}", slot, slot.date(), k, 0, float(int(w[s] * P[k] * rng.exponential()) + 0.5), True, 1, 5 <= slot.hour < 13))
    grid = spark.createDataFrame(rows, "station_key string, slot timestamp_ntz, day date, tod int, daytype int, xc double, use boolean, unc int, morning boolean")
    fw, fp, fm = ft.fit_core(grid, 5)
    got = {r["station_key"]: r["w"] for r in fw.collect()}
    prof = {r["tod"]: r["p"] for r in fp.collect()}
    mean_m = fm.agg(F.avg("m")).first()[0]
    ratio = [got[f"S{s}"] * np.mean([prof[k] for k in range(80)]) * mean_m / (w[s] * P.mean()) for s in range(S)]
    assert np.allclose(np.array(ratio) / np.mean(ratio), 1, atol=0.15) and 0.85 < np.mean(ratio) < 1.15


def test_weather_rule_against_known_parameters(spark):
    rng = np.random.default_rng(2)
    slots, wx = [], []
    for d in range(20):
        temp = 14 + d % 9
        for k in range(80):
            slot = dt.datetime(2026, 6, 1) + dt.timedelta(days=d, minutes=300 + 15 * k)
            prcp = float(rng.choice([0, 0, 0.3, 1.0, 3.0]))
            slots.append((slot, float(np.exp(0.1 - 0.02 * (temp - 18) + 0.3 * (1 - np.exp(-prcp / 0.7))))))
            wx.append((slot, dt.date(2026, 6, 1) + dt.timedelta(days=d), float(temp), prcp))
    m = spark.createDataFrame(slots, "slot timestamp_ntz, m double")
    w = spark.createDataFrame(wx, "slot timestamp_ntz, day date, temp double, prcp double")
    r = ft.fit_weather(m, w, levels=4)
    assert r["heat"] == pytest.approx(-0.02, abs=1e-3) and r["rain_max"] == pytest.approx(0.3, abs=5e-3)
    assert r["rain_scale"] == pytest.approx(0.7, abs=0.03) and r["a0"] == pytest.approx(0.1, abs=1e-3)


def test_share_likelihood_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        base, u = float(rng.uniform(5, 30)), float(rng.uniform(50, 300))
        x = min(150, int((base + 0.4 * u) * rng.exponential()))
        rows.append(("V", "A", x, base, u, 150))
    c = spark.createDataFrame(rows, "venue_key string, station_key string, reading int, base double, u double, ceiling int")
    r = ft.share_likelihood(c).first()

    def nll(s):
        out = 0.0
        for _, _, x, b, u, cap in rows:
            lam = max(b, 0.5) + s * u
            out += cap / lam if x >= cap else math.log(lam) + min(x + 0.5, cap) / lam
        return out

    best = min(np.linspace(0, 1.5, 15001), key=nll)
    assert r["share"] == pytest.approx(best, abs=2e-3) and r["lr"] == pytest.approx(2 * (nll(0) - nll(best)), abs=1e-2)


def edges(spark, pairs, line="L"):
    e = spark.createDataFrame([(a, b, line, 1.0) for a, b in pairs], "src string, dst string, line string, cost double")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "line", "cost"))


def test_branch_removal(spark):
    e = edges(spark, [("1", "2"), ("2", "3"), ("3", "4"), ("4", "5"), ("3", "6")])
    lv = spark.createDataFrame([(str(i), 10.0 * i, 5.0 * i) for i in range(1, 7)], "station_key string, weekday_mean double, weekend_mean double")
    r = {x["station_key"]: x for x in g.fragmentation(g.removal_components(e), lv).collect()}
    assert r["3"]["lost_pairs"] == 8 and r["3"]["pieces"] == 3 and r["1"]["lost_pairs"] == 0


def test_components_on_a_long_chain(spark):
    e = g.undirected(edges(spark, [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("x", "y")]))
    lab = g.components(e.select(F.col("src").alias("node")).distinct(), e)
    assert {r["label"] for r in lab.collect()} == {"000", "x"}


def random_graph(seed, n=8):
    rnd = random.Random(seed)
    nodes = [chr(97 + i) for i in range(n)]
    pairs = {(nodes[i], nodes[i + 1]) for i in range(n - 1)} | {tuple(sorted(rnd.sample(nodes, 2))) for _ in range(5)}
    return nodes, sorted(pairs)


def test_k_simple_paths_against_enumeration(spark):
    nodes, pairs = random_graph(4)
    adj = {n: sorted({b for a, b in pairs if a == n} | {a for a, b in pairs if b == n}) for n in nodes}

    def all_paths(a, b, path):
        if a == b:
            yield path
        else:
            for x in adj[a]:
                if x not in path:
                    yield from all_paths(x, b, path + [x])

    od = [(f"{a}{b}", a, b) for a, b in itertools.combinations(nodes, 2)]
    got = {(r["od_id"], r["rank"]): r["path"] for r in g.k_simple_paths(spark.createDataFrame(od, "od_id string, origin string, destination string"), edges(spark, pairs), 3).collect()}
    for i, a, b in od:
        want = sorted(all_paths(a, b, [a]), key=lambda p: (len(p), p))[:3]
        assert [got[(i, k + 1)] for k in range(len(want))] == want and (i, len(want) + 1) not in got


def dijkstra(e, a, b, penalty, ban=(), lines=()):
    best, heap = {}, [(0.0, 0, a, "")]
    while heap:
        c, ch, u, ln = heapq.heappop(heap)
        if (u, ln) in best:
            continue
        best[(u, ln)] = (c, ch)
        for s, d, l2, w in e:
            if s == u and d not in ban and l2 not in lines:
                x = int(ln != "" and ln != l2)
                heapq.heappush(heap, (c + w + penalty * x, ch + x, d, l2))
    hits = [v for (u, _), v in best.items() if u == b]
    return min(hits) if hits else None


def test_routes_against_dijkstra(spark):
    rnd = random.Random(7)
    nodes, pairs = random_graph(7)
    e = [(a, b, rnd.choice("XYZ"), float(rnd.randint(1, 9))) for a, b in pairs]
    e += [(b, a, ln, w) for a, b, ln, w in e]
    od = [(f"{a}{b}", a, b) for a in nodes for b in nodes if a != b]
    df = spark.createDataFrame(e, "src string, dst string, line string, cost double")
    req = spark.createDataFrame(od, "od_id string, origin string, destination string")
    got = {r["od_id"]: (r["cost"], r["changes"]) for r in g.routes(req, df, 4.0).collect()}
    for i, a, b in od:
        assert got[i] == dijkstra(e, a, b, 4.0)
    div = g.diverse_routes(req.limit(6), df, 3, 4.0).orderBy("od_id", "rank").collect()
    for r in div:
        if r["rank"] == 1:
            assert (r["cost"], r["changes"]) == dijkstra(e, r["od_id"][0], r["od_id"][1], 4.0)


def test_line_order_without_chords(spark):
    stops = list("abcdef")
    rows = [("L", a, b) for a, b in zip(stops, stops[1:])] + [("L", "b", "d")]
    rows += [(ln, b, a) for ln, a, b in rows]
    r = g.line_order(spark.createDataFrame(rows, "line string, src string, dst string")).orderBy("seq").collect()
    assert [x["station_key"] for x in r] == stops


def test_new_link_effect_against_recount(spark):
    pairs = [("1", "2"), ("2", "3"), ("3", "4"), ("4", "5"), ("3", "6"), ("6", "7")]
    wd = {str(i): float(i * i) for i in range(1, 8)}

    def exposure(ps):
        lost = cut = 0.0
        for v in wd:
            left, comps = set(wd) - {v}, []
            while left:
                todo, comp = [min(left)], set()
                while todo:
                    u = todo.pop()
                    if u in comp:
                        continue
                    comp.add(u)
                    todo += [b if a == u else a for a, b in ps if u in (a, b) and v not in (a, b)]
                left -= comp
                comps.append(comp)
            comps.sort(key=lambda c: (-len(c), min(c)))
            n = sum(map(len, comps))
            lost += n * (n - 1) / 2 - sum(len(c) * (len(c) - 1) / 2 for c in comps)
            cut += sum(wd[x] for c in comps[1:] for x in c)
        return lost, cut

    p0, x0 = exposure(pairs)
    p1, x1 = exposure(pairs + [("5", "7")])
    lv = spark.createDataFrame([(k, v, v) for k, v in wd.items()], "station_key string, weekday_mean double, weekend_mean double")
    cand = spark.createDataFrame([("5", "7", 1.0)], "a string, b string, km double")
    r = g.best_new_links(g.removal_components(edges(spark, pairs)), cand, lv).first()
    assert r["pairs_reduction"] == pytest.approx((p0 - p1) / p0) and r["exposure_reduction"] == pytest.approx((x0 - x1) / x0)


def test_pair_products_over_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 9))
    rows = [(f"K{k}", n, float(x[n, k])) for n in range(50) for k in range(9)]
    d = spark.createDataFrame(rows, "station_key string, n long, x double")
    p = dp.pair_products(d, ["x"], block=3, chunk_slots=16)
    got = {(r["a"], r["b"]): r["r"] for r in dp.correlations(p, d, "x", "r").collect()}
    c = np.corrcoef(x.T)
    assert len(got) == 36
    for (a, b), r in got.items():
        assert r == pytest.approx(c[int(a[1:]), int(b[1:])])


def test_staff_plan_equals_sequential_greedy(spark):
    rng = np.random.default_rng(6)
    val = np.round(rng.exponential(5, (20, 5)), 2) * (rng.random((20, 5)) < 0.6)
    day = dt.date(2026, 6, 10)
    rows = [(day, f"S{j}", i, float(val[i, j])) for i in range(20) for j in range(5)]
    d = spark.createDataFrame(rows, "day date, station_key string, tod int, value double")
    got = sorted((r["station_key"], r["tod_from"]) for r in op.staff_picks(d, 7, 1.0).collect())
    cover, want = np.zeros_like(val), []
    for _ in range(7):
        c = np.vstack([np.zeros((1, 5)), np.cumsum(val * 0.5**cover, axis=0)])
        block = c[4:] - c[:-4]
        i, j = np.unravel_index(np.argmax(block), block.shape)
        cover[i : i + 4, j] += 1
        want.append((f"S{j}", int(i)))
    assert got == sorted(want)


def test_sign_test(spark):
    r = spark.range(1).select(binomial_two_sided(F.lit(3), F.lit(12)), binomial_two_sided(F.lit(6), F.lit(12))).first()
    tail = sum(math.comb(12, i) for i in range(4)) / 2**12
    assert r[0] == pytest.approx(2 * tail) and r[1] == 1.0
