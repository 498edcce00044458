"""Work that grew faster than the table: repeated lineage, copies per line, pairs that were shuffled, tasks of unbounded size."""

import random

import pytest
from pyspark.sql import functions as F

from flowspark.functions import lineage
from flowspark.operators import graph as g
from flowspark.operators import textaudit as ta
from flowspark.operators import timetable as tt


def test_restrictions_are_computed_once(spark):
    """Every round of the search reads the restrictions; their lineage runs once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    chain = [(f"s{i}", f"s{i + 1}", "A", 1.0) for i in range(7)] + [("s0", "s7", "B", 1.0)]
    edges = spark.createDataFrame(chain, "src string, dst string, line string, cost double")
    ban = spark.createDataFrame([("r", "B")], "req string, line string").mapInPandas(count, "req string, line string")
    st = g.cheapest_states(spark.createDataFrame([("r", "s0")], "req string, origin string"), edges, 3.0, banned_lines=ban)
    assert st.filter("station = 's7'").first()["cost"] == 7.0 and seen.value == 1


def test_direct_lines_do_not_copy_pairs_per_line(spark):
    rng = random.Random(5)
    serves = {s: set(rng.sample("ABCDEFGH", 3)) for s in range(30)}
    routes = spark.createDataFrame([(s, x) for s, v in serves.items() for x in v], "stop_id int, line string")
    od = spark.createDataFrame([(a, b) for a in range(30) for b in range(30) if a < b], "origin int, destination int")
    d = tt.direct_lines(od, routes)
    assert {(r.origin, r.destination): r.lines for r in d.collect()} == {(a, b): sorted(serves[a] & serves[b]) for a in range(30) for b in range(30) if a < b and serves[a] & serves[b]}
    joins = [x for x in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert joins and not any("line#" in x for x in joins)


def test_walks_beside_edges_shuffle_no_pairs(spark):
    rng = random.Random(6)
    pts = [(i, 52 + rng.random() * 0.02, 13 + rng.random() * 0.02) for i in range(60)]
    stops = spark.createDataFrame(pts, "stop_id int, lat double, lon double")
    every = {(r.a, r.b) for r in tt.proximity_walks(stops, 0.8).collect()}
    have = set(rng.sample(sorted(every), 20)) | {(0, 59), (1, 58)}
    w = tt.proximity_walks(stops, 0.8, spark.createDataFrame(sorted(have) * 2, "a int, b int"))
    assert {(r.a, r.b) for r in w.collect()} == every - have and len(every) > 100
    assert "LeftAnti" not in w._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("edges", [tt.timetable_edges, tt.first_edges])
def test_edges_of_a_large_timetable_use_more_tasks(spark, monkeypatch, edges):
    rng = random.Random(7)
    rows = [(trip, i, rng.randint(1, 40), 60 * i + rng.randint(0, 200), "A") for trip in range(400) for i in range(1, 6)]
    times = spark.createDataFrame(rows, "trip_id int, stop_sequence int, stop_id int, t int, line string")
    want = sorted(map(tuple, edges(times).collect()))
    monkeypatch.setattr(lineage, "ROWS_PER_TASK", 100)
    got = edges(times)
    assert sorted(map(tuple, got.collect())) == want
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 15


def test_a_table_is_read_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    from flowspark.sources.ingest import VersionedTable

    table = VersionedTable(spark, str(tmp_path), "id long, val long, day date, ver long", ["id"], newest="ver")
    rows = spark.range(2000).selectExpr("id", "id AS val", "DATE'2024-01-01' AS day", "1L AS ver")
    first = table.stage(rows, 1, n=2000)
    table.commit(table.version(), (first, table.stage(rows.filter("id % 2 = 0").withColumns({"val": F.lit(7).cast("long"), "ver": F.lit(2).cast("long")}), 2)))
    monkeypatch.setattr(lineage, "ROWS_PER_TASK", 100)
    got = table.read()
    assert got.count() == 2000 and got.filter("val = 7 AND ver = 2").count() == 1000
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 15


@pytest.mark.parametrize("few", [0, 3, 16])
def test_figures_meet_facts_whatever_the_size_of_a_parent(spark, monkeypatch, few):
    """Pairs of a small parent's facts and intervals over a large one's give the same status; none reaches beyond the facts."""
    rng = random.Random(8)
    facts = [(d, p, float(rng.randint(1, 60))) for d in range(12) for p in "xy" for _ in range(rng.randint(1, 6))]
    figs = [(d, i, round(rng.choice([rng.uniform(0, 3), rng.uniform(0, 70), rng.uniform(100, 400)]), 1), 0.05) for d in range(12) for i in range(12)]
    near = lambda v, c, t: abs(v - c) <= t + 1e-9

    def status(d, c, t):
        own = [(p, x) for e, p, x in facts if e == d]
        if any(near(x, c, t) for _, x in own):
            return "verified"
        pairs = [(x, y) for p, x in own for q, y in own if p == q and x != y]
        return "calculated" if any(near(abs(x - y), c, t) or near(x / y, c, t) or near(abs(x / y - 1) * 100, c, t) for x, y in pairs) else "not_found"

    monkeypatch.setattr(ta, "FEW_FACTS", few)
    f = spark.createDataFrame([(d, i, v, "", t) for d, i, v, t in figs], "doc int, fig_id int, value double, unit string, tol double")
    got = ta.check_figures(f, spark.createDataFrame(facts, "doc int, parent string, number double"), "doc")
    assert {(r.doc, r.fig_id): r.status for r in got.collect()} == {(d, i): status(d, v, t) for d, i, v, t in figs}
