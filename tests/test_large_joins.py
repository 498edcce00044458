"""Joins by name and by distance at sizes where all pairs, or all pairs in one task, would not end."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from flowspark.operators import joins as jn


def test_names_with_common_letters_bring_few_candidates(spark):
    """Every name begins with the same letters; only names that differ in a letter are compared."""
    names = ["halt" + hashlib.md5(str(i).encode()).hexdigest()[:20] for i in range(1500)]
    left = spark.createDataFrame([(n,) for n in names] + [(n[:-1],) for n in names[:500]], "lk string")
    right = spark.createDataFrame([(n,) for n in names], "rk string")
    assert jn.name_candidates(left, right, 0.92, "blocks").count() <= 4 * len(names)
    got = {(r.lk, r.rk) for r in jn.close_names(left, right, 0.92, "blocks").collect()}
    assert {(n[:-1], n) for n in names[:500]} <= got and len(got) <= 510


def crowd(n, seed):
    rng = random.Random(seed)
    return [(i, 52.0 + rng.random() * 0.01, 13.0 + rng.random() * 0.01) for i in range(n)]


def km(a, b):
    la, lo, lb, mo = map(math.radians, (a[1], a[2], b[1], b[2]))
    return 2 * 6371 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((mo - lo) / 2) ** 2))


def test_a_full_cell_is_dealt_out(spark):
    """All points lie in one cell: its pairs are spread over tasks and none is lost or doubled."""
    pts, places = crowd(300, 1), crowd(200, 2)
    a, b = spark.createDataFrame(pts, "id int, lat double, lon double"), spark.createDataFrame(places, "sid int, lat double, lon double")
    j = jn.within_km(a, b, 5.0, pairs_per_task=2000)
    assert j.count() == 300 * 200 == j.select("id", "sid").distinct().count()
    used = j.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(used) >= 10 and max(r["count"] for r in used) <= 300 * 200 / 5
    some = jn.within_km(a, b, 0.4, F.col("id") < F.col("sid"), pairs_per_task=2000)
    assert {(r.id, r.sid) for r in some.collect()} == {(p[0], q[0]) for p in pts for q in places if p[0] < q[0] and km(p, q) <= 0.4}


def test_nearest_of_a_dense_place_looks_at_few_pairs(spark, monkeypatch):
    """The first radius follows the density; many right rows at one place count once for each wanted neighbour."""
    pts, places = crowd(300, 3), crowd(400, 4) + [(1000 + i, 52.005, 13.005) for i in range(500)]
    a, b = spark.createDataFrame(pts, "id int, lat double, lon double"), spark.createDataFrame(places, "sid int, lat double, lon double")
    seen, plain = [], jn.within_km
    monkeypatch.setattr(jn, "PAIRS_PER_TASK", 1000)

    def counted(*x, **y):
        j = plain(*x, **y)
        seen.append(j.count())
        return j

    monkeypatch.setattr(jn, "within_km", counted)
    got = {}
    for r in jn.nearest_k(a, b, "id", "sid", 5.0, 2).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.sid
    for p in pts:
        want = sorted((km(p, q), q[0]) for q in places)[:2]
        assert [got[p[0]][i] for i in (1, 2)] == [sid for _, sid in want]
    assert sum(seen) < 300 * 900 / 5
