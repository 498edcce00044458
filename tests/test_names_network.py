"""Close names against all pairs, the multimodal build, batched route deviations and grams of texts against plain Python."""

import random
from difflib import SequenceMatcher

import pytest

from flowspark.functions import text as tx
from flowspark.operators import joins as jn

RNG = random.Random(3)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("measure, cutoff", [("edits", 0.75), ("blocks", 0.75), ("blocks", 0.92), ("edits", 0.9)])
def test_close_names_equal_all_pairs(spark, measure, cutoff):
    words = {"".join(RNG.choice("abc ") for _ in range(RNG.randint(1, 14))) for _ in range(60)} | {"zoologischer garten", "oologischer garten", "zoologischer gartn", "u", "s", "ab", "ba"}
    words |= {w[1:] for w in list(words)[:20]} | {w[:3] + "x" + w[3:] for w in list(words)[:20]}
    words = sorted(w for w in words if w)
    score = (lambda a, b: 1 - edits(a, b) / max(len(a), len(b))) if measure == "edits" else (lambda a, b: SequenceMatcher(None, b, a, autojunk=False).ratio())
    want = {(a, b): score(a, b) for a in words for b in words if a != b and score(a, b) >= cutoff}
    df = spark.createDataFrame([(w,) for w in words], "lk string")
    got = {(r.lk, r.rk): r.score for r in jn.close_names(df, df.withColumnRenamed("lk", "rk"), cutoff, measure).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 10


def test_a_typo_in_the_first_letter_is_found(spark):
    st = spark.createDataFrame([("a", "Alexanderplatz"), ("b", "Hermannplatz")], "station_key string, name string")
    r = jn.resolve_names(spark.createDataFrame([("Elexanderplatz",)], "request string"), st).first()
    assert (r.match_kind, r.station_key) == ("close", "a")


def test_name_keys_by_effect(spark):
    cases = {  # name: engine key, tool key, display
        "S+U Bahnhof Zoologischer Garten": ("zoologischer garten", "zoologischergarten"), "U Kochstr. (Berlin)": ("kochstr", "kochstr"), "Görlitzer Bahnhof": ("gorlitzer bahnhof", "goerlitzer"),
        "U Stadtmitte (U2)": ("stadtmitte (u2)", "stadtmitteu2"), "Große Hamburger Straße Bhf": ("grosse hamburger str", "grossehamburgerstr"), "S Wannsee Bhf (Berlin)": ("s wannsee", "wannsee"), "": ("", ""),
    }
    d = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r[0]: (r[1], r[2]) for r in d.select("n", tx.name_key("n"), tx.compact_key("n")).collect()} == cases
    shown = {"S+U Zoologischer Garten Bhf (Berlin)": "S+U Zoologischer Garten", "Berlin, Am Markt [Gleis 1]": "Am Markt", "Potsdam Bhf/Nord": "Potsdam/Nord", "Bhf Zoo": "Bhf Zoo", "A  B": "A B"}
    d = spark.createDataFrame([(k,) for k in shown], "n string")
    assert {r[0]: r[1] for r in d.select("n", tx.display_name("n")).collect()} == shown


def test_paths_of_a_grid_without_listing_them(spark):
    """A grid has hundreds of thousands of shortest paths between its corners; three are found by deviations."""
    from flowspark.operators import graph as g

    size = 11
    name = lambda x, y: f"{x:02d}{y:02d}"
    pairs = [(name(x, y), name(x + dx, y + dy)) for x in range(size) for y in range(size) for dx, dy in ((1, 0), (0, 1)) if x + dx < size and y + dy < size]
    e = spark.createDataFrame(pairs, "src string, dst string")
    od = spark.createDataFrame([("c", name(0, 0), name(size - 1, size - 1)), ("n", name(3, 3), name(3, 4))], "od_id string, origin string, destination string")
    got = {(r.od_id, r["rank"]): r.path for r in g.k_simple_paths(od, e, 3).collect()}
    first = [name(0, y) for y in range(size)] + [name(x, size - 1) for x in range(1, size)]
    assert got["c", 1] == first and all(len(got["c", r]) == 2 * size - 1 for r in (2, 3))
    assert got["c", 2] == first[: size - 1] + [name(1, size - 2), name(1, size - 1)] + first[size + 1 :]
    assert got["n", 1] == [name(3, 3), name(3, 4)] and len(got["n", 2]) == 4 and got["n", 2][1] == name(2, 3)


def test_proximity_near_poles_and_the_date_line(spark):
    import math

    rng = random.Random(9)
    pts = [(i, rng.choice([89.9, -89.95, 70.0, 0.0]) + rng.uniform(-0.05, 0.05), rng.choice([179.97, -179.97, 13.0]) + rng.uniform(-0.04, 0.04)) for i in range(150)]
    pts = [(i, la, (lo + 180) % 360 - 180) for i, la, lo in pts]

    def km(a, b):
        p = math.pi / 180
        h = math.sin((b[1] - a[1]) * p / 2) ** 2 + math.cos(a[1] * p) * math.cos(b[1] * p) * math.sin((b[2] - a[2]) * p / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    d = spark.createDataFrame(pts, "id int, lat double, lon double")
    for radius in (3.0, 800.0):
        want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and km(a, b) <= radius}
        assert want and {(r.id, r.other) for r in jn.too_close_pairs(d, "id", radius).collect()} == want
    far = spark.createDataFrame([(1, -40.0, 2.0)], "id int, lat double, lon double")
    got = jn.nearest(far, d.toDF("sid", "lat", "lon"), "id", "sid", k=2).collect()
    assert {r.sid for r in got} == {p[0] for p in sorted(pts, key=lambda b: km((0, -40.0, 2.0), b))[:2]}


def test_mentions_keep_equal_rows_and_span_blocks(spark):
    texts = spark.createDataFrame([(1, "old town hall"), (1, "old town hall"), (2, None), (3, "")], "id int, text string")
    al = spark.createDataFrame([("old town",), ("old town hall",), ("town",), ("hall",)], "alias string")
    for size in (200_000, 1, 2):
        got = sorted((r.id, r.alias, r.pos) for r in jn.mentions(texts, al, block_aliases=size).collect())
        assert got == sorted([(1, "old town hall", 1), (1, "town", 5), (1, "hall", 10)] * 2)
    every = [(r.alias, r.pos) for r in jn.mentions(texts.limit(1), al, longest=False).collect()]
    assert sorted(every) == [("hall", 10), ("old town", 1), ("old town hall", 1), ("town", 5)]
