"""Clock, noise law, interval and text joins, windows, sources."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from flowspark.config import Clock, ModelParams
from flowspark.functions import noise
from flowspark.functions import text as tx
from flowspark.functions import time as t
from flowspark.operators import joins as jn
from flowspark.operators import textaudit as ta
from flowspark.operators import windows as win
from flowspark.sources import quality as q
from flowspark.sources import tables as src


def ts(spark, *stamps):
    return spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp_ntz").alias("ts"))


def test_service_pause_and_wrap(spark):
    d = ts(spark, "2026-06-10 00:59", "2026-06-10 01:00", "2026-06-10 04:44", "2026-06-10 04:45")
    assert [r[0] for r in d.select(t.service_running("ts")).collect()] == [True, False, False, True]
    d = ts(spark, "2026-06-10 21:45", "2026-06-10 22:00", "2026-06-11 00:45", "2026-06-11 05:00")
    assert [r[0] for r in d.select(t.time_mask("ts", "22:00", "01:00")).collect()] == [False, True, True, False]
    assert str(d.select(t.service_day("ts")).collect()[2][0]) == "2026-06-10"


def test_day_type_holidays_and_arguments(spark):
    d = ts(spark, "2026-06-12 08:00", "2026-06-13 08:00", "2026-06-14 08:00", "2026-05-25 08:00").select(t.service_day("ts").alias("day"))
    clock = Clock(holidays=("2026-05-25",))
    assert [r[0] for r in d.select(t.day_type("day", clock)).collect()] == [0, 1, 2, 2]
    with pytest.raises(ValueError):
        t.hour_window("ts", 9, 9)
    with pytest.raises(ValueError):
        t.day_mask(days="someday")


def test_slot_numbers_round_trip(spark):
    d = ts(spark, "2026-06-10 23:59:59", "1969-12-31 23:45:00")
    r = d.select(t.slot_from_no(t.slot_no("ts")), t.slot_floor("ts")).collect()
    assert all(a == b for a, b in r)


def test_reading_law(spark):
    r = spark.range(1).select(F.lit(100.0).alias("l"), F.lit(50).alias("c")).select(
        noise.p_ceiling("l", "c"), noise.expected_reading("l", "c"), noise.quantile("l", "c", 0.1), noise.quantile("l", "c", 0.95)).first()
    p = math.exp(-0.5)
    assert r[0] == pytest.approx(p) and r[1] == pytest.approx(100 * (1 - p) - 0.5) and r[2] == 10 and r[3] == 50


def test_kernel_sums(spark):
    e = spark.createDataFrame([(1, "V", dt.datetime(2026, 6, 10, 20), dt.datetime(2026, 6, 10, 23), 1000)], "crowd_id int, venue_key string, start timestamp_ntz, end timestamp_ntz, attendance int")
    r = {x["phase"]: x["s"] for x in jn.kernel_load(e).groupBy("phase").agg(F.sum("load").alias("s")).collect()}
    assert r["arrival"] == pytest.approx(583) and r["departure"] == pytest.approx(548)


def closure(spark, start, end):
    return spark.createDataFrame([(1, "station", ["A"], start, end)], "closure_id int, kind string, stations array<string>, start timestamp_ntz, end timestamp_ntz")


def test_closed_slots_half_open_and_reopening(spark):
    c = closure(spark, dt.datetime(2026, 6, 10, 8, 5), dt.datetime(2026, 6, 10, 9, 5))
    s = sorted(r["slot"].strftime("%H:%M") for r in jn.closed_slots(c).collect())
    assert s == ["08:15", "08:30", "08:45", "09:00"]
    a = sorted(r["slot"].strftime("%H:%M") for r in jn.after_reopening(c, 3).collect())
    assert a == ["09:15", "09:30", "09:45"]


def test_proximity_join_equals_brute_force(spark):
    pts = [(i, 52.4 + (i * 37 % 101) * 0.001, 13.2 + (i * 53 % 97) * 0.0013) for i in range(120)]
    d = spark.createDataFrame(pts, "id int, lat double, lon double")

    def km(a, b):
        p = math.pi / 180
        h = math.sin((b[1] - a[1]) * p / 2) ** 2 + math.cos(a[1] * p) * math.cos(b[1] * p) * math.sin((b[2] - a[2]) * p / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and km(a, b) <= 1.3}
    assert {(r["id"], r["other"]) for r in jn.too_close_pairs(d, "id", 1.3).collect()} == want
    far = spark.createDataFrame([(1, 40.0, 2.0)], "id int, lat double, lon double")
    n = jn.nearest(far, d.toDF("sid", "lat", "lon"), "id", "sid").first()
    assert n["sid"] == min(pts, key=lambda b: km((0, 40.0, 2.0), b))[0]


def test_mentions_strategies_agree(spark):
    texts = spark.createDataFrame([(1, "Zoo and zoo garten, Zoogarten"), (2, "nothing"), (3, "garten zoo")], "id int, text string")
    al = spark.createDataFrame([("zoo",), ("zoo garten",), ("garten",)], "alias string")
    a = {tuple(r) for r in jn.mentions(texts, al).select("id", "alias", "pos").collect()}
    b = {tuple(r) for r in jn.mentions(texts, al, block_aliases=1).select("id", "alias", "pos").collect()}
    assert a == b and (1, "zoo", 1) in a and (1, "zoo garten", 9) in a
    w = {tuple(r) for r in jn.mentions(texts, al, word_bounded=True).select("id", "alias", "pos").collect()}
    w2 = {tuple(r) for r in jn.mentions(texts, al, word_bounded=True, block_aliases=1).select("id", "alias", "pos").collect()}
    assert w == w2 and not any(p == 21 for _, _, p in w)


def test_name_keys(spark):
    d = spark.createDataFrame([("S+U Bahnhof Zoologischer Garten",), ("Zoologischer Garten Bhf (Berlin)",)], "n string")
    assert len({r[0] for r in d.select(tx.name_key("n")).collect()}) == 1
    assert len({r[0] for r in d.select(tx.compact_key("n")).collect()}) == 1


def test_alert_rules_and_islands(spark):
    base = dt.datetime(2026, 6, 10, 5)
    rows = [("A", base + dt.timedelta(minutes=15 * k), dt.date(2026, 6, 10), k, 0, r, 10.0, 100.0, 5.0) for k, r in ((0, 20), (1, 20), (2, 1), (3, 20), (8, 20))]
    c = spark.createDataFrame(rows, "station_key string, slot timestamp_ntz, day date, tod int, daytype int, reading int, q95 double, q99 double, expected double")
    f = win.long_rules(win.alert_rules(c)).filter("rule = 'R1'").collect()
    assert [r["tod"] for r in f] == [1]
    x = spark.createDataFrame([(3,), (4,), (6,), (9,)], "i int").withColumn("k", F.lit(1))
    g = win.islands(x, ["k"], "i", 2).groupBy("island").agg(F.array_sort(F.collect_list("i")).alias("m")).collect()
    assert sorted(r["m"] for r in g) == [[3, 4, 6], [9]]


def test_tolerant_csv(spark, tmp_path):
    p = tmp_path / "closures_a.csv"
    p.write_text('﻿when;duration;description\n6/10/2026 8:00;3h30min;Station JannowitzbrÃ¼cke closed\n"6/11/2026 9:00;45min;Station B closed"\n', encoding="utf-8")
    r = sorted(src.read_closures(spark, str(p)).select("start", "end", "description").collect())
    assert [x["description"] for x in r] == ["Station Jannowitzbrücke closed", "Station B closed"]
    assert r[0]["end"] - r[0]["start"] == dt.timedelta(minutes=210) and r[1]["end"] - r[1]["start"] == dt.timedelta(minutes=45)


def test_headerless_events_and_default_end(spark, tmp_path):
    p = tmp_path / "berlin_events.csv"
    p.write_text("Show,2026-06-10T20:00:00+02:00,,Hall,Street 1 ,B,DE,Music,Rock,text,1200,http://x\n", encoding="utf-8")
    r = src.read_events(spark, str(p)).first()
    assert r["start"] == dt.datetime(2026, 6, 10, 20) and r["end"] == dt.datetime(2026, 6, 10, 23) and r["attendance"] == 1200


def test_wide_counters_and_last_wins(spark, tmp_path):
    (tmp_path / "flows1.csv").write_text("t,A,B,A.1\n6/10/2026 5:00,1,2,3\n6/10/2026 5:15,4,5,6\n")
    names = spark.createDataFrame([("A", 0, "A (U2)"), ("B", 0, "B"), ("A", 1, "A (U6)")], "header string, occurrence int, station_key string")
    long = src.wide_to_long(src.read_csv_any(spark, str(tmp_path)), "t", names)
    assert long.count() == 6 and long.filter("station_key = 'A (U6)'").agg(F.sum("reading")).first()[0] == 9


def test_ingest_is_all_or_nothing(spark, tmp_path):
    st = spark.createDataFrame([("A",)], "station_key string")
    raw = spark.createDataFrame([("f", "A", "2026-06-10 05:00:00", "3"), ("f", "Z", "x", "-1")], "file string, station_key string, ts string, value string")
    rep = q.validate_readings(raw, st)
    assert {r["rule"] for r in rep.collect()} == {"unparsable timestamp", "unknown station", "negative"}
    new = raw.limit(1).select("station_key", F.lit(dt.date(2026, 6, 10)).alias("day"))
    assert q.ingest(new, rep, str(tmp_path / "t"), ["station_key"], []) is False
    assert q.ingest(new, q.validate_readings(raw.filter("station_key = 'A'"), st), str(tmp_path / "t"), ["station_key"], []) is True
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_figures_and_checks(spark):
    text = "On 2026-06-10 the line U2 had 1,234 riders, 12.5 % more; `999` at 08:15. 3 changes, about 450 km"
    d = spark.createDataFrame([(1, text)], "id int, text string")
    f = ta.figures(d, ["id"])
    got = {(r["kind"], r["value"], r["unit"]) for r in f.collect()}
    assert got == {("number", 1234.0, ""), ("number", 12.5, "%"), ("time", 495.0, "hh:mm"), ("number", 450.0, "km")}
    figs = f.filter("kind = 'number'").withColumn("fig_id", F.col("raw"))
    facts = spark.createDataFrame([(1, "p", 1234.2), (1, "p", 0.125), (1, "q", 900.0), (1, "q", 450.0)], "id int, parent string, number double")
    s = {r["value"]: r["status"] for r in ta.check_figures(figs, facts, "id").collect()}
    assert s == {1234.0: "verified", 12.5: "verified", 450.0: "verified"}
    s = {r["value"]: r["status"] for r in ta.check_figures(figs, facts.filter("number <> 450").union(spark.createDataFrame([(1, "q", 1350.0)], facts.schema)), "id").collect()}
    assert s[450.0] == "calculated"


def test_figures_with_something_attached(spark):
    """Currency signs, tildes, hyphens, dashes and clock times inside a word; by the reference only ranges of minutes are skipped."""
    texts = {
        "costs $500 or 50€ now": {500.0, 50.0}, "~500 people, **450** km": {500.0, 450.0}, "a 500-seat hall": {500.0}, "at 3:20pm": {200.0},
        "from 9:30-10:15 on": {570.0, 615.0}, "9:30–10:15": {570.0, 615.0}, "12-15 stations": {12.0}, "12–15 stations": {12.0, 15.0}, "12-15 minutes": set(), "12 – 15 min late": set(),
        "a 15-minute slot of 15 min": set(), "2019–2021 and 1999-2004": set(), "-500 and (+20) or −30": {-500.0, 20.0, -30.0}, "x-500, U12, 500kg, 500/day": set(),
        "see https://a.b/500-600 [12] 2026-06-10": set(), "1,234.5 km; 12,345": {1234.5, 12345.0}, "500+ guests": {500.0}, "12.5%, 20 %": {12.5, 20.0}, "35°C and 3×": {35.0, 3.0}, "1. first\n20) second": set(),
    }
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {t: set() for t in texts}
    for r in ta.figures(d, ["id"]).collect():
        got[list(texts)[r["id"]]].add(r["value"])
    assert got == texts


def test_flatten_json(spark):
    d = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": 2.5}]}, "d": "x"}')], "id int, j string")
    r = {(x["path"], x["value"]) for x in ta.flatten_json(d, "id", "j", 4).collect()}
    assert r == {("a.b.[0]", "1"), ("a.b.[1].c", "2.5"), ("d", "x")}


def test_windows_encoded_file(spark, tmp_path):
    p = tmp_path / "closures_b.csv"
    p.write_bytes("when,duration,description – café\n6/10/2026 8:00,1h,Möckern – „Süd“\n".encode("cp1252"))
    r = src.read_csv_any(spark, str(p)).first()
    assert r[2] == "Möckern – „Süd“"


def test_text_repair_leaves_sound_text(spark):
    d = spark.createDataFrame([("JannowitzbrÃ¼cke",), ("Brücke",), ("ÂµÃ 日本",), (None,)], "s string")
    assert [r[0] for r in d.select(tx.repair("s")).collect()] == ["Jannowitzbrücke", "Brücke", "ÂµÃ 日本", None]
