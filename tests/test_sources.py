"""Mixed folders, versioned ingest, streamed merges, alerts in event time, model snapshots."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flowspark.catalog.views import register_functions
from flowspark.config import Clock
from flowspark.model import learning as ln
from flowspark.sources import folders as fo
from flowspark.sources import ingest as ing
from flowspark.sources import tables as src
from flowspark.streaming import streams as sm

SCHEMA = "station_key string, slot timestamp_ntz, day date, reading long"


def cells(spark, *rows):
    return spark.createDataFrame([(k, dt.datetime(2026, 6, d, 8), dt.date(2026, 6, d), r) for k, d, r in rows], SCHEMA)


def test_a_folder_of_four_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,value\nMühle,1.5\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("﻿value;name\n2,5;Höhe\n", encoding="utf-8")
    (tmp_path / "deep").mkdir()
    # the byte that is no UTF-8 stands far behind the first line
    (tmp_path / "deep" / "c d.csv").write_bytes("name\tvalue\n".encode() + b"x\t3.5\n" * 500 + "Größe\t4.5\n".encode("cp1252"))
    (tmp_path / "e.csv").write_bytes("value,other,name\n5.5,q,Süd\n".encode("cp1252"))
    (tmp_path / "empty.csv").write_text("")
    d = {(x.sep, x.encoding): len(x.files) for x in fo.dialects(spark, str(tmp_path))}
    assert d == {(",", "UTF-8"): 1, (";", "UTF-8"): 1, ("\t", "windows-1252"): 1, (",", "windows-1252"): 1}
    r = src.read_csv_any(spark, str(tmp_path))
    got = {(x["name"], x["value"], x["other"]) for x in r.distinct().collect()}
    assert got == {("Mühle", "1.5", None), ("Höhe", "2.5", None), ("x", "3.5", None), ("Größe", "4.5", None), ("Süd", "5.5", "q")}
    assert r.count() == 504 and fo.files(spark, str(tmp_path)).count() == 4


def test_ingest_switches_all_or_nothing(spark, tmp_path):
    table = ing.VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["station_key", "slot"])
    checks = spark.createDataFrame([("f", "odd", "warning", 3)], "file string, rule string, severity string, n long")
    bad = checks.withColumn("severity", F.lit("error"))
    first = ing.ingest(table, cells(spark, ("A", 1, 5), ("B", 1, 6)), checks, "reading").collect()
    assert [(r.committed, r.version, r.rows_before, r.rows_after, r.added) for r in first] == [(True, 1, 0, 2, 2)]
    seen = table.version()

    def files():
        return sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / "t").rglob("*") if p.is_file())

    before = files()
    new = cells(spark, ("A", 1, 7), ("A", 2, 1))
    refused = ing.ingest(table, new, bad, "reading").collect()
    assert [(r.accepted, r.committed, r.errors, r.day) for r in refused] == [(False, False, 3, None)] and files() == before
    broken = new.withColumn("reading", F.when(F.col("day") == dt.date(2026, 6, 2), F.raise_error(F.lit("torn file")).cast("long")).otherwise(F.col("reading")))
    with pytest.raises(Exception, match="torn file"):
        ing.ingest(table, broken, checks, "reading")
    assert table.version() == seen and {(r.station_key, r.reading) for r in table.read().collect()} == {("A", 5), ("B", 6)}
    dry = ing.ingest(table, new, checks, "reading", dry_run=True).collect()
    assert {(str(r.day), r.replaced, r.added, r.changed, r.sum_before, r.sum_after) for r in dry} == {("2026-06-01", 1, 0, 1, 11, 13), ("2026-06-02", 0, 1, 0, None, 1)}
    assert table.version() == seen
    ing.ingest(table, new, checks, "reading").collect()
    assert {(r.station_key, r.reading) for r in table.read().collect()} == {("A", 7), ("A", 1), ("B", 6)}
    assert {(r.station_key, r.reading) for r in table.read(table.version(1)).collect()} == {("A", 5), ("B", 6)}
    with pytest.raises(RuntimeError, match="another writer"):
        table.commit(seen, seen.batches)


def test_replayed_micro_batches_are_merged_once(spark, tmp_path):
    table = ing.VersionedTable(spark, str(tmp_path / "t"), "id long, day date, v long, ver long", ["id"], newest="ver")
    rows = lambda *r: spark.createDataFrame([(i, dt.date(2026, 6, 1), v, n) for i, v, n in r], "id long, day date, v long, ver long")
    rows((1, 10, 2), (2, 20, 1)).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows((1, 11, 1), (2, 22, 5), (3, 30, 1), (3, 30, 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id long, day date, v long, ver long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sm.upsert_stream(s, table, str(tmp_path / "ck"))
    n = len(table.version().batches)
    sm.upsert_stream(s, table, str(tmp_path / "lost"))  # the stream's own log was lost: every batch comes again
    assert len(table.version().batches) == n
    assert {(r.id, r.v) for r in table.read().collect()} == {(1, 10), (2, 22), (3, 30)}


def test_alert_steps_against_the_rules():
    rng = random.Random(8)
    rows = [(op, op * 900, rng.randrange(3), 0.5, 1.5) for op in range(300) if rng.random() < 0.9]
    _, fired = sm.alert_steps((-10, 0, 0, sm._FAR, sm._FAR, sm._FAR), rows, 4, 80)
    at = {r[0]: r for r in rows}
    above = lambda op, q: op in at and at[op][2] > at[op][q]
    want = []
    for rule, q, run in (("R1", 3, 2), ("R2", 3, 3), ("R3", 4, 2)):
        last = -(10**9)
        for op in sorted(at):
            if all(above(op - i, q) and (op - i) // 80 == op // 80 for i in range(run)):
                if op - last > 4:
                    want.append((rule, op * 900))
                last = op
    assert sorted(fired) == sorted(want) and len(want) > 10


def test_table_function_edges(spark):
    register_functions(spark, Clock())
    q = "SELECT count(s.slot) FROM VALUES (TIMESTAMP_NTZ'{}', {}) t(a, b) LEFT JOIN LATERAL service_slots(t.a, t.b) s"
    n = lambda a, b: spark.sql(q.format(a, b)).first()[0]
    assert n("2026-06-10 08:05:00", "TIMESTAMP_NTZ'2026-06-10 09:00:00'") == 3 and n("2026-06-10 00:30:00", "TIMESTAMP_NTZ'2026-06-10 05:15:00'") == 3
    assert n("2026-06-10 09:00:00", "TIMESTAMP_NTZ'2026-06-10 08:00:00'") == 0 and n("2026-06-10 09:00:00", "CAST(NULL AS TIMESTAMP_NTZ)") == 0


def test_snapshots_by_number(spark, tmp_path):
    store = ln.ModelStore(spark, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        store.load()
    shot = lambda w: ln.Snapshot(
        spark.createDataFrame([("A", w, 10.0)], "station_key string, w double, ceiling double"), spark.createDataFrame([], "venue_key string, station_key string, share double, method string"),
        spark.createDataFrame([("heat", -0.01)], "name string, value double"), spark.createDataFrame([(dt.datetime(2026, 6, 1), dt.datetime(2026, 6, 9, 8), 1, 2)], "first_slot timestamp_ntz, last_slot timestamp_ntz, events long, closures long"))
    assert store.save(shot(1.0)) == 1 and store.save(shot(1.2)) == 2
    assert store.load(1).stations.first().w == 1.0 and store.load().stations.first().w == 1.2
    empty = spark.createDataFrame([], "venue_key string, start timestamp_ntz")
    risk = spark.createDataFrame([(dt.date(2026, 6, 10), 90, 100.0), (dt.date(2026, 6, 9), 1, 1.0)], "day date, reading long, expected double")
    r = ln.learning_report(store.load(1), store.load(), spark.createDataFrame([], "venue_key string, station_key string, share double"), empty, risk).collect()
    assert {(x.section, x.item) for x in r} == {("station level", "A"), ("weather rule", "heat"), ("new day", "2026-06-10"), ("added", "events"), ("added", "closures")}
    assert next(x.change for x in r if x.section == "station level") == pytest.approx(20.0)
