"""A sample of the registered calls against their SQL twins on the smallest folder; streams against batch."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, norm

DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "a1_flow_window_total", "a2_typical_night_wrap", "a4_compare_to_weeks", "a6_station_window", "a17_peak_time", "a23_energy_allocation", "j3_closed_cells",
    "j6_close_stop_pairs", "j9_resolve_names", "w3_alert_episodes", "w5_rain_episodes", "m3_station_weights", "r4_expected", "r6_action_plan", "e12_routing_test",
    "n4_fragmentation", "n5_routes", "n9_timetable_edges", "s17_grain", "t2_stream_slot_totals", "t4_stream_alerts", "t6_stream_sessions",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, duck, name):
    df = queries()[name](spark, DIR)
    cols = sorted(df.columns)
    cur = duck.execute(oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    assert norm(tuple(r[c] for c in cols) for r in df.collect()) == norm(tuple(r[i] for i in idx) for r in cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_call_has_a_known_column_list():
    assert set(oracle_sql()) <= set(queries())
