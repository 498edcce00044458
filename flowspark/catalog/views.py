"""The network and the operator calls by name in SQL: temporary views and SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from flowspark.bindings import Net
from flowspark.catalog import stats as _stats  # noqa: F401  (defines shared expressions)
from flowspark.catalog.registry import ENTRIES, register, run
from flowspark.config import DEFAULT_CLOCK, Clock

TABLES = ("flows", "flow_days", "spine", "dense", "weather", "crowd_events", "venues", "closures", "suspensions", "stations", "line_stops", "edges", "daily_station", "energy", "stops", "homes", "stop_times")


def register_functions(spark: SparkSession, clock: Clock = DEFAULT_CLOCK) -> None:
    """SQL functions of the network's clock. They are expanded into the query's plan, so nothing leaves the JVM.

    ``slot_floor(ts)``, ``service_day(ts)``, ``slot_of_day(ts)`` and ``in_service(ts)`` are scalar. ``service_slots(a, b)`` is a table function, to be
    joined by LATERAL: the slots (slot, day, tod) in service from ``a`` on and before ``b``; none if ``b`` is not after ``a`` or either is null.
    """
    m, start, per_day = clock.slot_minutes, clock.service_start_hour, clock.slots_per_day
    ts = "TIMESTAMP_NTZ"
    floor = f"CAST(to_date(ts) AS {ts}) + make_dt_interval(0, hour(ts), minute(ts) - minute(ts) % {m})"
    tod = f"CAST(floor(pmod(hour(ts) * 60 + minute(ts) - {60 * start}, 1440) / {m}) AS INT)"
    scalar = {
        "slot_floor": (ts, floor), "slot_ceil": (ts, f"CASE WHEN {floor} = ts THEN ts ELSE {floor} + INTERVAL {m} MINUTES END"),
        "service_day": ("DATE", f"to_date(ts - INTERVAL {start} HOURS)"), "slot_of_day": ("INT", tod), "in_service": ("BOOLEAN", f"{tod} < {per_day}"),
    }
    for name, (kind, body) in scalar.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(ts {ts}) RETURNS {kind} RETURN {body}")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION service_slots(a {ts}, b {ts}) RETURNS TABLE (slot {ts}, day DATE, tod INT) RETURN
        SELECT s, service_day(s), slot_of_day(s) FROM (
            SELECT explode(CASE WHEN hi > lo THEN sequence(lo, hi - INTERVAL {m} MINUTES, INTERVAL {m} MINUTES) END) AS s FROM (SELECT slot_ceil(a) AS lo, slot_ceil(b) AS hi))
        WHERE in_service(s)""")


def register_views(n: Net, calls: tuple[str, ...] = ()) -> None:
    """Temporary views of the network's tables, and of the named operator calls that take no parameters."""
    for name in TABLES:
        getattr(n, name).createOrReplaceTempView(name)
    for name in calls:
        run(ENTRIES[name], n.spark, n.sf_dir).createOrReplaceTempView(name)
    register_functions(n.spark, n.clock)


CEIL = 'CASE WHEN time_bucket(INTERVAL 15 MINUTE,{0})={0} THEN {0} ELSE time_bucket(INTERVAL 15 MINUTE,{0})+INTERVAL 15 MINUTE END'


@register("y4_service_slots", "closure_id:i slot:t day:d tod:i", ctes="closures", sql=f"""
SELECT closure_id, s AS slot, CAST(s-INTERVAL 5 HOUR AS DATE) AS day, ((hour(s)*60+minute(s)+1140)%1440)//15 tod FROM (SELECT closure_id, unnest(generate_series({CEIL.format('start')}, {CEIL.format('"end"')}-INTERVAL 15 MINUTE, INTERVAL 15 MINUTE)) s FROM closures) WHERE hour(s)>=5 OR hour(s)=0""")
def _(n):
    """The table function in a query written in SQL alone."""
    register_views(n)
    return n.spark.sql("SELECT c.closure_id, s.slot, s.day, s.tod FROM closures c, LATERAL service_slots(c.start, c.`end`) s")


@register("y1_sql_names", "station_key day:d daytype:i total:i peak:i ceiling:i", ctes="fd caps", sql="SELECT f.station_key, day, daytype, sum(reading) total, max(reading) peak, any_value(ceiling) ceiling FROM fd f JOIN caps USING(station_key) WHERE tod>=8 GROUP BY 1,2,3")
def _(n):
    """Tables, clock functions and the result of another operator call, all by name."""
    register_views(n, ("m1_ceilings",))
    return n.spark.sql("""
        SELECT f.station_key, service_day(f.slot) AS day, any_value(s.daytype) AS daytype, sum(f.reading) AS total, max(f.reading) AS peak, any_value(c.ceiling) AS ceiling
        FROM flows f JOIN spine s ON s.slot = f.slot JOIN m1_ceilings c ON c.station_key = f.station_key
        WHERE slot_of_day(f.slot) >= 8 AND in_service(f.slot) GROUP BY f.station_key, service_day(f.slot)""")
