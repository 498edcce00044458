"""Checks on incoming files and the all-or-nothing ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock
from flowspark.functions import time as t

ERRORS = ("unparsable timestamp", "unknown station", "non-numeric", "negative", "unknown line", "off grid")


def dataset_kind(columns: list[str], file_name: str = "") -> str:
    """Kind of a file by name prefix, else by its columns, else wide counters."""
    n = file_name.lower()
    for stem, kind in (("flow", "flows"), ("weather", "weather"), ("closure", "closures"), ("energy", "energy")):
        if n.startswith(stem):
            return kind
    if "event" in n:
        return "events"
    c = {x.lower() for x in columns}
    if {"temp", "prcp"} <= c:
        return "weather"
    if {"when", "duration", "description"} <= c:
        return "closures"
    if {"event_name", "address"} <= c:
        return "events"
    return "flows" if len(columns) > 100 else "energy" if len(columns) > 1 else "unknown"


def grain(cells: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Per station: modal step in minutes, repeated slots, missing service slots between its first and last slot."""
    n = cells.groupBy("station_key", t.slot_no("slot", clock).alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("slot").alias("slot"))
    w = Window.partitionBy("station_key", F.floor(F.col("n") / clock.calendar_slots)).orderBy("n")
    n = n.withColumn("step", (F.col("n") - F.lag("n").over(w)) * clock.slot_minutes)
    steps = n.groupBy("station_key", "step").agg(F.count(F.lit(1)).alias("c")).filter("step IS NOT NULL")
    modal = steps.groupBy("station_key").agg(F.max_by("step", F.struct("c", -F.col("step"))).alias("modal_step"))
    g = n.groupBy("station_key").agg(F.sum(F.col("k") - 1).alias("duplicates"), F.count_if(t.in_service("slot", clock)).alias("present"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    span = (F.unix_date(t.service_day("hi", clock)) - F.unix_date(t.service_day("lo", clock))) * clock.slots_per_day + t.tod("hi", clock) - t.tod("lo", clock) + 1
    return g.join(modal, "station_key", "left").select("station_key", "modal_step", "duplicates", (span - F.col("present")).alias("missing"))


def validate_readings(rows: DataFrame, stations: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Rule counts for raw counter rows (file, station_key, ts text, value text) in one pass per file."""
    known = stations.select("station_key", F.lit(True).alias("_k"))
    r = rows.join(known, "station_key", "left").withColumn("_ts", F.try_to_timestamp("ts").cast("timestamp_ntz")).withColumn("_v", F.col("value").try_cast("double"))
    off = F.col("_ts").isNotNull() & (t.slot_floor("_ts", clock) != F.col("_ts"))
    checks = {
        "unparsable timestamp": F.col("_ts").isNull(), "unknown station": F.col("_k").isNull(), "non-numeric": F.col("_v").isNull() & F.col("value").isNotNull(),
        "negative": F.coalesce(F.col("_v") < 0, F.lit(False)), "off grid": off, "missing value": F.col("value").isNull(),
    }
    g = r.groupBy("file").agg(*[F.struct(F.count_if(c).alias("n"), F.min(F.when(c, F.coalesce("ts", "value", "station_key"))).alias("sample")).alias(k) for k, c in checks.items()])
    arr = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit("error" if k in ERRORS else "warning").alias("severity"), F.col(f"`{k}`.n").alias("n"), F.col(f"`{k}`.sample").alias("sample")) for k in checks])
    return g.select("file", F.explode(arr).alias("x")).select("file", "x.*").filter("n > 0")


def rule_counts(rows: DataFrame, rules: dict[str, tuple[str, object, object]], by: tuple[str, ...] = ("file",)) -> DataFrame:
    """(file, rule, severity, n, sample) of the rules {name: (severity, condition, sample)} that some row breaks, in one pass."""
    n = {k: F.struct(F.count_if(F.coalesce(c, F.lit(False))).alias("n"), F.min(F.when(c, sample.cast("string"))).alias("sample")).alias(k) for k, (_, c, sample) in rules.items()}
    g = rows.groupBy(*by).agg(*n.values())
    arr = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(v[0]).alias("severity"), F.col(f"`{k}`.n").alias("n"), F.col(f"`{k}`.sample").alias("sample")) for k, v in rules.items()])
    return g.select(*by, F.explode(arr).alias("x")).select(*by, "x.*").filter("n > 0")


def validate_weather(rows: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Rules for raw weather rows (file, ts, temp, prcp as text): a bad time is an error, a missing value or an odd time a warning."""
    r = rows.withColumn("_t", F.try_to_timestamp("ts").cast("timestamp_ntz"))
    number = lambda c: F.col(c).try_cast("double")
    return rule_counts(r, {
        "unparsable timestamp": ("error", F.col("_t").isNull(), F.coalesce("ts", F.lit(""))), "off grid": ("warning", t.slot_floor("_t", clock) != F.col("_t"), F.col("ts")),
        "no temperature": ("warning", number("temp").isNull(), F.col("ts")), "no precipitation": ("warning", number("prcp").isNull(), F.col("ts")),
        "negative precipitation": ("error", number("prcp") < 0, F.col("ts")),
    })


def validate_energy(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rules for raw energy rows (file, day, line, value as text) against the known lines (line)."""
    known = lines.select("line", F.lit(True).alias("_k")).distinct()
    r = rows.join(known, "line", "left").withColumn("_v", F.col("value").try_cast("double"))
    return rule_counts(r, {
        "unparsable date": ("error", F.try_to_timestamp("day").isNull(), F.coalesce("day", F.lit(""))), "unknown line": ("error", F.col("_k").isNull(), F.col("line")),
        "empty or non-numeric": ("warning", F.col("_v").isNull(), F.coalesce("value", F.lit(""))), "negative": ("warning", F.col("_v") < 0, F.col("value")),
    })


def validate_closure_rows(rows: DataFrame, stations: DataFrame, line_stops: DataFrame) -> DataFrame:
    """Rules for raw closure rows (file, when, duration, description): bad times and durations are errors, texts that are not understood warnings."""
    from flowspark.functions import text as tx
    from flowspark.operators.closures import parse_closures

    r = rows.withColumn("closure_id", F.monotonically_increasing_id())
    r = parse_closures(r, stations, line_stops)
    length = tx.duration_minutes("duration")
    return rule_counts(r, {
        "unparsable start": ("error", F.try_to_timestamp("when").isNull(), F.coalesce("when", F.lit(""))), "unparsable duration": ("error", F.coalesce(length, F.lit(0)) <= 0, F.coalesce("duration", F.lit(""))),
        "not understood": ("warning", (F.col("kind") == "unknown") | (F.size("issues") > 0), F.col("description")),
    })


def validate_events(events: DataFrame, venues: DataFrame, max_attendance: int = 5000) -> DataFrame:
    """Warnings for crowd events: venue not located, implausible attendance, end before start."""
    e = events.join(venues.select("venue_key", F.lit(True).alias("_v")), "venue_key", "left")
    checks = {"unlocated venue": F.col("_v").isNull(), "attendance above limit": F.col("attendance") > max_attendance, "ends before start": F.col("end") <= F.col("start")}
    g = e.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    arr = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit("warning").alias("severity"), F.col(f"`{k}`").alias("n")) for k in checks])
    return g.select(F.explode(arr).alias("x")).select("x.*")


def validate_closures(parsed: DataFrame) -> DataFrame:
    """Closures whose text could not be understood."""
    return parsed.filter((F.col("kind") == "unknown") | (F.size("issues") > 0)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("description").alias("sample"))


def ingest(new: DataFrame, report: DataFrame, target: str, keys: list[str], order: list, dry_run: bool = False) -> bool:
    """Append new cells to a table partitioned by service day unless any file has an error.

    Returns whether the data was written; duplicates are settled on read by ``last_wins``.
    """
    if not report.filter("severity = 'error'").isEmpty():
        return False
    if not dry_run:
        new.write.mode("append").partitionBy("day").parquet(target)
    return True


def load_status(flows: DataFrame, weather: DataFrame, events: DataFrame, closures: DataFrame, venues: DataFrame) -> DataFrame:
    """Rows and time range of every loaded table, and what could not be placed."""

    def one(df, name, lo, hi, issues=None):
        return df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.min(lo).cast("timestamp_ntz").alias("first"), F.max(hi).cast("timestamp_ntz").alias("last"), (issues if issues is not None else F.lit(0)).cast("long").alias("issues"))

    e = events.join(venues.select("venue_key", F.lit(True).alias("_v")), "venue_key", "left")
    u = one(flows, "flows", "slot", "slot").unionByName(one(weather, "weather", "slot", "slot"))
    u = u.unionByName(one(e, "events", "start", "end", F.count_if(F.col("_v").isNull())))
    return u.unionByName(one(closures, "closures", "start", "end", F.count_if(F.size("stations") == 0)))
