"""Versioned model tables, what a new fit learned, and what the model says about itself.

A snapshot holds everything a fit knows in a few small tables. Two of them are compared by keyed full-outer joins, so the report covers all
stations and venues at once; no list is cut, the reader of the report takes as much of it as wanted.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock
from flowspark.functions import time as t
from flowspark.model.expect import backtest, band_coverage, calibration_by_day
from flowspark.model.fit import Fit
from flowspark.sources.ingest import Versioned

TABLES = ("stations", "shares", "weather", "info")


@dataclass(frozen=True)
class Snapshot:
    """Model tables of one fit."""

    stations: DataFrame  # station_key, w, ceiling
    shares: DataFrame  # venue_key, station_key, share, method (null: distance rule)
    weather: DataFrame  # name, value
    info: DataFrame  # first_slot, last_slot, events, closures


def take(fit: Fit, cells: DataFrame, events: DataFrame, closures: DataFrame) -> Snapshot:
    """What a fit knows, with the extent of the data it saw."""
    spark = cells.sparkSession
    if fit.learned is not None:
        how = fit.learned.select("venue_key", "method").distinct()
        shares = fit.shares.select("venue_key", "station_key", "share").join(how, "venue_key", "left")
    else:
        shares = fit.shares.select("venue_key", "station_key", "share", F.lit(None).cast("string").alias("method"))
    weather = spark.createDataFrame([(k, float(v)) for k, v in sorted(fit.weather.items())], "name string, value double")
    counts = [df.agg(F.count(F.lit(1))).scalar() for df in (events, closures)]
    info = cells.agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")).select("*", counts[0].alias("events"), counts[1].alias("closures"))
    return Snapshot(fit.stations.select("station_key", "w", F.col("ceiling").cast("double").alias("ceiling")), shares, weather, info)


class ModelStore(Versioned):
    """Snapshots by number; a snapshot is visible once its manifest is."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root)

    def save(self, s: Snapshot) -> int:
        seen = self.version()
        name = f"model-{seen.number + 1:09d}-{uuid.uuid4().hex[:8]}"
        for table in TABLES:
            getattr(s, table).write.parquet(f"{self.root}/{name}/{table}")
        return self.commit(seen, (name,)).number

    def load(self, number: int | None = None) -> Snapshot:
        """The newest snapshot, or the one with that number."""
        v = self.version(number)
        if not v.batches:
            raise ValueError("no model has been saved here")
        return Snapshot(*[self.spark.read.parquet(f"{self.root}/{v.batches[0]}/{table}") for table in TABLES])


_REPORT = ("section", "item", "part", "before", "after", "change", "note")


def _rows(df: DataFrame, section, item, part=None, before=None, after=None, change=None, note=None) -> DataFrame:
    text, number = lambda c: (F.lit(None) if c is None else c).cast("string"), lambda c: (F.lit(None) if c is None else c).cast("double")
    kinds = {"before": number, "after": number, "change": number}
    values = dict(zip(_REPORT, (section, item, part, before, after, change, note)))
    return df.select(*[kinds.get(k, text)(v).alias(k) for k, v in values.items()])


def learning_report(before: Snapshot, after: Snapshot, rule: DataFrame, events: DataFrame, risk: DataFrame, level_step: float = 0.05, share_step: float = 0.05, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """What changed from one snapshot to the next: (section, item, part, before, after, change, note).

    Sections: station levels that moved more than ``level_step``, ceilings that rose, the weather rule, crowd splits that were learned or moved more than
    ``share_step`` (venues with events after the old data's end) or stay with the distance rule ``rule``, new service days against the
    model (``risk`` of the new fit), and how many events and closures came. ``events`` holds all events of the new data.
    """
    end = before.info.select("last_slot").scalar()
    pct = (F.col("aw") / F.col("bw") - 1) * 100
    st = before.stations.select("station_key", F.col("w").alias("bw"), F.col("ceiling").alias("bc")).join(after.stations.select("station_key", F.col("w").alias("aw"), F.col("ceiling").alias("ac")), "station_key", "full_outer")
    levels = _rows(st.filter((F.col("bw") != 0) & (F.abs(pct) > 100 * level_step)), F.lit("station level"), F.col("station_key"), None, F.col("bw"), F.col("aw"), pct)
    raised = _rows(st.filter((F.col("bc") != 0) & (F.col("ac") > F.col("bc"))), F.lit("ceiling raised"), F.col("station_key"), None, F.col("bc"), F.col("ac"), F.col("ac") - F.col("bc"))
    wx = before.weather.select("name", F.col("value").alias("b")).join(after.weather.select("name", F.col("value").alias("a")), "name", "full_outer")
    weather = _rows(wx, F.lit("weather rule"), F.col("name"), None, F.col("b"), F.col("a"), F.col("a") - F.col("b"))
    # crowd splits: the old one is what was learned before, else the distance rule
    fresh = events.filter(F.col("start") > end).select("venue_key").distinct().withColumn("fresh", F.lit(True))
    old = before.shares.filter("method IS NOT NULL").select("venue_key", "station_key", F.col("share").alias("os"))
    new = after.shares.filter("method IS NOT NULL").select("venue_key", "station_key", F.col("share").alias("ns"), "method")
    was, now = old.select("venue_key").distinct().withColumn("was", F.lit(True)), new.groupBy("venue_key").agg(F.max("method").alias("how"))
    base = old.unionByName(rule.join(was, "venue_key", "left_anti").select("venue_key", "station_key", F.col("share").alias("os")))
    split = base.join(new.drop("method"), ["venue_key", "station_key"], "full_outer").join(now, "venue_key", "left").join(was, "venue_key", "left").join(fresh, "venue_key", "left")
    gap = F.abs(F.coalesce("ns", F.lit(0.0)) - F.coalesce("os", F.lit(0.0)))
    per = split.groupBy("venue_key").agg(F.max(gap).alias("gap"))
    split = split.join(per, "venue_key").withColumn("status", (
        F.when(F.col("how").isNotNull() & F.col("was").isNull(), "crowd split learned").when(F.col("how").isNotNull() & F.col("fresh").isNotNull() & (F.col("gap") > share_step), "crowd split updated")
        .when(F.col("how").isNull() & F.col("fresh").isNotNull(), "distance rule kept")
    )).filter("status IS NOT NULL")
    splits = _rows(split, F.col("status"), F.col("venue_key"), F.col("station_key"), F.col("os"), F.when(F.col("how").isNull(), F.col("os")).otherwise(F.coalesce("ns", F.lit(0.0))), F.when(F.col("how").isNotNull(), F.coalesce("ns", F.lit(0.0)) - F.coalesce("os", F.lit(0.0))), F.col("how"))
    days = calibration_by_day(risk.filter(F.col("day") > t.service_day(end, clock)))
    new_days = _rows(days, F.lit("new day"), F.col("day").cast("string"), None, F.col("expected"), F.col("observed"), F.col("ratio"))
    info = before.info.select(F.col("events").alias("be"), F.col("closures").alias("bc")).crossJoin(after.info.select(F.col("events").alias("ae"), F.col("closures").alias("ac")))  # one row each
    counts = info.select(F.explode(F.array(F.struct(F.lit("events").alias("k"), F.col("be").alias("b"), F.col("ae").alias("a")), F.struct(F.lit("closures").alias("k"), F.col("bc").alias("b"), F.col("ac").alias("a")))).alias("x")).select("x.*")
    added = _rows(counts, F.lit("added"), F.col("k"), None, F.col("b"), F.col("a"), F.col("a") - F.col("b"))
    out = levels
    for part in (raised, weather, splits, new_days, added):
        out = out.unionByName(part)
    return out


def save_report(report: DataFrame, path: str) -> None:
    """Append a learning report to the log of reports, as JSON lines."""
    report.write.mode("append").json(path)


def model_card(fit: Fit, cells: DataFrame) -> DataFrame:
    """The fitted rules in figures: (item, station_key, value)."""
    st = fit.stations.select("station_key", F.col("w"), F.col("ceiling").cast("double").alias("ceiling"))
    one = lambda df, item, value, key=None: df.select(F.lit(item).alias("item"), (F.lit(None) if key is None else key).cast("string").alias("station_key"), value.cast("double").alias("value"))
    agg = lambda item, value, key=None: one(st.agg(value.alias("v"), (F.lit(None) if key is None else key).alias("k")), item, F.col("v"), F.col("k"))
    p = fit.weather
    spark = cells.sparkSession
    import math

    rules = spark.createDataFrame([("heat effect per degree, %", (math.exp(p["heat"]) - 1) * 100), ("rain effect at most, %", (math.exp(p["rain_max"]) - 1) * 100), ("rain for half the effect, mm/h", p["rain_scale"] * math.log(2))], "item string, value double")
    out = rules.select("item", F.lit(None).cast("string").alias("station_key"), "value")
    parts = [
        agg("typical station level", F.median("w")), agg("lowest ceiling", F.min("ceiling")), agg("highest ceiling", F.max("ceiling"), F.max_by("station_key", F.struct("ceiling", "station_key"))),
        one(st.orderBy(F.col("w").desc(), "station_key").limit(7), "busiest station", F.col("w"), F.col("station_key")),
        one(cells.agg(F.count_distinct("day").alias("v")), "service days", F.col("v")),
    ]
    for part in parts:
        out = out.unionByName(part)
    return out


def reliability_report(risk: DataFrame, forecast: DataFrame) -> DataFrame:
    """Evidence that the figures can be trusted: (part, item, value) from the ranges' calibration and the backtest."""
    long = lambda df, part: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("x")).select(F.lit(part).alias("part"), "x.*")
    return long(band_coverage(forecast), "ranges").unionByName(long(backtest(risk), "backtest"))
