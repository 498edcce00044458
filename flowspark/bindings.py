"""Adapters from the test tables to the network tables the operators work on.

Each property is a lazy DataFrame. ``catalog/ctes.py`` states the same definitions in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.config import Clock, ModelParams
from flowspark.functions import time as t
from flowspark.functions.lineage import spread
from flowspark.operators.grid import service_spine

TEST_CLOCK = Clock(holidays=("2024-01-01",))


def station_of(n):
    return F.concat(F.lit("S"), F.lpad(n.cast("string"), 2, "0"))


class Net:
    """Network tables bound to one test folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.clock, self.params = TEST_CLOCK, ModelParams()

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- counters -----------------------------------------------------------------------------
    @cached_property
    def flows(self) -> DataFrame:
        """Non-empty cells (station_key, slot, reading) during service."""
        ev = self.raw("events").select(
            station_of(F.col("user_id") % 25).alias("station_key"),
            t.slot_floor("ts", self.clock).alias("slot"),
            F.round(F.col("value") * 100).cast("long").alias("v"),
        )
        return (
            ev.filter(t.in_service("slot", self.clock))
            .groupBy("station_key", "slot")
            .agg(F.sum("v").alias("reading"))
        )

    @cached_property
    def flow_days(self) -> DataFrame:
        """Non-empty cells with their calendar columns (day, tod, daytype)."""
        f = self.flows.withColumn("day", t.service_day("slot", self.clock))
        return f.withColumn("tod", t.tod("slot", self.clock)).withColumn("daytype", t.day_type("day", self.clock))

    @cached_property
    def spine(self) -> DataFrame:
        """Service slots between the first and the last full service day of the counters."""
        ext = self.raw("events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        lo = ext.select(t.service_day("lo", self.clock)).scalar()
        hi = ext.select(t.service_day("hi", self.clock)).scalar()
        return service_spine(self.spark, lo, hi, self.clock)

    @cached_property
    def dense(self) -> DataFrame:
        """Every service slot of every station; a cell without events reads 0."""
        keys = F.transform(F.sequence(F.lit(0), F.lit(24)), station_of)
        cells = self.spine.withColumn("station_key", F.explode(keys))
        return (
            cells.join(self.flows, ["station_key", "slot"], "left")
            .withColumn("reading", F.coalesce("reading", F.lit(0).cast("long")))
            .select("station_key", "slot", "day", "tod", "daytype", "reading")
        )

    # -- context ------------------------------------------------------------------------------
    @cached_property
    def weather(self) -> DataFrame:
        n = (
            self.raw("events")
            .groupBy(t.slot_floor("ts", self.clock).alias("slot"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_err"))
        )
        s = self.spine.select("slot", "day", "tod").join(n, "slot", "left").na.fill(0, ["n", "n_err"])
        return s.select(
            "slot",
            "day",
            (12 + F.hour("slot") % 12 + F.dayofmonth("day") % 7).cast("double").alias("temp"),
            (0.5 * F.least(F.lit(4), F.col("n_err"))).cast("double").alias("prcp"),
            (5 * F.floor(F.minute("slot") / 15)).cast("double").alias("wspd"),
            (1 + F.col("n") % 9).cast("double").alias("coco"),
        )

    @cached_property
    def crowd_events(self) -> DataFrame:
        e = self.raw("events").filter((F.col("event_type") == "purchase") & (F.col("value") >= 150))
        music = F.col("user_id") % 2 == 0
        start = t.slot_floor("ts", self.clock)
        return e.select(
            F.col("event_id").alias("crowd_id"),
            F.concat(F.lit("Show "), (F.col("user_id") % 40).cast("string")).alias("event_name"),
            start.alias("start"),
            (start + F.when(music, F.expr("INTERVAL 3 HOURS")).otherwise(F.expr("INTERVAL 2 HOURS"))).alias("end"),
            F.when(music, "Music").otherwise("Other").alias("segment"),
            F.floor(F.col("value") * 10).cast("long").alias("attendance"),
            F.concat(F.lit("V"), (F.col("user_id") % 5).cast("string")).alias("venue_key"),
        )

    @cached_property
    def venues(self) -> DataFrame:
        v = self.raw("nation").filter(F.col("n_nationkey") % 5 == 0)
        k = F.col("n_nationkey")
        return v.select(
            F.concat(F.lit("V"), F.floor(k / 5).cast("string")).alias("venue_key"),
            (F.lit(52.405) + k * 0.01).alias("lat"),
            (F.lit(13.204) + ((k * 7) % 25) * 0.003).alias("lon"),
        )

    @cached_property
    def closures(self) -> DataFrame:
        """Station closures in parsed form."""
        e = self.raw("events").filter((F.col("event_type") == "signup") & (F.col("value") >= 150))
        return e.select(
            F.col("event_id").alias("closure_id"),
            F.lit("station").alias("kind"),
            F.array(station_of(F.col("user_id") % 25)).alias("stations"),
            F.col("ts").alias("start"),
            (F.col("ts") + t.minutes(60 * (1 + F.col("user_id") % 3))).alias("end"),
            F.concat(
                F.lit("Station NATION_"), (F.col("user_id") % 25).cast("string"), F.lit(" closed due to track maintenance.")
            ).alias("description"),
        )

    @cached_property
    def suspensions(self) -> DataFrame:
        """Line suspensions as text, between two stations of the line (parsed by the closure operators)."""
        e = self.raw("events").filter((F.col("event_type") == "error") & (F.col("value") >= 200))
        ls = self.line_stops
        e = e.select(
            F.col("event_id").alias("closure_id"),
            F.concat(F.lit("L"), (F.col("user_id") % 5).cast("string")).alias("line"),
            (1 + F.col("event_id") % 3).cast("int").alias("i"),
            F.col("ts").alias("start"),
            (F.col("ts") + t.minutes(60 * (1 + F.col("user_id") % 3))).alias("end"),
        )
        end_name = F.concat(F.lit("NATION_"), F.substring("station_key", 2, 2).cast("int").cast("string"))
        a = ls.select("line", F.col("seq").alias("i"), end_name.alias("a"))
        b = ls.select("line", (F.col("seq") - 2).alias("i"), end_name.alias("b"))
        return (
            e.join(a, ["line", "i"]).join(b, ["line", "i"])
            .select(
                "closure_id", "start", "end",
                F.format_string("Line %s suspended between %s and %s due to signal failure", "line", "a", "b").alias("description"),
            )
        )

    # -- network ------------------------------------------------------------------------------
    @cached_property
    def stations(self) -> DataFrame:
        k, r = F.col("n_nationkey"), F.col("n_regionkey")
        first = F.concat(F.lit("L"), r.cast("string"))
        second = F.concat(F.lit("L"), ((r + 1) % 5).cast("string"))
        return self.raw("nation").select(
            station_of(k).alias("station_key"),
            F.col("n_name").alias("name"),
            (F.lit(52.40) + k * 0.01).alias("lat"),
            (F.lit(13.20) + ((k * 7) % 25) * 0.003).alias("lon"),
            F.when(k % 4 == 0, F.array(first, second)).otherwise(F.array(first)).alias("lines"),
            (k % 6 == 0).alias("is_rail"),
        )

    @cached_property
    def line_stops(self) -> DataFrame:
        w = Window.partitionBy("line").orderBy("station_key")
        return self.stations.select(F.explode("lines").alias("line"), "station_key").withColumn(
            "seq", F.row_number().over(w)
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Undirected ride edges, both directions stored, with the line that runs on them."""
        nxt = F.lead("station_key").over(Window.partitionBy("line").orderBy("seq"))
        one = self.line_stops.withColumn("dst", nxt).filter("dst IS NOT NULL")
        one = one.select(F.col("station_key").alias("src"), "dst", "line")
        return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "line"))

    # -- energy and ridership from the trade tables -------------------------------------------
    @cached_property
    def lineitem_daily(self) -> DataFrame:
        sup = self.raw("supplier").select("s_suppkey", "s_nationkey")
        li = self.raw("lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
        per = li.groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(
            F.sum(F.col("l_quantity").cast("long")).alias("riders"),
            F.sum(F.round("l_extendedprice").cast("long")).alias("wh"),
        )
        return per.join(sup, per.l_suppkey == sup.s_suppkey).groupBy("day", "s_nationkey").agg(
            F.sum("riders").alias("riders"), F.sum("wh").alias("wh")
        )

    @cached_property
    def daily_station(self) -> DataFrame:
        """Riders per station and day (day, station_key, riders)."""
        return self.lineitem_daily.select("day", station_of(F.col("s_nationkey")).alias("station_key"), "riders")

    @cached_property
    def energy(self) -> DataFrame:
        """Energy per line and day in MWh (day, line, mwh)."""
        n = self.raw("nation").select("n_nationkey", "n_regionkey")
        d = self.lineitem_daily.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        return d.groupBy("day", F.concat(F.lit("L"), F.col("n_regionkey").cast("string")).alias("line")).agg(
            (F.sum("wh") / 1e6).alias("mwh")
        )

    # -- larger point sets for the proximity joins ---------------------------------------------
    @cached_property
    def stops(self) -> DataFrame:
        """One stop per supplier, spread over a city-sized box."""
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("stop_id"),
            F.col("s_name").alias("stop_name"),
            (F.lit(52.40) + ((k * 37) % 1009) * 0.0002).alias("lat"),
            (F.lit(13.20) + ((k * 91) % 1013) * 0.0003).alias("lon"),
            F.concat(F.lit("L"), (F.col("s_nationkey") % 5).cast("string")).alias("line"),
        )

    @cached_property
    def homes(self) -> DataFrame:
        """One point per customer inside the same box."""
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("home_id"),
            (F.lit(52.40) + ((k * 53) % 1009) * 0.0002).alias("lat"),
            (F.lit(13.20) + ((k * 29) % 1013) * 0.0003).alias("lon"),
        )

    @cached_property
    def stop_times(self) -> DataFrame:
        """Orders as trips over supplier stops; the order priority is the line."""
        li = self.raw("lineitem")
        li = spread(li, li.count(), "l_orderkey")
        w = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
        )
        seq = li.select(
            F.col("l_orderkey").alias("trip_id"),
            F.row_number().over(w).alias("stop_sequence"),
            F.col("l_suppkey").alias("stop_id"),
            F.col("l_shipdate").alias("departure"),
        )
        o = self.raw("orders").select(
            F.col("o_orderkey").alias("trip_id"),
            F.concat(F.when(F.col("o_custkey") % 3 == 0, "M").when(F.col("o_custkey") % 3 == 1, "X").otherwise("U"),
                     F.substring("o_orderpriority", 1, 1)).alias("line"),
            (F.col("o_custkey") % 2).cast("int").alias("direction_id"),
        )
        return seq.join(o, "trip_id")
