"""Structured Streaming versions of the counter pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.config import DEFAULT_CLOCK, Clock
from flowspark.sources.ingest import VersionedTable

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, schema: str, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """File stream with an explicit schema."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def readings(stream: DataFrame, station, value, ts: str = "ts", delay: str = "30 minutes") -> DataFrame:
    """Timestamped readings with a watermark; NTZ input is cast because watermarks need a TIMESTAMP."""
    return stream.select(station.alias("station_key"), F.col(ts).cast("timestamp").alias("ts"), value.alias("v")).withWatermark("ts", delay)


def slot_totals(r: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Tumbling slot totals per station; emitted once the watermark has passed the slot."""
    g = r.groupBy("station_key", F.window("ts", f"{clock.slot_minutes} minutes")).agg(F.sum("v").alias("reading"), F.count(F.lit(1)).alias("n"))
    return g.select("station_key", F.col("window.start").alias("slot"), "reading", "n")


def last_hour(r: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Sliding one-hour sums per station, labelled by the last slot of the hour."""
    g = r.groupBy("station_key", F.window("ts", "1 hour", f"{clock.slot_minutes} minutes")).agg(F.sum("v").alias("hour_total"))
    return g.select("station_key", (F.col("window.end") - F.expr(f"INTERVAL {clock.slot_minutes} MINUTES")).alias("slot"), "hour_total")


def sessions(r: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity sessions per station."""
    g = r.groupBy("station_key", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    return g.select("station_key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def without_duplicates(stream: DataFrame, key: list[str], ts: str = "ts", delay: str = "30 minutes") -> DataFrame:
    """Drop repeated messages that arrive within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def expected_hours(cells: DataFrame, clock: Clock = DEFAULT_CLOCK) -> DataFrame:
    """Static side of the live check: (station_key, slot, hour_expected, hour_var) of every full hour of a service day.

    ``cells`` needs station_key, slot, day, tod and expected.
    """
    w = Window.partitionBy("station_key", "day").orderBy("tod").rowsBetween(1 - clock.slots_per_hour, 0)
    h = cells.select("station_key", "slot", F.sum("expected").over(w).alias("hour_expected"), F.sum(F.col("expected") * F.col("expected")).over(w).alias("hour_var"),
                     F.count(F.lit(1)).over(w).alias("_n"), (F.col("tod") - F.min("tod").over(w)).alias("_span"))
    return h.filter((F.col("_n") == clock.slots_per_hour) & (F.col("_span") == clock.slots_per_hour - 1)).drop("_n", "_span")


def against_expected(hours: DataFrame, expected: DataFrame, limit: float = 3.0) -> DataFrame:
    """Streamed hour totals joined with the static expectation: z of each full hour and whether it is above ``limit``.

    The static side is planned anew with every micro-batch, so a corrected model table takes effect with the next one.
    """
    e = expected.withColumn("slot", F.col("slot").cast("timestamp"))
    z = (F.col("hour_total") - F.col("hour_expected")) / F.sqrt(F.greatest("hour_var", F.lit(1.0)))
    return hours.join(e, ["station_key", "slot"]).select("station_key", "slot", "hour_total", "hour_expected", z.alias("z"), (z > limit).alias("above"))


ALERT_SCHEMA = "rule string, station_key string, ms long"
MEMORY_SCHEMA = "last long, run95 int, run99 int, f1 long, f2 long, f3 long"
PENDING_SCHEMA = "op array<long>, ms array<long>, reading array<long>, q95 array<double>, q99 array<double>"
_FAR = -(10**9)


def alert_steps(memory: tuple, rows, gap: int = 4, slots_per_day: int = 80) -> tuple[tuple, list[tuple]]:
    """Rules R1-R3 over rows (op, slot, reading, q95, q99) of one station in order of ``op``: new memory and firings (rule, slot).

    The memory is the last slot, the lengths of the two runs, and when each rule last held; a rule fires again after ``gap`` quiet slots.
    """
    last, r95, r99, *held = memory
    out = []
    for op, slot, reading, q95, q99 in rows:
        if op <= last:
            continue  # the slot has been judged
        joined = op == last + 1 and op % slots_per_day != 0  # the night separates days although slots are numbered through
        r95 = (r95 if joined else 0) + 1 if reading > q95 else 0
        r99 = (r99 if joined else 0) + 1 if reading > q99 else 0
        last = op
        for i, hit in enumerate((r95 >= 2, r95 >= 3, r99 >= 2)):
            if hit:
                if op - held[i] > gap:
                    out.append((f"R{i + 1}", slot))
                held[i] = op
    return (last, r95, r99, *held), out


def _alert_processor(gap: int, slots_per_day: int):
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Alerts(StatefulProcessor):
        """Rows wait in state until the watermark has passed them; then they are judged in event time, however they arrived."""

        def init(self, handle) -> None:
            self.handle = handle
            self.pending = handle.getValueState("pending", PENDING_SCHEMA)
            self.memory = handle.getValueState("memory", MEMORY_SCHEMA)

        def handleInputRows(self, key, rows, timerValues):
            new = [r for frame in rows for r in zip(*[frame[c].tolist() for c in ("op", "ms", "reading", "q95", "q99")])]
            yield self.judge(key, new, timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield self.judge(key, [], timerValues)

        def judge(self, key, new, timerValues):
            """One read and one write of the state per call: what waits is kept as columns, not row by row."""
            mark = timerValues.getCurrentWatermarkInMs()
            waiting = sorted({r[0]: r for r in [*zip(*self.pending.get()), *new]}.values()) if self.pending.exists() else sorted({r[0]: r for r in new}.values())
            due, later = [r for r in waiting if r[1] <= mark], [r for r in waiting if r[1] > mark]
            out = []
            if due:
                memory = self.memory.get() if self.memory.exists() else (-10, 0, 0, _FAR, _FAR, _FAR)
                memory, fired = alert_steps(tuple(memory), due, gap, slots_per_day)
                self.memory.update(memory)
                out = [(rule, key[0], ms) for rule, ms in fired]
            if due or new:
                self.pending.update(tuple(list(c) for c in zip(*later)) if later else ([], [], [], [], []))
            if later:
                self.handle.registerTimer(later[0][1])
            return pd.DataFrame({"rule": pd.Series([r[0] for r in out], dtype=object), "station_key": pd.Series([r[1] for r in out], dtype=object), "ms": pd.Series([r[2] for r in out], dtype="int64")})

        def close(self) -> None:
            pass

    return Alerts()


def alert_state(cells: DataFrame, delay: str = "1 day", gap: int = 4, slots_per_day: int = 80) -> DataFrame:
    """Rules R1-R3 per station with re-arm after ``gap`` quiet slots, in event time.

    ``cells`` streams (station_key, slot timestamp, op long, reading, q95, q99) in any order within ``delay``; a row later than that is
    dropped. The state of a station is what waits for the watermark (at most ``delay`` of rows), its last slot, two run lengths and the
    last firing of each rule. The state lives in RocksDB, which the session must name as its state store.
    """
    c = cells.withWatermark("slot", delay).withColumn("ms", F.unix_millis("slot"))
    fired = c.groupBy("station_key").transformWithStateInPandas(_alert_processor(gap, slots_per_day), ALERT_SCHEMA, "Append", "EventTime")
    return fired.select("rule", "station_key", F.timestamp_millis("ms").alias("slot"))


def run_to_table(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a query over everything available and return what it wrote."""
    out, ck = f"{folder}/out", f"{folder}/ck"
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def use_rocksdb(spark: SparkSession) -> None:
    """State store that custom state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def upsert_stream(stream: DataFrame, table: VersionedTable, checkpoint: str, once: bool = True):
    """Merge a stream of versioned rows into a table, exactly once per micro-batch.

    A micro-batch becomes one batch of the table, named by its number; one that the table already holds (a replay after a failure between the
    table's commit and the stream's) is skipped. Which row of a key counts follows from the table's ``newest`` column, not from the order of arrival.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        seen, tag = table.version(), f"epoch{epoch:012d}"
        if any(b.endswith(tag) for b in seen.batches):
            return
        rows = batch.count()
        if rows:
            table.commit(seen, (*seen.batches, table.stage(batch, seen.number + 1, tag, rows)))

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if once else w).start()
    if once:
        q.awaitTermination()
    return q
