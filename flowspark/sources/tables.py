"""Readers for the tables of a network: tolerant CSV, wide counters, logs, and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions import text as tx
from flowspark.functions import time as t
from flowspark.sources import folders

EVENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in (
    "event_name", "began_local", "estimated_end_local", "venue_name", "address", "city", "country", "segment", "genre",
    "description", "estimated_attendance", "event_url")])
FEEDBACK_SCHEMA = "time timestamp_ntz, kind string, rating string, about string, comment string"
AUDIT_SCHEMA = "time timestamp_ntz, question string, answer string, figures map<string,string>, steps array<string>"
TIMETABLE_SCHEMA = (
    "line string, mode string, direction_id int, trip_id string, stop_sequence int, departure_time string, station_key string, "
    "stop_name string, stop_lat double, stop_lon double, route_id string"
)


def read_csv_any(spark: SparkSession, path: str, schema=None, header: bool | str = True, glob: str | None = None) -> DataFrame:
    """Tolerant CSV scan of a file or a folder with files of several dialects: separator, encoding, BOM, garbled names and cells, mis-quoted lines.

    ``header`` is true or false for all files, or a column name that tells files with a header line from files without; the latter
    need a ``schema``. Columns stay strings, a decimal comma of semicolon files becomes a point. ``source_file`` and ``source_rank``
    (file time) order overlapping files; a column that a file lacks is null in its rows.
    """
    if header is not True and schema is None:
        raise ValueError("files without a header line need a schema")
    groups = folders.dialects(spark, path, glob, header if isinstance(header, str) else None)
    parts = [_read_dialect(spark, d, schema, d.header if isinstance(header, str) else header) for d in groups]
    if not parts:
        names = schema.fieldNames() if schema is not None else []
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in [*names, "source_file"]] + [T.StructField("source_rank", T.TimestampType())]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    lacking = [c for c in schema.fieldNames() if c not in out.columns] if schema is not None else []
    return out.withColumns({c: F.lit(None).cast("string") for c in lacking})


def _read_dialect(spark: SparkSession, d: folders.Dialect, schema, header: bool) -> DataFrame:
    windows = d.encoding != "UTF-8"
    r = spark.read.option("sep", d.sep).option("encoding", "ISO-8859-1" if windows else d.encoding).option("header", header).option("mode", "PERMISSIVE")
    if schema is not None and not header:
        r = r.schema(schema)
    df = r.csv(list(d.files))
    cols = df.columns
    src = df.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("source_rank"))
    names = [_clean_header(c) for c in cols]
    src = rescue_rows(src.toDF(*names, "source_file", "source_rank"), names, d.sep)
    cell = lambda c: tx.from_latin(F.col(f"`{c}`")) if windows else F.col(f"`{c}`")
    point = lambda c: F.regexp_replace(c, r"^([+-]?\d+),(\d+)$", "$1.$2") if d.decimal_comma else c
    return src.select(*[point(tx.repair(F.trim(cell(c)))).alias(c) for c in names], "source_file", "source_rank")


def _clean_header(c: str) -> str:
    c = c.replace("﻿", "").replace("ï»¿", "").strip()
    try:
        return c.encode("cp1252").decode("utf-8") if any(x in c for x in "ÃÂ") else c
    except (UnicodeEncodeError, UnicodeDecodeError):
        return c


def rescue_rows(df: DataFrame, cols: list[str], sep: str) -> DataFrame:
    """Split rows whose first field swallowed the whole line, if that gives exactly one value per column."""
    if len(cols) < 3:
        return df
    q = lambda c: F.col(f"`{c}`")
    one = q(cols[0]) if sep == "\t" else F.translate(q(cols[0]), "\t", " ")
    first = F.trim(F.regexp_replace(one, '^"|"$', ""))
    alone = F.coalesce(*[q(c) for c in cols[1:]]).isNull()
    parts = F.when(alone & first.contains(sep), F.split(first, f"\\{sep}" if sep != "\t" else "\t"))
    df = df.withColumn("_parts", F.filter(F.array(parts), lambda p: F.size(p) == len(cols)))  # the fields of a line that its first field holds
    whole = F.size("_parts") > 0
    field = lambda i: F.nullif(F.trim(F.regexp_replace(F.col("_parts")[0][i], '^"|"$', "")), F.lit(""))
    out = [F.when(whole, field(i)).otherwise(q(c)).alias(c) for i, c in enumerate(cols)]
    return df.select(*out, *[c for c in df.columns if c not in (*cols, "_parts")])


def number(c, decimal_comma: bool = False):
    c = F.col(f"`{c}`") if isinstance(c, str) else c
    return (F.replace(c, F.lit(","), F.lit(".")) if decimal_comma else c).try_cast("double")


def parse_ts(c):
    """Timestamps as month/day/year hour:minute, or ISO."""
    c = F.col(f"`{c}`") if isinstance(c, str) else c
    us = F.try_to_timestamp(c, F.lit("M/d/yyyy H:mm"))
    return F.coalesce(us, F.try_to_timestamp(c)).cast("timestamp_ntz")


def last_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep the newest row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def wide_to_long(df: DataFrame, ts_col: str, names: DataFrame, value: str = "reading") -> DataFrame:
    """Counter columns to rows. ``names`` maps (header, occurrence) to station_key; pandas-style '.1' marks repeats."""
    cols = [c for c in df.columns if c not in (ts_col, "source_file", "source_rank")]
    wide = df.select(parse_ts(ts_col).alias("slot"), "source_rank", *[number(c).alias(c) for c in cols])
    long = wide.unpivot(["slot", "source_rank"], [f"`{c}`" for c in cols], "header", value)
    occ = F.coalesce(F.nullif(F.regexp_extract("header", r"\.(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    long = long.withColumn("occurrence", occ).withColumn("header", F.regexp_replace("header", r"\.\d+$", ""))
    long = long.join(names, ["header", "occurrence"])
    return last_wins(long.filter(F.col(value).isNotNull()), ["station_key", "slot"], [F.col("source_rank").desc()]).select("station_key", "slot", value)


def read_events(spark: SparkSession, path: str, zone: str = "Europe/Berlin") -> DataFrame:
    """Crowd events; files may lack a header row. Offsets are converted to local naive time."""
    df = read_csv_any(spark, path, EVENT_SCHEMA, header="event_name")
    local = lambda c: F.from_utc_timestamp(F.to_utc_timestamp(F.try_to_timestamp(c), F.current_timezone()), zone).cast("timestamp_ntz")
    start, end = local(F.col("began_local")), local(F.col("estimated_end_local"))
    hours = F.when(F.col("segment") == "Music", 180).otherwise(120)
    df = df.withColumn("start", start).withColumn("end", F.coalesce(end, start + t.minutes(hours)))
    df = df.withColumn("attendance", F.col("estimated_attendance").try_cast("long")).withColumn("address", F.trim("address"))
    return last_wins(df, ["event_name", "start", "venue_name", "address"], [F.col("source_rank").desc()])


def read_closures(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv_any(spark, path).withColumn("start", parse_ts("when"))
    df = df.withColumn("end", tx.closure_end("start", "duration"))
    return last_wins(df, ["start", "description"], [F.col("source_rank").desc()])


def read_daily_wide(spark: SparkSession, path: str, value: str = "mwh") -> DataFrame:
    """Daily table with one column per line to (day, line, value)."""
    df = read_csv_any(spark, path)
    day, lines = df.columns[0], [c for c in df.columns[1:] if c not in ("source_file", "source_rank")]
    x = df.select(F.to_date(parse_ts(day)).alias("day"), "source_rank", *[number(c).alias(c) for c in lines])
    x = x.unpivot(["day", "source_rank"], lines, "line", value).filter(F.col(value).isNotNull())
    return last_wins(x, ["day", "line"], [F.col("source_rank").desc()]).drop("source_rank")


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv_any(spark, path)
    first = df.columns[0]
    x = df.select(parse_ts(first).alias("slot"), "source_rank", *[number(c).alias(c) for c in ("temp", "prcp", "wspd", "coco", "cldc") if c in df.columns])
    return last_wins(x.filter("slot IS NOT NULL"), ["slot"], [F.col("source_rank").desc()]).drop("source_rank")


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations with unique, non-null ids (enforced); repeated names get their lines as suffix."""
    df = read_csv_any(spark, path)
    n = df.groupBy("station_id").count().filter("station_id IS NULL OR count > 1").agg(F.count(F.lit(1))).scalar()
    ok = F.when(n > 0, F.raise_error(F.lit("station_id must be unique and present")).cast("string")).otherwise(F.col("station_id"))
    dup = F.count(F.lit(1)).over(Window.partitionBy(tx.display_name("station_name")))
    key = tx.display_name("station_name")
    return df.select(
        F.when(dup > 1, F.concat(key, F.lit(" ("), "u_bahn_lines", F.lit(")"))).otherwise(key).alias("station_key"), ok.alias("station_id"),
        F.col("station_name").alias("name"), number("latitude").alias("lat"), number("longitude").alias("lon"),
        F.transform(F.split("u_bahn_lines", ","), lambda x: F.trim(x)).alias("lines"), F.col("station_name").startswith("S+U").alias("is_rail"),
    )


def unique_or_fail(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df`` if its key is present and unique; else its first use ends with an error that names the table."""
    n = df.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).agg(F.count(F.lit(1))).scalar()
    return df.withColumn(key, F.when(n > 0, F.raise_error(F.lit(f"{what}: {key} must be unique and present")).cast("string")).otherwise(F.col(key)))


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """Undirected connections between stations (a, b), each once, with the smaller id first; loops are dropped."""
    df = read_csv_any(spark, path).select(F.trim("station_id_1").alias("x"), F.trim("station_id_2").alias("y")).filter("x <> y")
    return df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (line_id, line_name) with unique ids (enforced)."""
    return unique_or_fail(read_csv_any(spark, path).select(F.trim("line_id").alias("line_id"), F.trim("line_name").alias("line_name")), "line_id", "lines")


def network_edges(stations: DataFrame, connections: DataFrame) -> DataFrame:
    """Edges of the network (a, b, transfer): the connections, and one between stations of equal name that have none."""
    named = stations.select(F.col("station_id").alias("id"), "name")
    pairs = named.select(F.col("id").alias("a"), "name").join(named.select(F.col("id").alias("b"), "name"), "name").filter("a < b").select("a", "b")
    same = pairs.join(connections, ["a", "b"], "left_anti").select("a", "b", F.lit(True).alias("transfer"))
    return connections.select("a", "b", F.lit(False).alias("transfer")).unionByName(same)


def read_timetable(spark: SparkSession, path: str) -> DataFrame:
    """Stops of representative trips with typed columns and seconds since the day's start; rows without trip or place in it are dropped."""
    df = read_csv_any(spark, path)
    types = [part.split() for part in TIMETABLE_SCHEMA.split(", ")]
    typed = df.select(*[(F.col(c).try_cast(k) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in types])
    return typed.filter("trip_id IS NOT NULL AND stop_sequence IS NOT NULL").withColumn("seconds", tx.timetable_seconds("departure_time"))


def locate_events(events: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Events with the venue_key of the longest gazetteer name in their address and venue name; null where none occurs.

    ``gazetteer`` holds (alias, venue_key) with folded names; each distinct place is looked up once.
    """
    from flowspark.operators.joins import longest_mention

    place = F.concat_ws(" ", "address", "venue_name")
    places = events.select(place.alias("place")).distinct()
    hit = longest_mention(places, gazetteer, "place", "place").join(gazetteer.dropDuplicates(["alias"]), "alias").select("place", "venue_key")
    return events.withColumn("place", place).join(hit, "place", "left").drop("place")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines log; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def merge_side_table(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Rows of an optional side table override the base by key."""
    b, e = base.withColumn("_p", F.lit(0)), extra.withColumn("_p", F.lit(1))
    return last_wins(b.unionByName(e, allowMissingColumns=True), [key], [F.col("_p").desc()]).drop("_p")
