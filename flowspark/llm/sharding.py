"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records fall into the ranges between them; ranges that turn out
too full are subdivided by a sample of their own until none is. Every range then fits one task, exact running sizes inside
the ranges plus the ranges' offsets give every record its place in the whole order, and equal cuts of that order are the
shards. Shard sizes differ by less than one record from equal parts.

Records are ordered by (text checksum, id), so equal texts are neighbours and stay together unless a cut falls between
them; a group of copies of any size is simply a longer stretch of the order. Identical records are kept as one key with a count.

Defined cases: a null text has size 1 and the checksum of the empty text; a null id sorts first; repeated rows get
neighbouring slots; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import cut, text_or_empty


def keys_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (doc_id, size, text_crc32) with a count, and a 63-bit sort key."""
    raw = text_or_empty(F.col(text_col)).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    return rows.withColumn("key", F.shiftleft("text_crc32", 31).bitwiseOR(F.xxhash64("doc_id", "size").bitwiseAND(2**31 - 1)))


def _sample(keys: DataFrame, weight: float, wanted: int) -> pd.DataFrame:
    """About ``wanted`` keys, each drawn with a chance in proportion to its size; the draw depends on the key only."""
    rate = wanted / max(weight, 1.0)
    draw = F.pmod(F.xxhash64("key", F.lit("splitters")), F.lit(1 << 30)) / float(1 << 30)
    return keys.where(draw < F.col("size") * F.col("n") * rate).select("key", F.greatest(F.col("size") * F.col("n") * rate, F.lit(1.0)).alias("w")).toPandas()


def _quantiles(sample: pd.DataFrame, parts: int) -> np.ndarray:
    sample = sample.sort_values("key")
    mass = sample["w"].cumsum().to_numpy()
    if not len(mass):
        return np.array([], dtype=np.int64)
    at = np.searchsorted(mass, mass[-1] * np.arange(1, parts) / parts)
    return np.unique(sample["key"].to_numpy(dtype=np.int64)[np.minimum(at, len(mass) - 1)])


def _place(keys: DataFrame, bounds: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(dtype=np.int64), side="right").astype("int32"))

    return keys.withColumn("range", range_of("key"))


def split_ranges(keys: DataFrame, ranges: int, oversample: int = 32, slack: float = 2.0) -> tuple[DataFrame, list]:
    """Assign each key a range; returns it with the ranges' exact sizes in order.

    The sample has about ``ranges * oversample`` keys and the sizes one row per range: both are set by parameters, not by
    the data. A range beyond ``slack`` times its even share of bytes or keys is sampled again and subdivided.
    """
    total = keys.agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.count("*").alias("c")).first()
    if not total["c"]:
        return _place(keys, np.array([], dtype=np.int64)), []
    bounds = _quantiles(_sample(keys, total["b"], ranges * oversample), ranges)
    while True:
        placed = _place(keys, bounds)
        sizes = placed.groupBy("range").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("rows"), F.count("*").alias("c"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("range").collect()
        full = [s for s in sizes if s["lo"] < s["hi"] and (s["b"] > slack * total["b"] / ranges or s["c"] > slack * total["c"] / ranges)]
        more = []
        for s in full:
            inside = keys.where(F.col("key").between(s["lo"], s["hi"]))
            drawn = _quantiles(_sample(inside, s["b"], 4 * oversample), 4)
            # by count when a few large records hold the sample
            more += [drawn, _quantiles(_sample(inside.withColumn("size", F.lit(1)).withColumn("n", F.lit(1)), s["c"], 4 * oversample), 4)]
        grown = np.unique(np.concatenate([bounds, *more])) if more else bounds
        if len(grown) == len(bounds):
            return placed, sizes
        bounds = grown


def assign_shards(docs: DataFrame, shards: int = 8, ranges_per_shard: int = 16, rows_per_range: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per input row; ``slot`` counts from 0 without gaps in each shard."""
    keys = cut(keys_of(docs, id_col, text_col))
    ranges = max(shards * ranges_per_shard, -(-keys.count() // rows_per_range))
    placed, sizes = split_ranges(keys, ranges)
    spark = docs.sparkSession
    total = sum(s["b"] for s in sizes)
    offsets, b, r = [], 0, 0
    for s in sizes:
        offsets.append((s["range"], b, r))
        b, r = b + s["b"], r + s["rows"]
    starts = spark.createDataFrame(offsets or [(0, 0, 0)], "range int, bytes_before long, rows_before long")
    inside = Window.partitionBy("range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("b", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))).withColumn("r", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # one row per range: its size is set by the parameters
    at = at.join(F.broadcast(starts), "range")
    rows = at.select("doc_id", "size", "text_crc32", (F.col("b") + F.col("bytes_before")).alias("b"), (F.col("r") + F.col("rows_before")).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    middle = (F.col("b") + F.col("copy") * F.col("size")) * 2 + F.col("size")  # twice the middle of the record, so that cuts round to the nearest
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.lit(2 * max(total, 1)).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int")
    rows = cut(rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("r") + F.col("copy")).alias("place")))
    first = rows.groupBy("shard").agg(F.min("place").alias("first"))
    return rows.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
