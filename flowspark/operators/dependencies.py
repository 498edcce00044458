"""Stations whose deviations move together.

All-pairs correlations come from blocked products: the series is cut into time chunks, each chunk
multiplies its (time x station) blocks inside a task, and Spark sums the partial products. A time
step never emits its station pairs row by row; a task sees at most two station blocks of one chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions import time as t
from flowspark.functions.lineage import cut
from flowspark.functions.noise import expected_reading


def pair_products(series: DataFrame, values: list[str], cls: str | None = None, block: int = 256, chunk_slots: int = 2048) -> DataFrame:
    """Sums over time of x_a * x_b for all a < b: (cls, a, b, p_<value>...).

    ``series`` has (station_key, n, values) with n an integer time index and missing steps as 0.
    """
    keys = series.select("station_key").distinct()
    blocks = max(1, -(-keys.count() // block))
    c = F.col(cls) if cls else F.lit(0)
    s = series.select(
        "station_key", "n", c.cast("int").alias("cls"), *[F.col(v).cast("double").alias(v) for v in values],
        F.floor(F.col("n") / chunk_slots).alias("chunk"), F.pmod(F.xxhash64("station_key"), F.lit(blocks)).cast("int").alias("blk"),
    )
    other = F.sequence(F.lit(0), F.lit(blocks - 1))
    s = s.withColumn("o", F.explode(other)).withColumn("bi", F.least("blk", "o")).withColumn("bj", F.greatest("blk", "o")).drop("o")
    vals = list(values)

    def products(pdf):
        import numpy as np
        import pandas as pd

        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        left = np.sort(pdf.loc[pdf["blk"] == bi, "station_key"].unique())
        right = np.sort(pdf.loc[pdf["blk"] == bj, "station_key"].unique())
        out = {}
        for v in vals:
            m = pdf.pivot_table(index="n", columns="station_key", values=v, aggfunc="sum", fill_value=0.0)
            out["p_" + v] = (m[left].to_numpy().T @ m[right].to_numpy()).ravel() if len(left) and len(right) else np.array([])
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        d = pd.DataFrame({"cls": int(pdf["cls"].iloc[0]), "a": a, "b": b, **out})
        flip = d["a"] > d["b"]
        d.loc[flip, ["a", "b"]] = d.loc[flip, ["b", "a"]].to_numpy()
        return d[d["a"] < d["b"]].drop_duplicates(["a", "b"])

    schema = "cls int, a string, b string, " + ", ".join(f"p_{v} double" for v in vals)
    part = s.groupBy("chunk", "cls", "bi", "bj").applyInPandas(products, schema)
    return part.groupBy("cls", "a", "b").agg(*[F.sum(f"p_{v}").alias(f"p_{v}") for v in vals])


def correlations(products: DataFrame, series: DataFrame, value: str, name: str, n_col: str = "n") -> DataFrame:
    """Pearson r per pair from products (a, b, p_<value>) and the series' own moments."""
    m = series.groupBy("station_key").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    n = series.select(n_col).distinct().agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    j = products.join(m.toDF("a", "sa", "qa"), "a").join(m.toDF("b", "sb", "qb"), "b").withColumn("n_", n)
    cov = F.col(f"p_{value}") - F.col("sa") * F.col("sb") / F.col("n_")
    va, vb = F.col("qa") - F.col("sa") * F.col("sa") / F.col("n_"), F.col("qb") - F.col("sb") * F.col("sb") / F.col("n_")
    return j.select("a", "b", F.try_divide(cov, F.sqrt(va * vb)).alias(name))


def hourly_z(risk: DataFrame) -> DataFrame:
    """Hourly deviation from normal (zb, no events) and from the model (zf), the network's own swing removed."""
    r = risk.withColumn("hour", t.hour_floor("slot")).withColumn("x0", F.col("expected0")).withColumn("x1", F.col("expected"))
    g = r.groupBy("station_key", "hour").agg(
        F.sum("reading").alias("o"), F.sum("x0").alias("e0"), F.sum(F.col("x0") * F.col("x0")).alias("v0"), F.sum("x1").alias("e1"), F.sum(F.col("x1") * F.col("x1")).alias("v1")
    )
    z = lambda e, v: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (F.col("o") - F.col(e)) / F.sqrt(F.col(v) + 1)))
    g = g.withColumn("zb", z("e0", "v0")).withColumn("zf", z("e1", "v1"))
    m = g.groupBy("hour").agg(F.avg("zb").alias("mb"), F.avg("zf").alias("mf"), F.sum("e0").alias("live")).filter("live > 0")
    g = g.join(m, "hour").withColumn("n", F.unix_date(F.to_date("hour")).cast("long") * 24 + F.hour("hour"))
    return g.select("station_key", "hour", "n", (F.col("zb") - F.col("mb")).alias("zb"), (F.col("zf") - F.col("mf")).alias("zf"))


def event_hours(events: DataFrame, before_min: int, after_min: int, anchor: str = "start") -> DataFrame:
    """Hours touched by events: from ``anchor`` - before (floored to the hour) to end + after, per venue."""
    lo = t.hour_floor(F.col(anchor) - t.minutes(before_min))
    hi = t.hour_floor(F.col("end") + t.minutes(after_min))
    h = events.select("venue_key", "start", "end", F.explode(F.sequence(t.slot_no(lo), t.slot_no(hi), F.lit(4).cast("long"))).alias("_n"))
    return h.select("venue_key", "start", "end", t.slot_from_no("_n").alias("hour"))


def station_dependencies(z: DataFrame, events: DataFrame, edges: DataFrame, top: int = 8) -> DataFrame:
    """Unlinked pairs with the highest correlation: overall, outside event hours, after the event model, with the driving venue."""
    z = cut(z)
    busy = event_hours(events, 120, 120).select("hour").distinct().withColumn("busy", F.lit(1))
    zc = z.join(busy, "hour", "left").na.fill(0, ["busy"])
    p = cut(pair_products(zc, ["zb", "zf"], "busy"))
    tot = p.groupBy("a", "b").agg(F.sum("p_zb").alias("p_zb"), F.sum("p_zf").alias("p_zf"))
    calm_z = zc.filter("busy = 0")
    r = correlations(tot, z, "zb", "r").join(correlations(tot, z, "zf", "r_model"), ["a", "b"])
    r = r.join(correlations(p.filter("cls = 0").select("a", "b", "p_zb"), calm_z, "zb", "r_calm"), ["a", "b"], "left")
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    best = cut(r.join(e, ["a", "b"], "left_anti").orderBy(F.col("r").desc(), "a", "b").limit(top))
    h = event_hours(events, 0, 120, "end").select("venue_key", "start", "end", "hour").distinct()
    za, zb = z.select(F.col("station_key").alias("a"), "hour", F.col("zb").alias("x")), z.select(F.col("station_key").alias("b"), "hour", F.col("zb").alias("y"))
    d = best.select("a", "b").join(za, "a").join(zb, ["b", "hour"]).join(h, "hour")
    d = d.groupBy("a", "b", "venue_key").agg(F.sum(F.col("x") * F.col("y")).alias("pull"))
    drv = d.groupBy("a", "b").agg(F.max_by("venue_key", F.struct("pull", "venue_key")).alias("venue_key"), F.max("pull").alias("pull"))
    return best.join(drv, ["a", "b"], "left")


def specific_residuals(cells: DataFrame) -> DataFrame:
    """Standardised residuals without the network's common movement: (station_key, slot, n, x).

    ``cells`` are full calendar days with (cday, slot). n counts operating slots without gaps.
    """
    days = cells.select("cday").distinct().withColumn("dn", F.row_number().over(Window.orderBy("cday")) - 1)
    h = F.hour("slot")
    pos = F.when(h == 0, F.minute("slot") / 15).otherwise(4 + (h - 5) * 4 + F.minute("slot") / 15).cast("long")
    kind = F.when(F.col("wd") < 5, 0).when(F.col("wd") == 5, 1).otherwise(2)
    c = cells.join(days, "cday").withColumn("n", F.col("dn") * 80 + pos).withColumn("kind", kind).withColumn("p", pos)
    mean = c.groupBy("station_key", "kind", "p").agg(F.avg("reading").alias("m"))
    r = c.join(mean, ["station_key", "kind", "p"]).select("station_key", "slot", "n", (F.col("reading") - F.col("m")).alias("res"))
    sd = r.groupBy("station_key").agg(F.stddev_pop("res").alias("sd"))
    z = r.join(sd, "station_key").withColumn("z", F.coalesce(F.try_divide("res", "sd"), F.lit(0.0)))
    common = z.groupBy("n").agg(F.avg("z").alias("c"))
    zc = z.join(common, "n")
    beta = zc.groupBy("station_key").agg(F.try_divide(F.sum(F.col("z") * F.col("c")), F.sum(F.col("c") * F.col("c"))).alias("beta"))
    return zc.join(beta, "station_key").select("station_key", "slot", "n", (F.col("z") - F.coalesce("beta", F.lit(0.0)) * F.col("c")).alias("x"))


def residual_dependencies(spec: DataFrame, hops: DataFrame, min_hops: int = 3, top: int = 5, max_lag: int = 2) -> DataFrame:
    """Pairs at least ``min_hops`` apart by residual correlation, with the best lag of up to two slots."""
    spec = cut(spec)
    r = correlations(pair_products(spec, ["x"]), spec, "x", "r")
    h = hops.select(F.col("source").alias("a"), F.col("node").alias("b"), F.col("d").alias("hops")).filter(F.col("hops") >= min_hops)
    cand = r.join(h, ["a", "b"]).orderBy(F.col("r").desc(), F.col("a").desc(), F.col("b").desc()).limit(top)
    lag = cand.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    xa = spec.select(F.col("station_key").alias("a"), "n", F.col("x").alias("xa"))
    xb = spec.select(F.col("station_key").alias("b"), F.col("n").alias("m"), F.col("x").alias("xb"))
    j = lag.join(xa, "a").withColumn("m", F.col("n") + F.col("lag")).join(xb, ["b", "m"])
    c = j.groupBy("a", "b", "lag").agg(F.corr("xa", "xb").alias("rl"))
    best = c.groupBy("a", "b").agg(F.max_by("lag", F.struct("rl", F.lit(0) - F.abs("lag"), "lag")).alias("best_lag"), F.max("rl").alias("best_r"))
    return cand.join(best, ["a", "b"])
