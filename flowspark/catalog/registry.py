"""Registry of the operators that run on the bound test tables."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.bindings import Net
from flowspark.catalog.ctes import with_ctes

ENTRIES: dict[str, "Entry"] = {}


@dataclass
class Entry:
    name: str
    fn: Callable[[Net], DataFrame]
    cols: list[tuple[str, str]]
    sql: str | None
    doc: str


def _parse(cols: str) -> list[tuple[str, str]]:
    out = []
    for part in cols.split():
        name, _, kind = part.partition(":")
        out.append((name, kind or "s"))
    return out


def _spark_col(name, kind):
    c = F.col(name)
    if kind == "f":
        c = F.round(c.cast("double"), 4) + F.lit(0.0)
    elif kind == "f2":
        c = F.round(c.cast("double"), 2) + F.lit(0.0)
    elif kind in ("i", "b"):
        c = c.cast("long")
    elif kind in ("d", "t", "s"):
        c = c.cast("string")
    elif kind == "a":
        c = F.concat_ws("|", c)
    return c.alias(name)


def _sql_col(name, kind):
    q = f'"{name}"'
    if kind == "f":
        e = f"round(CAST({q} AS DOUBLE), 4) + 0.0"
    elif kind == "f2":
        e = f"round(CAST({q} AS DOUBLE), 2) + 0.0"
    elif kind in ("i", "b"):
        e = f"CAST({q} AS BIGINT)"
    elif kind == "a":
        e = f"array_to_string({q}, '|')"
    else:
        e = f"CAST({q} AS VARCHAR)"
    return f"{e} AS {q}"


def register(name: str, cols: str, sql: str | None = None, ctes: str = ""):
    """Register an operator call on the test tables.

    ``cols`` lists ``name:kind`` with kind s string, d date, t timestamp, i integer, b boolean,
    f double (4 digits), f2 double (2 digits), a array of strings. The same list shapes both the
    DataFrame and the SQL, so the two sides agree on names and types. ``ctes`` names the shared
    definitions the SQL needs.
    """
    spec = _parse(cols)
    full = None
    if sql is not None:
        body = with_ctes(ctes.split(), sql)
        full = f"SELECT {', '.join(_sql_col(n, k) for n, k in spec)} FROM ({body}) AS q"

    def deco(fn):
        assert name not in ENTRIES, name
        ENTRIES[name] = Entry(name, fn, spec, full, fn.__doc__ or "")
        return fn

    return deco


def run(entry: Entry, spark, sf_dir) -> DataFrame:
    df = entry.fn(Net(spark, sf_dir))
    return df.select(*[_spark_col(n, k) for n, k in entry.cols])
