"""All-or-nothing ingest into a versioned table.

A table is a folder of batches and numbered manifests. A batch is written in full before any reader can see it; it becomes part of the table
by the next manifest, which lists all batches in force and appears by one rename (on a file system where rename is atomic). A
failed check or a failed write leaves the manifests, and with them the table, as they were. Within the table the newest batch wins per key, then the newest file.

Batches are partitioned by day, so reports and reads of some days touch only these.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.lineage import spread
from flowspark.sources.tables import last_wins

#: Rows of a large batch that one task writes; every task writes a file a day.
BATCH_ROWS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class Version:
    """A number and its entries, oldest first."""

    number: int
    batches: tuple[str, ...]


class Versioned:
    """Numbered manifests below ``root``: each lists the entries of one version, and the highest number is in force."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self, number: int | None = None) -> Version:
        """The manifest in force, or the one with that number; version 0 is empty."""
        if number is None:
            fs, folder = self._fs(), self._path("manifests")
            names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
            number = max([int(x.removesuffix(".json")) for x in names if x.endswith(".json") and x[0].isdigit()], default=0)
        if not number:
            return Version(0, ())
        listed = self.spark.read.schema("batch string, place int").json(f"{self.root}/manifests/{number:09d}.json").collect()
        return Version(number, tuple(r["batch"] for r in sorted(listed, key=lambda r: r["place"])))

    def commit(self, seen: Version, batches: tuple[str, ...]) -> Version:
        """Make ``batches`` the table, unless another writer committed after ``seen``."""
        fs, number = self._fs(), seen.number + 1
        lines = "".join(json.dumps({"batch": b, "place": i}) + "\n" for i, b in enumerate(batches))
        draft, final = self._path(f"manifests/_draft-{uuid.uuid4().hex}"), self._path(f"manifests/{number:09d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(lines.encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {number} was committed by another writer; read the table again")
        return Version(number, batches)


class VersionedTable(Versioned):
    """Rows of ``schema`` (with a ``day`` column) below ``root``, unique by ``keys`` when read.

    Of rows with one key the one with the greatest value in ``newest`` (a column, if named) counts, then the newest batch, then the newest file.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, keys: list[str], newest: str | None = None) -> None:
        super().__init__(spark, root)
        self.keys, self.newest = keys, newest
        own = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.names = own.fieldNames()
        stored = [f for f in own.fields if f.name != "day"]
        extra = [T.StructField("source_rank", T.TimestampType()), T.StructField("source_file", T.StringType()), T.StructField("batch", T.StringType())]
        self.schema = T.StructType([*stored, *extra, own["day"]])

    # -- data -----------------------------------------------------------------------------------
    def read(self, version: Version | None = None) -> DataFrame:
        """The table, or an earlier version of it: the newest row per key."""
        v = version or self.version()
        if not v.batches:
            return self.spark.createDataFrame([], self.schema).select(*self.names)
        held = self._batches(v.batches)
        return last_wins(spread(held, held.count(), *self.keys), self.keys, self._order("batch")).select(*self.names)

    def _order(self, *first: str) -> list:
        own = [F.col(self.newest).desc_nulls_last()] if self.newest else []
        return [*own, *[F.col(c).desc_nulls_last() for c in (*first, "source_rank", "source_file")]]

    def _batches(self, names: tuple[str, ...]) -> DataFrame:
        r = self.spark.read.schema(self.schema).option("basePath", f"{self.root}/batches")
        return r.parquet(*[f"{self.root}/batches/batch={b}" for b in names])

    def stage(self, rows: DataFrame, number: int, tag: str | None = None, n: int = 0) -> str:
        """Write a batch that no manifest lists yet; returns its name. Of rows with one key in the batch the newest file's stays.

        ``n`` is the number of rows, if known: a large batch is dealt out over more tasks.
        """
        have = rows.columns
        rank = F.col("source_rank") if "source_rank" in have else F.lit(None).cast("timestamp")
        file = F.col("source_file") if "source_file" in have else F.lit(None).cast("string")
        name = f"{number:09d}-{uuid.uuid4().hex[:8]}" + (f"-{tag}" if tag else "")
        full = rows.select(*self.names, rank.alias("source_rank"), file.alias("source_file"))
        full = spread(full, n, *self.keys, rows_per_task=BATCH_ROWS_PER_TASK)
        last_wins(full, self.keys, self._order()).write.partitionBy("day").parquet(f"{self.root}/batches/batch={name}")
        return name

    def staged(self, name: str) -> DataFrame:
        return self._batches((name,)).select(*self.names)

    def drop_batch(self, name: str) -> None:
        self._fs().delete(self._path(f"batches/batch={name}"), True)


def before_after(before: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per day of the new rows: rows and sums before and after, rows added, replaced and really changed.

    Only the days of the new rows are read of the old ones: their days, a few values, prune the partitions.
    """
    days = new.select("day").distinct()
    b = before.join(days, "day", "left_semi").select(*keys, F.col("day").alias("_bd"), F.col(value).alias("_b"), F.lit(True).alias("_old"))
    a = new.select(*keys, F.col("day").alias("_ad"), F.col(value).alias("_a"), F.lit(True).alias("_new"))
    j = b.join(a, keys, "full_outer").withColumn("day", F.coalesce("_ad", "_bd"))
    old, fresh = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    return j.groupBy("day").agg(
        F.count_if(old).alias("rows_before"), F.count(F.lit(1)).alias("rows_after"), F.count_if(fresh & ~old).alias("added"), F.count_if(fresh & old).alias("replaced"),
        F.count_if(fresh & old & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"), F.sum("_b").alias("sum_before"), F.sum(F.when(fresh, F.col("_a")).otherwise(F.col("_b"))).alias("sum_after"),
    )


def ingest(table: VersionedTable, rows: DataFrame, checks: DataFrame, value: str, dry_run: bool = False) -> DataFrame:
    """Check, stage, compare and switch; returns the report (accepted, committed, version, day and the figures of ``before_after``).

    ``checks`` holds (file, rule, severity, n) of all files of the delivery. With an error among them nothing is written, and the report
    has one row without a day. A dry run reports what would change and removes what it staged.
    """
    spark, seen = table.spark, table.version()
    errors = checks.where("severity = 'error'").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]
    names = "accepted boolean, committed boolean, version long, errors long, day date, rows_before long, rows_after long, added long, replaced long, changed long, sum_before long, sum_after long"
    if errors:
        return spark.createDataFrame([(False, False, seen.number, errors, *[None] * 8)], names)
    batch = table.stage(rows, seen.number + 1)
    from flowspark.functions.lineage import cut

    try:
        change = cut(before_after(table.read(seen), table.staged(batch), table.keys, value))
        now = seen if dry_run else table.commit(seen, (*seen.batches, batch))
    except Exception:
        table.drop_batch(batch)
        raise
    if dry_run:
        table.drop_batch(batch)
    kept = [F.col(c).cast("long").alias(c) for c in ("rows_before", "rows_after", "added", "replaced", "changed", "sum_before", "sum_after")]
    return change.select(F.lit(True).alias("accepted"), F.lit(not dry_run).alias("committed"), F.lit(now.number).cast("long").alias("version"), F.lit(0).cast("long").alias("errors"), "day", *kept)
