"""Folders whose files differ in separator, encoding, header and column order.

The dialect of a file is judged over all its bytes in one distributed pass over its lines: the encoding is UTF-8 only if every line
is valid, the separator is the most frequent candidate of its first line, and the first line is a header if it names an expected column. Files of one dialect
and header are read together, and the groups are joined by column name. What reaches the driver is one row per dialect, with the file
names that a scan lists anyway.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = (",", ";", "\t")


@dataclass(frozen=True)
class Dialect:
    """How a group of files is written."""

    sep: str
    encoding: str
    header: bool
    files: tuple[str, ...]

    @property
    def decimal_comma(self) -> bool:
        """Files that separate by semicolons write numbers with a comma."""
        return self.sep == ";"


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, size, modified) of all files with content below a folder; contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def file_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, at_start, line_id, line): the lines of all files as they are stored; ids rise inside each block of a file."""
    r = spark.read.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    meta = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return r.text(path).select(meta[0].alias("file"), (meta[1] == 0).alias("at_start"), F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))


def file_dialects(spark: SparkSession, path: str, glob: str | None = None, names: str | None = None) -> DataFrame:
    """(file, sep, encoding, header, first_line, lines) of every file that has a line.

    ``names`` is a column that a header line must name; without it every file has a header.
    """
    first = F.min_by(F.when(F.col("at_start"), F.col("line")), F.when(F.col("at_start"), F.col("line_id")))
    per = file_lines(spark, path, glob).groupBy("file").agg(first.alias("first_line"), F.bool_and(F.is_valid_utf8("line")).alias("valid"), F.count(F.lit(1)).alias("lines"))
    counts = [F.length("first_line") - F.length(F.replace("first_line", F.lit(s))) for s in SEPARATORS]
    most = F.greatest(*counts)
    sep = F.lit(SEPARATORS[0])
    for s, n in reversed(list(zip(SEPARATORS, counts))):
        sep = F.when((n == most) & (n > 0), F.lit(s)).otherwise(sep)
    header = F.lower("first_line").contains(names.lower()) if names else F.lit(True)
    encoding = F.when(F.col("valid"), F.lit("UTF-8")).otherwise(F.lit("windows-1252"))
    return per.select("file", sep.alias("sep"), encoding.alias("encoding"), header.alias("header"), "first_line", "lines")


def dialects(spark: SparkSession, path: str, glob: str | None = None, names: str | None = None) -> list[Dialect]:
    """Files grouped by dialect and header, in a fixed order."""
    per = file_dialects(spark, path, glob, names)
    head = F.when(F.col("header"), F.hash("first_line")).otherwise(F.lit(0))
    groups = per.groupBy("sep", "encoding", "header", head.alias("h")).agg(F.array_sort(F.collect_list("file")).alias("files")).collect()
    return sorted((Dialect(r["sep"], r["encoding"], r["header"], tuple(unquote(f) for f in r["files"])) for r in groups), key=lambda d: d.files)
