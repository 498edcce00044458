"""Merkle fixity audit of archived records.

Records live in files at byte offsets; several replicas should hold the same bytes. Each replica is summed up by a tree:
a leaf is the SHA-256 of a record, a node of level 1 covers the leaves that start in one range of offsets, a node of level
h + 1 covers ``fanout`` neighbouring nodes of level h, the highest node of a file is its root, and one more digest covers
all files. The audit compares roots and descends only below nodes whose digests differ.

Defined cases: a null payload is a record without bytes; a null file name is the empty name; repeated rows of a replica at
one place form one leaf of their digests and counts, so an extra copy is a difference; a replica without any record of a
file differs in that file; an empty table, or one replica, gives no findings; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import cut


def record(uri: Column, payload: Column, record_id: Column) -> Column:
    """Bytes of a response record."""
    body = F.coalesce(payload.cast("string"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(uri.cast("string"), F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def file_of(page_id: Column, url: Column, ids_per_file: int = 256) -> Column:
    """Neighbouring ids share a file; records without an id are dealt over files of their own."""
    own = F.concat(F.lit("part-"), F.floor(page_id / ids_per_file).cast("string"))
    return F.coalesce(own, F.concat(F.lit("part-none-"), F.pmod(F.xxhash64(url), F.lit(4096)).cast("string")))


def place_records(records: DataFrame) -> DataFrame:
    """Add the ``offset`` of each record (file, page_id, length, digest, ...) in its file; files are in id order.

    Only ids, lengths and digests are ordered, never the texts.
    """
    order = Window.partitionBy("file").orderBy("page_id", "length", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0).cast("long")))


def _digests(col: str) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("at", col))).getField(col), ",").cast("binary"), 256)


def build_tree(leaves: DataFrame, range_bytes: int = 65536, fanout: int = 16) -> list[DataFrame]:
    """Levels of the trees of all replicas: [records, ranges, ..., file roots, replica roots].

    ``leaves`` has (replica, file, offset, length, digest). The number of levels follows from the largest offset.
    """
    rec = leaves.select("replica", F.coalesce("file", F.lit("")).alias("file"), F.col("offset").alias("at"), "length", F.coalesce("digest", F.lit("")).alias("digest"))
    # several records at one place count as one leaf of all their digests
    rec = rec.groupBy("replica", "file", "at", "digest").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    told = F.when(F.col("n") == 1, F.col("digest")).otherwise(F.concat("digest", F.lit("*"), F.col("n").cast("string")))
    rec = rec.groupBy("replica", "file", "at").agg(F.array_join(F.sort_array(F.collect_list(told)), "+").alias("digest"), F.max("length").alias("length"))
    rec = cut(rec.withColumn("up", F.floor(F.col("at") / range_bytes).cast("long")))
    levels, top = [rec], rec.agg(F.max("up")).first()[0] or 0
    while True:
        below = levels[-1]
        node = below.groupBy("replica", "file", F.col("up").alias("at")).agg(_digests("digest").alias("digest"))
        node = cut(node.withColumn("up", F.floor(F.col("at") / fanout).cast("long")))
        levels.append(node)
        if top == 0:
            break
        top //= fanout
    # files are gathered in buckets first, so that no task sees every file of a replica
    part = levels[-1].withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(1024))).groupBy("replica", "bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("file", "digest"))).getField("digest"), ",").cast("binary"), 256).alias("digest"))
    return [*levels, part.groupBy("replica").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("bucket", "digest"))).getField("digest"), ",").cast("binary"), 256).alias("digest"))]


def _mismatched(level: DataFrame, replicas: int) -> DataFrame:
    """Nodes that differ between replicas or lack in one."""
    seen = level.groupBy("file", "at").agg(F.count_distinct("replica").alias("have"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    return seen.where((F.col("have") < replicas) | (F.col("lo") != F.col("hi"))).select("file", "at")


def audit(leaves: DataFrame, range_bytes: int = 65536, fanout: int = 16) -> DataFrame:
    """Records that differ: (file, offset, replica, kind), kind ``altered``, ``missing`` or ``unsettled``.

    The digest held by most replicas is taken as right; where no digest has a majority, all replicas are ``unsettled``.
    """
    *levels, roots = build_tree(leaves, range_bytes, fanout)
    names = sorted(r["replica"] for r in roots.select("replica").collect())
    same = roots.select("digest").distinct().count() <= 1
    suspects = _mismatched(levels[-1].limit(0) if same else levels[-1], len(names))
    for below in reversed(levels[:-1]):
        inside = below.join(suspects.withColumnRenamed("at", "up"), ["file", "up"], "left_semi")
        suspects = cut(_mismatched(inside, len(names)))
    found = levels[0].join(suspects, ["file", "at"], "left_semi").select("file", "at", "replica", "digest")
    # every replica gets a row, also one that lost the record
    votes = found.groupBy("file", "at").agg(F.map_from_entries(F.collect_list(F.struct("replica", "digest"))).alias("has"))
    all_of = F.array(*[F.struct(F.lit(n).alias("replica"), F.coalesce(F.element_at("has", F.lit(n)), F.lit("")).alias("digest")) for n in names]) if names else F.array().cast("array<struct<replica:int,digest:string>>")
    cells = votes.select("file", "at", F.explode(all_of).alias("c"), F.map_values("has").alias("held")).select("file", "at", "c.*", "held")
    backed = F.size(F.filter("held", lambda d: d == F.col("digest")))
    best = F.array_max(F.transform("held", lambda d: F.size(F.filter("held", lambda e: e == d))))
    kind = F.when(best * 2 <= len(names), "unsettled").when(F.col("digest") == "", "missing").otherwise("altered")
    return cells.where((best * 2 <= len(names)) | (backed < best)).select("file", F.col("at").alias("offset"), "replica", kind.alias("kind"))
