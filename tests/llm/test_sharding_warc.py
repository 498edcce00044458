"""Sampled splitters and the Merkle audit against brute force, with odd inputs."""

import zlib

from pyspark.sql import functions as F

from flowspark.llm import sharding, warc

DOCS = "doc_id long, text string, shard string"


def shards_of(spark, rows, **more):
    return sharding.assign_shards(spark.createDataFrame(rows, DOCS), **more).collect()


def test_equal_bytes_gapless_slots_and_hot_copies(spark):
    rows = [(i, "copy " * 20 if i % 3 == 0 else f"text {i} " * (i % 17), None) for i in range(3000)] + [(None, None, None), (7, "", "x"), (7, "", "x"), (9000, "long " * 3000, "x")]
    got = shards_of(spark, rows, shards=8)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(8):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 8) <= largest
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.text_crc32 for r in order] == sorted(r.text_crc32 for r in got)


def test_ranges_are_subdivided(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, F.lit("same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    placed, sizes = sharding.split_ranges(sharding.keys_of(docs), 32)
    assert max(s["rows"] for s in sizes) <= 2 * 4000 / 32 + 1 and sum(s["rows"] for s in sizes) == 4000


def test_empty_and_single(spark):
    assert shards_of(spark, []) == []
    assert [r.slot for r in shards_of(spark, [(1, "a", None)])] == [0]


def leaves(spark, rows):
    return spark.createDataFrame(rows, "replica int, file string, offset long, length long, digest string, kind string")


def test_audit_finds_exactly_what_differs(spark):
    good = [(f"f{i % 3}", 1000 * (i // 3), 900, f"d{i}") for i in range(900)]
    rows = [(r, *g, "x") for r in range(3) for g in good]
    rows.remove((1, "f1", 5000, 900, "d16", "x"))
    rows[rows.index((2, "f2", 270000, 900, "d812", "x"))] = (2, "f2", 270000, 900, "bad", "x")
    rows[rows.index((0, "f0", 0, 900, "d0", "x"))] = (0, "f0", 0, 900, None, "x")
    rows += [(2, "f0", 299000, 900, "d897", "x")]  # a second copy
    got = sorted((r.file, r.offset, r.replica, r.kind) for r in warc.audit(leaves(spark, rows)).collect())
    assert got == [("f0", 0, 0, "missing"), ("f0", 299000, 2, "altered"), ("f1", 5000, 1, "missing"), ("f2", 270000, 2, "altered")]


def test_audit_of_equal_single_and_no_replicas(spark):
    rows = [(r, None, 10 * i, 10, "d", "x") for r in range(2) for i in range(5)]
    assert warc.audit(leaves(spark, rows)).count() == 0
    assert warc.audit(leaves(spark, rows[:5])).count() == 0
    assert warc.audit(leaves(spark, [])).count() == 0
    lost = warc.audit(leaves(spark, rows[:-1])).collect()
    assert [(r.offset, r.kind) for r in lost] == [(40, "unsettled"), (40, "unsettled")]
