"""Language filters and rule ensemble: bits against sets, held-out accuracy, odd inputs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.llm import langid, quality
from flowspark.llm.common import held_out, table

DIR = "/root/testdata/sf0.01"
real = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables not present")
DOC = "doc_id long, text string, lang string, score string"


def test_ngrams_against_plain_loops():
    def plain(text):
        out = set()
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            w = f" {word} "
            out |= {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)}
        return out

    for t in ("The cat, the dog!", "Été où ß", "a", "x1y 😀 漢字"):
        assert len(np.unique(langid.ngrams(t))) == len(plain(t))
    assert all(not len(langid.ngrams(t)) for t in (None, "", " 12 !?", "\n"))


def test_many_languages_and_odd_rows(spark):
    rows = [(i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + (k * 7 + j) % 26)}q" for j in range(20)), f"l{k:02d}", "s") for k in range(70) for i in range(k * 10, k * 10 + 8)]
    rows += [(9001, None, "l01", "s"), (9002, "", "l01", "s"), (9003, "123 !!", "l01", "s"), (None, rows[0][1], None, "s"), (9004, rows[-1][1] * 500, None, "s")]
    df = spark.createDataFrame(rows, DOC)
    out = langid.detect(df, langid.fit(df)).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "lang", "score", "lang_pred", "lang_score"}
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in out}
    assert got[9001] == got[9002] == got[9003] == ("und", 0.0)
    assert got[None][0] == "l00" and got[9004][0] == "l69"
    assert sum(r.lang == r.lang_pred for r in out if r.lang and r.doc_id < 9000) >= 0.97 * 560
    nothing = langid.fit(df.where("lang is null"))
    assert {r.lang_pred for r in langid.detect(df, nothing).collect()} == {"und"}
    assert langid.detect(df.limit(0), nothing).count() == 0


@real
def test_language_accuracy_on_held_out_rows(spark):
    docs = table(spark, DIR, "documents")
    out = langid.detect(docs, langid.fit(docs)).where(held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert out > 0.98


@real
def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    model = quality.fit(docs, labels)
    assert 0 < len(model.rules) < 100
    out = quality.classify(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).groupBy("quality").agg(F.avg("quality_predicted").alias("p"), F.min("quality_score"), F.max("quality_score")).collect()
    share = {r.quality: r.p for r in out}
    assert share[1] > 0.95 and share[0] < 0.2 and all(0 <= r[2] <= r[3] <= 1 for r in out)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(i, "good words here " * 20 if i % 2 else "!!! ### " * 20, None, "s") for i in range(80)] + [(None, None, None, None), (500, "", None, None), (501, "x" * 300000, None, None)], DOC)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(80)] + [(3, None, None), (None, 1, None), (7, 1, None), (999, 1, None)], "doc_id long, quality int, text string")
    out = quality.classify(docs, quality.fit(docs, labels)).collect()
    assert len(out) == 83 and set(out[0].asDict()) == {"doc_id", "text", "lang", "score", "quality_score", "quality_predicted"}
    assert all(r.quality_predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 80) and all(0 <= r.quality_score <= 1 for r in out)
    one = quality.fit(docs, labels.where("quality = 1"))
    none = quality.fit(docs, labels.limit(0))
    assert (one.constant, none.constant) == (1.0, 0.5)
    assert quality.classify(docs.limit(0), none).count() == 0


def test_rules_compile_to_the_same_values(spark):
    rule = quality.Rule(((0, 1.0, 3.0), (4, -float("inf"), 0.5)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["", "a", "abc def", "1234567", "x" * 100])], "doc_id long, text string")
    got = {r.text: r.v for r in docs.withColumn("s", quality.statistics("text")).select("text", rule.column(F.col("s")).alias("v")).collect()}
    stats = {t: quality.text_statistics(t) for t in got}
    assert got == {t: 1.0 < s[0] <= 3.0 and s[4] <= 0.5 for t, s in stats.items()}
