"""Every stage and query of the subpackage on the smallest folder; the pipeline against a plain version."""

import os
import sys

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline as cp
from __spark_entry__ import oracle_sql, queries
from check import TABLES, norm
from flowspark.llm import dom, langid, quality
from flowspark.llm.common import table
from test_jaccard import brute

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables not present")


def test_pipeline_against_a_plain_version(spark):
    docs = table(spark, DIR, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    lang = langid.fit(docs)
    kept = {i: t for i, t in rows.items() if lang.decide(t)[0] != "und"}
    left = docs.where(F.col("doc_id").isin(list(kept)))
    model = quality.fit(left, table(spark, DIR, "labels"))
    good = {r.doc_id for r in quality.classify(left, model).where("quality_predicted = 1").collect()}
    classes = brute([(i, kept[i]) for i in sorted(good)], 5, 80)
    firsts = {d for d, _, c in classes if d == c}
    bench = [r.text for r in table(spark, DIR, "benchmark").collect()]
    grams = lambda t: {tuple(w[k : k + 8]) for w in [[x.strip(".,").lower() for x in t.split()]] for k in range(len(w) - 7)}
    asked = [grams(b) for b in bench]
    clean = {d for d in firsts if not any(len(grams(kept[d]) & g) >= 0.5 * len(g) for g in asked)}
    got = cp.run(spark, DIR).collect()
    assert {r.doc_id for r in got} == clean and len(got) == len(clean)
    sp = sentencepiece.SentencePieceProcessor(model_file=cp.PIECE_MODEL)
    assert all(r.piece_ids == sp.encode(r.text) for r in got)
    assert len(clean) < len(firsts) < len(good) < len(rows)


def test_stages_keep_columns_and_survive_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, lang_pred string, k string"
    odd = [(1, None, None, None, None, "a", "b", "c"), (2, "", "en", "s", 0, None, None, None), (None, "the and of to " * 30, "en", "s", 9, None, "x", None), (3, "the and of to in " * 9000, "en", "s", 9, None, None, None), (4, "12 !!", "en", "s", 5, None, None, None)]
    for df in (spark.createDataFrame(odd, schema), spark.createDataFrame(odd + odd, schema), spark.createDataFrame([], schema)):
        docs = df
        for name, stage in cp.STAGES:
            out = stage(spark, docs, DIR)
            assert out.columns == docs.columns + (["piece_ids"] if name == "sentencepiece" else [])
            assert out.count() <= docs.count()
            docs = out if name != "quality_classifier" else docs


@pytest.mark.parametrize("name", ["op6_warc_fixity", "op10_chat_formatting"])
def test_twins(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = queries()[name](spark, DIR)
    cols = sorted(df.columns)
    cur = con.execute(oracle_sql()[name])
    idx = [[c[0] for c in cur.description].index(c) for c in cols]
    assert norm(tuple(r[c] for c in cols) for r in df.collect()) == norm(tuple(r[i] for i in idx) for r in cur.fetchall())


@pytest.mark.parametrize("name, key", [("op2_sharding", "doc_id"), ("op3_quality", "doc_id"), ("op4_sentencepiece", "doc_id"), ("op5_language_id", "doc_id"), ("op7_ngram_jaccard", "doc_id"), ("op8_fingerprints", "doc_id"), ("op9_html_extraction", "page_id")])
def test_one_row_per_input_row(spark, name, key):
    out = queries()[name](spark, DIR)
    source = table(spark, DIR, "pages" if key == "page_id" else "documents")
    assert sorted(r[0] for r in out.select(key).collect()) == sorted(r[0] for r in source.select(key).collect())
    if name == "op4_sentencepiece":
        assert out.where("not round_trip").count() == 0


def test_model_without_pages_still_reads_a_page():
    assert dom.model_from({}).text("<article><h1>Head</h1><p>" + "A sentence that is long enough. " * 9 + "</p></article>").startswith("Head\n\nA sentence")
