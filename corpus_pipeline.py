"""From raw documents to piece ids: language ID, quality, near duplicates, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last return the columns
of ``docs``. Rows that a stage can't judge are treated as its operator defines: texts without letters are of no language and go;
empty texts that reach a later stage get a score like any other; rows without an id are never dropped as duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import decontaminate, jaccard, langid, pieces, quality
from flowspark.llm.common import table, written
from flowspark.llm.queries import PIECE_MODEL


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    found = langid.detect(docs, langid.fit(docs), out=("_lang_pred", "_lang_score"))
    return found.where("_lang_pred <> 'und'").select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble takes for good."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model, out=("_quality_score", "_quality_predicted")).where("_quality_predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_first(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids."""
    return pieces.encode(docs, pieces.load(PIECE_MODEL), out_col="piece_ids")


STAGES = [
    ("language_id", language_id), ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("sentencepiece", sentencepiece),
]

#: Bloom filters, tree ensembles and piece search are no SQL; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
