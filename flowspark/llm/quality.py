"""Quality classifier: a sparse rule ensemble over text statistics.

Trees grown on the labelled rows give conjunctive rules (every path from a root to a node); a lasso logistic regression
weights the rules and drops most; the rest is compiled into one Spark column expression. Both fits run distributed over
all labelled rows outside the held-out part; only trees, rules and weights, bounded by parameters, reach the driver.

Defined cases: a null or empty text has all statistics 0 and a score like any other; rows without a label don't train;
with one class only the score is 1 or 0 throughout, without labels 0.5; several labels of a document all count; repeated rows
count each time; an empty table gives an empty result; other columns are kept and may have any name.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from flowspark.llm.common import cut, held_out

STATS = "chars words word_length upper digits symbols points spaces distinct_words distinct_lines line_length sentence_length short_words calls".split()


#: Character classes: 0 other letters, 1 capitals, 2 digits, 3 points, 4 symbols, 5 white space, 6 exclamation marks.
_CLASSES = 7


@lru_cache(1)
def _class_table() -> np.ndarray:
    def kind(c: str) -> int:
        if c == "!":
            return 6
        if c in ".,;:?'\"()-":
            return 3
        if c.isspace():
            return 5
        return {"Lu": 1, "Nd": 2}.get(k := unicodedata.category(c), 0 if k[0] in "LMN" else 4)

    return np.array([kind(chr(i)) for i in range(0x10000)], dtype=np.int8)


def text_statistics(text: str | None) -> tuple[float, ...]:
    """``STATS`` of one text; shares are of all characters, words or lines."""
    n = len(text or "")
    if not n:
        return (0.0,) * len(STATS)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    count = np.bincount(_class_table()[np.minimum(codes, 0xFFFF)], minlength=_CLASSES)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    w, stops = max(len(words), 1), sum(x[-1] in ".!?" for x in words)
    return (
        math.log1p(n), math.log1p(len(words)), lengths.sum() / w, count[1] / n, count[2] / n, count[4] / n, (count[3] + count[6]) / n, count[5] / n, len(set(words)) / w, len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)), math.log1p(len(words) / (stops + 1)), (lengths <= 3).sum() / w, count[6] / n,
    )


@F.pandas_udf(StructType([StructField(k, DoubleType()) for k in STATS]))
def statistics(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_statistics(t) for t in text], columns=STATS)


@dataclass(frozen=True)
class Rule:
    """lows and highs: statistic -> bound; the rule holds where low < value <= high for all of them."""

    bounds: tuple[tuple[int, float, float], ...]

    def column(self, stats: Column) -> Column:
        tests = []
        for i, low, high in self.bounds:
            v = stats[STATS[i]]
            tests += [v > low] * (low > -float("inf")) + [v <= high] * (high < float("inf"))
        return reduce(lambda a, b: a & b, tests)


@dataclass
class Model:
    intercept: float
    rules: list[tuple[Rule, float]]
    constant: float | None = None

    def score(self, stats: Column) -> Column:
        """Chance of label 1 as one expression over the statistics."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        total = reduce(lambda a, b: a + b, [F.when(r.column(stats), w).otherwise(0.0) for r, w in self.rules], F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-total))


def tree_rules(tree) -> set[Rule]:
    """The paths from the root to every other node."""
    found: set[Rule] = set()

    def walk(node, box: dict[int, tuple[float, float]]) -> None:
        if box:
            found.add(Rule(tuple((i, lo, hi) for i, (lo, hi) in sorted(box.items()))))
        if node.getClass().getSimpleName() != "InternalNode":
            return
        i, at = node.split().featureIndex(), node.split().threshold()
        lo, hi = box.get(i, (-float("inf"), float("inf")))
        walk(node.leftChild(), box | {i: (lo, min(hi, at))})
        walk(node.rightChild(), box | {i: (max(lo, at), hi)})

    walk(tree._java_obj.rootNode(), {})
    return found


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", trees: int = 16, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> Model:
    """Rules and weights from the labelled documents outside the held-out part."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label_col).cast("double").alias("y"))
    rows = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), "text").select("_id", statistics(F.col("text")).alias("s")).join(marks, "_id").select("y", "s.*")
    rows = cut(rows)
    seen = {r["y"]: r["n"] for r in rows.where("y in (0, 1)").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return Model(0.0, [], float(next(iter(seen), 0.5)))
    rows = rows.where("y in (0, 1)").withColumn("w", F.when(F.col("y") == 1, 0.5 / seen[1.0]).otherwise(0.5 / seen[0.0]) * sum(seen.values()))
    grown = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featuresCol="x", labelCol="y", weightCol="w", seed=seed, featureSubsetStrategy="onethird").fit(VectorAssembler(inputCols=STATS, outputCol="x").transform(rows))
    rules = sorted(set().union(*[tree_rules(t) for t in grown.trees]), key=lambda r: r.bounds)
    if not rules:
        return Model(0.0, [], seen[1.0] / sum(seen.values()))
    s = F.struct(*STATS)
    named = rows.select("y", *[r.column(s).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    matrix = cut(VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(named).select("y", "x"))
    lasso = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(matrix)
    return Model(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w != 0.0])


def classify(docs: DataFrame, model: Model, threshold: float = 0.7, out: tuple[str, str] = ("quality_score", "quality_predicted")) -> DataFrame:
    """``docs`` with the score and the predicted label (1 from the threshold on) under the names ``out``."""
    scored = docs.withColumn("_stats", statistics(F.col("text"))).withColumn(out[0], model.score(F.col("_stats"))).drop("_stats")
    return scored.withColumn(out[1], (F.col(out[0]) >= threshold).cast("int"))
