"""Language identification by a bit-sliced Bloom filter over character n-grams.

Every slot of the filter holds one bit per language. An n-gram sets its language's bit in ``hashes`` slots; the AND of its
slots returns all languages that contain it at once. Over a text, the set bits are counted per language, the hits expected
from false positives are taken off, and the language with most corrected hits wins. Its share of the counted n-grams is the score.

Only n-grams that are much more frequent in a language than in the others enter its filter, so shared ones don't blur it.

Defined cases: a text without letters, or null, is ``und`` with score 0; ties go to the first language in order of name;
rows without a language, and languages without a single n-gram, don't train; without any training row every text is ``und``;
repeated rows count each time; an empty table gives an empty result; other columns are kept. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from flowspark.llm.common import cut, held_out
from flowspark.llm.hashing import mix

_EDGE = 0x20


def ngrams(text: str | None, widths: tuple[int, ...] = (2, 3, 4)) -> np.ndarray:
    """Hashes of the character n-grams of the lower-case words, each word between two spaces; empty without letters."""
    low = (text or "").lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.empty(0, dtype=np.uint64)
    letter = _is_letter(codes)
    if not letter.any():
        return np.empty(0, dtype=np.uint64)
    codes = np.where(letter, codes, _EDGE)
    codes = np.concatenate([[_EDGE], codes, [_EDGE]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != _EDGE) | (codes[:-1] != _EDGE)])]
    out = []
    for w in widths:
        n = len(codes) - w + 1
        if n <= 0:
            continue
        acc = codes[:n].copy()
        inner = np.zeros(n, dtype=bool)  # a space inside an n-gram would span two words
        for i in range(1, w):
            acc = (acc << np.uint64(16)) ^ codes[i : i + n]
            if i < w - 1:
                inner |= codes[i : i + n] == _EDGE
        out.append(acc[~inner] * np.uint64(8) + np.uint64(w))
    with np.errstate(over="ignore"):
        return mix(np.concatenate(out) if out else np.empty(0, dtype=np.uint64))


_LETTERS: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x30000)])
    return _LETTERS[np.minimum(codes, 0x2FFFF)]


@dataclass
class Filter:
    """``slots``: one row of language bits per slot; ``false_rate``: chance that an absent n-gram shows a language's bit."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    false_rate: np.ndarray

    def members(self, grams: np.ndarray) -> np.ndarray:
        """Words of language bits for each n-gram."""
        size = np.uint64(len(self.slots))
        step = (grams >> np.uint64(32)) | np.uint64(1)
        found = self.slots[(grams % size).astype(np.int64)]
        with np.errstate(over="ignore"):
            for i in range(1, self.hashes):
                found = found & self.slots[((grams + np.uint64(i) * step) % size).astype(np.int64)]
        return found

    def decide(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text)
        if not len(grams) or not self.languages:
            return "und", 0.0
        bits = self.members(grams)
        hits = np.array([np.count_nonzero(bits[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(self.languages))], dtype=float)
        right = np.maximum(hits - len(grams) * self.false_rate, 0.0) / (1.0 - self.false_rate)
        best = int(np.argmax(right))
        total = right.sum()
        return self.languages[best], float(right[best] / total) if total > 0 else 0.0


def _slot_rows(hashes: int, size: int):
    """mapInPandas function: (lang index, gram) to the slots it sets."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = b["gram"].to_numpy().view(np.uint64)
            step = (g >> np.uint64(32)) | np.uint64(1)
            with np.errstate(over="ignore"):
                at = np.concatenate([((g + np.uint64(i) * step) % np.uint64(size)).astype(np.int32) for i in range(hashes)])
            yield pd.DataFrame({"slot": at, "lang": np.tile(b["lang"].to_numpy(), hashes)}).drop_duplicates()

    return rows


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 4000, size: int = 1 << 18, hashes: int = 3, min_count: int = 3, contrast: float = 3.0) -> Filter:
    """Learn the filter from about ``max_docs`` documents of each language outside the held-out part, chosen by a hash of their id.

    An n-gram enters the filter of a language in which it occurs ``min_count`` times and ``contrast`` times as often as on
    average over the languages. The filter has ``size`` slots whatever the data: no more rows than that reach the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(have)
    if not languages:
        return Filter([], np.zeros((1, 1), dtype=np.uint64), hashes, np.zeros(0))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, max_docs / have[k])))])
    index = {k: i for i, k in enumerate(languages)}

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                grams = [ngrams(t) for t in texts]
                g, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pd.DataFrame({"lang": np.full(len(g), index[lang], dtype=np.int32), "gram": g.view(np.int64), "n": n.astype(np.int64)})

    chosen = rows.where(draw < F.element_at(rate, F.col("lang"))).select("text", "lang")
    seen = cut(chosen.mapInPandas(counts, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Filter([], np.zeros((1, 1), dtype=np.uint64), hashes, np.zeros(0))
    share = F.col("n") / F.element_at(F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("lang"))
    average = seen.withColumn("share", share).groupBy("gram").agg(F.collect_list(F.struct("lang", "n", "share")).alias("by"), (F.sum("share") / len(totals)).alias("mean"))
    own = average.select("gram", "mean", F.explode("by").alias("b")).where((F.col("b.n") >= min_count) & (F.col("b.share") >= min(contrast, 0.999 * len(totals)) * F.col("mean"))).select(F.col("b.lang").alias("lang"), "gram")
    words = -(-len(languages) // 64)
    bits = own.mapInPandas(_slot_rows(hashes, size), "slot int, lang int").groupBy("slot").agg(*[
        F.bit_or(F.when(F.floor(F.col("lang") / 64) == w, F.expr(f"shiftleft(1L, lang - {64 * w})")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)
    ]).toArrow()
    slots = np.zeros((size, words), dtype=np.uint64)
    for w in range(words):
        slots[bits["slot"].to_numpy(), w] = bits[f"w{w}"].to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(slots[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) / size for k in range(len(languages))])
    return Filter(languages, slots, hashes, fill**hashes)


def detect(docs: DataFrame, model: Filter, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the predicted language and its score under the names ``out``. The filter's fixed size bounds what is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.decide(t) for t in text], columns=["p", "s"])

    udf = F.pandas_udf(decide, StructType([StructField("p", StringType()), StructField("s", DoubleType())]))
    return docs.withColumn("_language", udf(F.col(text_col))).withColumns({out[0]: F.col("_language.p"), out[1]: F.col("_language.s")}).drop("_language")
