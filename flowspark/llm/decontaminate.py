"""Benchmark decontamination by templates.

Texts become sequences of canonical tokens: words in lower case without surrounding punctuation; numbers, names and units
become typed placeholders whose original value is kept as a slot. Windows of canonical tokens are hashed and joined with
those of the benchmark, so a question whose numbers, names or units were exchanged still meets its template. For each
(document, item) the slots of the matching windows must agree: one value of the item stands for one value of the document,
or of one occurrence of the item in it. An occurrence has one distance between its windows and the item's, or, with words
put in or left out, distances no more than half an item apart; an item spread over the document counts as a whole.

A name is a capitalised word that doesn't begin a sentence; a unit is a unit word after a number. Windows with fewer than
``min_literals`` ordinary words say too little as templates; they meet with their own values only. Coverage is that of the
template windows or that of all windows, whichever is greater. An item shorter than a window is one window.

Defined cases: null and empty texts match nothing; rows with equal
doc_id count as one document, likewise items; a null id is an id of its own; repeated rows change nothing; empty tables
give no findings; extra columns are ignored. Whole texts are read, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import cut
from flowspark.llm.hashing import bitmap, in_bitmap, rolling

WORD, NUM, NAME, QUANTITY, UNIT = range(5)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/'-]*%?")
_QUANTITY = re.compile(r"[+-]?\d[\d.,]*([^\W\d_]{1,4})")
#: Unit words, and numbers written as words that no ordinary word of the four languages equals.
UNITS = frozenset("km m cm mm kg g mg t lb lbs oz l ml cl s sec min h hr hrs hour hours day days week weeks month months year years mile miles foot feet inch inches degree degrees percent dollar dollars euro euros cent cents usd eur kwh watt watts volt volts heures jours euros stunden tage minuten horas minutos minutes seconds".split())
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_EXACT = np.uint64(0xA24BAED4963EE407)  # sets windows of own values apart from templates
_PUNCTUATION = ".,;:!?\"'()[]"


class Canon(dict):
    """word -> index into growing arrays of its canonical hash, its type, its value and whether it ends a sentence."""

    LIMIT = 500_000

    def __init__(self) -> None:
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.values: list[str] = []
        self.hashes, self.types, self.ends = np.zeros(4096, dtype=np.uint64), np.zeros(4096, dtype=np.int8), np.zeros(4096, dtype=bool)

    def __missing__(self, word: str) -> int:
        bare = word if word.isalpha() else word.strip(_PUNCTUATION)
        low = bare.lower()
        kind = WORD
        if bare.isalpha():  # neither number nor quantity
            if low in NUMBER_WORDS:
                kind = NUM
            elif bare[:1].isupper() and bare[1:].islower():
                kind = NAME
            elif low in UNITS:
                kind = UNIT
        else:
            bare = _EDGE.sub("", bare)
            low = bare.lower()
            if (word[-1:] == "%" and bare[-1:].isdigit()) or low in NUMBER_WORDS or (bare and _NUMBER.fullmatch(bare)):
                kind = NUM
            elif (m := _QUANTITY.fullmatch(bare)) and m[1].lower() in UNITS:
                kind = QUANTITY
            elif bare[:1].isupper() and bare[1:].islower():
                kind = NAME
            elif low in UNITS:
                kind = UNIT
        self[word] = at = len(self.values)
        if at == len(self.hashes):
            self.hashes, self.types, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.types, self.ends))
        self.hashes[at] = xxhash.xxh3_64_intdigest(low) if bare else 0
        self.types[at] = kind if bare else -1
        self.ends[at] = word.rstrip("\"')]»”")[-1:] in {".", "!", "?", ":", ";"}
        self.values.append(low)
        return at

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Canonical hashes, types and values of the words of ``text``."""
        if len(self) > self.LIMIT:
            self.forget()
        words = text.split()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        kind, ends = self.types[at], self.ends[at]
        begins = np.concatenate([[True], ends[:-1]]) if len(at) else ends
        after_number = np.concatenate([[False], kind[:-1] == NUM]) if len(at) else ends
        kind = np.where(((kind == NAME) & begins) | ((kind == UNIT) & ~after_number), WORD, kind)
        keep = kind >= 0  # bare punctuation is no token
        at, kind = at[keep], kind[keep]
        return np.where(kind == WORD, self.hashes[at], kind.astype(np.uint64) + np.uint64(1)), kind, at


def template_windows(width: int, min_literals: int, short: tuple[int, ...] = (), only: np.ndarray | None = None, id_col: str = "id"):
    """mapInPandas function: (id, text) to (id, h, pos, slots, exact) for each window; ``short`` names further widths,
    0 among them that of the whole text; ``only`` is a bitmap of wanted hashes. An exact window has its values in its hash and no slots."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon()
        for batch in batches:
            ids, hs, ps, slots, exact = [], [], [], [], []
            for doc, text in zip(batch[id_col], batch["text"]):
                if not text:
                    continue
                codes, kinds, at = canon.tokens(text)
                literal = np.concatenate([[0], np.cumsum(kinds == WORD)])
                for w in {width, *(s or min(width, len(codes)) for s in short)}:
                    h = rolling(codes, w) if w else codes[:0]
                    if not len(h):
                        continue
                    good = literal[w:] - literal[:-w] >= min(min_literals, w)
                    if not good.all():
                        h = np.where(good, h, rolling(canon.hashes[at], w) ^ _EXACT)
                    keep = np.arange(len(h)) if only is None else np.flatnonzero(in_bitmap(only, h))
                    for p in keep:
                        inside = range(p, p + w) if good[p] else ()
                        slots.append([canon.values[at[i]] for i in inside if kinds[i] != WORD])
                        ids.append(doc)
                        ps.append(p)
                    hs.append(h[keep])
                    exact.append(~good[keep])
            yield pd.DataFrame({id_col: pd.array(ids, dtype="Int64"), "h": np.concatenate([*hs, np.empty(0, np.uint64)]).view(np.int64), "pos": np.array(ps, dtype=np.int64), "slots": pd.Series(slots, dtype=object), "exact": np.concatenate([*exact, np.empty(0, bool)])})

    return windows


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_literals: int = 4, min_coverage: float = 0.5, min_agreement: float = 0.8) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, coverage, slots, slot_agreement, changed) for every document and item that share a template window.

    The figures are those of the whole document or of one occurrence of the item in it: one that is enough for
    ``contaminated``, if there is any, rather a verbatim one, then the one of the greatest coverage."""
    schema = "id long, h long, pos long, slots array<string>, exact boolean"
    items = benchmark.select(F.col("item_id").alias("id"), "text").distinct()
    # the bench side is cut: it feeds the bitmap, the join and the counts
    bench = cut(items.repartition(8, "id", "text").mapInPandas(template_windows(width, min_literals, short=(0,)), schema).select(F.col("id").alias("item_id"), "h", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "exact").distinct())
    lengths = bench.groupBy("item_id").agg(F.count_if(~F.col("exact")).alias("item_templates"), F.count("*").alias("item_windows"))
    tokens = bench.groupBy("item_id").agg((F.max("item_pos") + width).alias("n_tokens"))
    widths = short_widths(items, width)
    hits = docs.select(F.col("doc_id").alias("id"), "text").mapInPandas(template_windows(width, min_literals, short=widths, only=bitmap(bench, "h")), schema)
    met = hits.drop("exact").withColumnRenamed("id", "doc_id").join(bench, "h")
    met = cut(met.where(F.size("slots") == F.size("item_slots")))
    by = ["doc_id", "item_id"]
    # windows at one distance from the item's are one occurrence; distances with small gaps are one with words put in or left out
    far = F.col("pos") - F.col("item_pos")
    steps = met.select(*by, far.alias("far")).distinct().join(tokens.withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    w = Window.partitionBy(*by).orderBy("far")
    steps = steps.withColumn("new", F.when(F.col("far") - F.lag("far").over(w) <= F.col("n_tokens") / 2, 0).otherwise(1)).withColumn("part", F.sum("new").over(w)).select(F.col("doc_id").alias("_d"), F.col("item_id").alias("_i"), F.col("far").alias("_far"), "part")
    met = met.withColumn("far", far).join(steps, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("far") == F.col("_far")))
    tries = F.array(F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("at")), F.struct(F.lit(1).alias("level"), F.col("part").cast("long").alias("at")), F.struct(F.lit(2).alias("level"), F.col("far").alias("at")))
    met = met.select(*by, "item_pos", "exact", "slots", "item_slots", F.explode(tries).alias("try")).select(*by, "try.level", "try.at", "item_pos", "exact", "slots", "item_slots")
    per = [*by, "level", "at"]
    cover = met.groupBy(*per, "item_pos").agg(F.bool_and("exact").alias("exact")).groupBy(*per).agg(F.count_if(~F.col("exact")).alias("templates"), F.count("*").alias("windows"))
    # an item's value should stand for one value of the occurrence: its most frequent partner counts as agreed
    pairs = met.select(*per, F.explode(F.arrays_zip(F.col("item_slots").alias("want"), F.col("slots").alias("got"))).alias("s")).groupBy(*per, "s.want", "s.got").agg(F.count("*").alias("n"))
    values = pairs.groupBy(*per, "want").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.sum(F.when(F.col("want") != F.col("got"), F.col("n")).otherwise(0)).alias("changed"))
    slots = values.groupBy(*per).agg(F.sum("all").alias("slots"), (F.sum("top") / F.sum("all")).alias("slot_agreement"), F.sum("changed").alias("changed"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}")) for c in per]
    out = cover.alias("c").join(slots.alias("s"), reduce(and_, same), "left").select(*[f"c.{c}" for c in per], "templates", "windows", F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("slot_agreement", F.lit(1.0)).alias("slot_agreement"), F.coalesce("changed", F.lit(0)).alias("changed"))
    out = out.alias("o").join(lengths.alias("l"), F.col("o.item_id").eqNullSafe(F.col("l.item_id")))
    mostly = (F.col("item_templates") > 0) & (F.col("templates") * F.col("item_windows") >= F.col("windows") * F.col("item_templates"))
    out = out.select("o.doc_id", "o.item_id", F.when(mostly, F.col("templates")).otherwise(F.col("windows")).alias("windows"), F.when(mostly, F.col("item_templates")).otherwise(F.col("item_windows")).alias("item_windows"), "slots", "slot_agreement", "changed", "level").withColumn("coverage", F.col("windows") / F.col("item_windows"))
    said = ["windows", "item_windows", "coverage", "slots", "slot_agreement", "changed"]
    enough = (F.col("coverage") >= min_coverage) & (F.col("slot_agreement") >= min_agreement)
    rank = F.struct(enough.alias("enough"), (F.col("changed") == 0).alias("verbatim"), F.col("coverage"), F.col("slot_agreement"), -F.col("level"), F.col("slots"))
    return out.groupBy(*by).agg(F.max_by(F.struct(*said), rank).alias("best")).select(*by, "best.*")


def short_widths(items: DataFrame, width: int) -> tuple[int, ...]:
    """Token counts of items shorter than a window: fewer than ``width`` different integers."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon()
        for batch in batches:
            yield pd.DataFrame({"n": [len(canon.tokens(t)[0]) if t else 0 for t in batch["text"]]})

    return tuple(r["n"] for r in items.select("text").mapInPandas(counts, "n int").where(f"n > 0 and n < {int(width)}").distinct().collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_literals: int = 4, min_coverage: float = 0.5, min_agreement: float = 0.8) -> DataFrame:
    """The pairs of ``contamination`` that cover at least ``min_coverage`` of the item with agreeing slots; ``kind`` is
    ``verbatim`` when all slots hold the item's own values, else ``reparameterised``."""
    found = contamination(docs, benchmark, width, min_literals, min_coverage, min_agreement).where((F.col("coverage") >= min_coverage) & (F.col("slot_agreement") >= min_agreement))
    return found.withColumn("kind", F.when(F.col("changed") == 0, "verbatim").otherwise("reparameterised")).drop("changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """Documents without any contaminated pair, all columns kept; rows without a doc_id are kept unless some such row is found."""
    bad = contaminated(docs, benchmark, **params).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("bad_id")), "left_anti")
