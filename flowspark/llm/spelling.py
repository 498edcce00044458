"""Spelling variants of words: near words by dynamic programming down sorted lists, and the form each word is folded into.

Two words are near if one inserted, deleted or replaced character turns one into the other. One edit leaves the first or the
second half of the shorter word untouched, so the sorted vocabulary is dealt out twice by a shared half: by first letters
(sorted forwards) and by last letters (sorted from the end). Each range of such a list is scanned with the edit matrix of the
query word, kept as a band of three cells a row: a list word reuses the rows of the prefix it shares with the word before, and
where a row exceeds one edit everywhere, the whole range of words with that prefix is skipped. A pair is found in one list only:
forwards if the untouched half is the first one, else backwards.

A range of more than ``range_words`` words goes to several tasks, which share its words out as queries and scan the same list;
how many there are follows from its size. Words of a range share half their letters and nearly their length.

Defined cases: null and empty texts hold no words; a null id is written as an empty string before the colon; repeated rows count
each time; equal counts go to the smallest word in code-point order; an empty table, or one without frequent words, gives no
rows; other columns are ignored, whatever their names. Very long texts are scanned in one pass without a list of their words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import cut, written

_LOWER = {c: c + 32 for c in range(65, 91)}
_FLUSH = 200_000

Change = Callable[[str, str], str]


def lower_az(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(_LOWER)


def drop_letter(every: int) -> Change:
    """A change that takes one letter out of every so many (document, word) pairs, chosen by their crc32."""

    def change(doc_id: str, word: str) -> str:
        h = crc32(f"{doc_id}:{word}".encode())
        if h % every:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return change


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, change: Change | None = None) -> DataFrame:
    """(word, n): lower-cased letter runs of at least ``min_length`` characters with at least ``min_count`` occurrences.

    ``change`` may rewrite a word by the document it stands in. Tasks add up their words before the shuffle.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_length},}}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": pd.Series(list(total.keys()), dtype=object), "n": list(total.values())})
            total.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                if not text:
                    continue
                own: Counter[str] = Counter()
                for run, n in Counter(runs.findall(text) if len(text) < 1 << 20 else (m[0] for m in runs.finditer(text))).items():
                    own[lower_az(run)] += n
                for word, n in own.items():
                    word = change(doc_id, word) if change else word
                    if len(word) >= min_length:
                        total[word] += n
                if len(total) > _FLUSH:
                    yield flush()
        yield flush()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = rows.mapInPandas(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- one range of a sorted list ---------------------------------------------------------------------------------
def shared(a: str, b: str, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    stop = min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    return start


def within_one(words: list[str], known: int, query: Callable[[str], bool]) -> Iterator[tuple[int, int]]:
    """Pairs of places (i, j), i < j, of near words in a sorted list of distinct words that share ``known`` letters.

    ``query`` says for which words i the list is scanned. Row d of the matrix holds the edits between the first d letters of the list word
    and the first d - 1, d and d + 1 letters of the query; values above one count as two.
    """
    n = len(words)
    for i, q in enumerate(words):
        if not query(q):
            continue
        length = len(q)
        rows = [(2, 2, 2)] * known + [(1 if known else 2, 0, 1)]  # where all letters so far are equal
        j, last = i + 1, q
        depth = known
        while j < n:
            w = words[j]
            depth = min(depth, shared(last, w, known)) if last is not q else known
            del rows[depth + 1 :]
            low = 0
            while depth < len(w):
                before, c = rows[depth], w[depth]
                depth += 1
                # cell (d, k) from the cells (d-1, k-1), (d-1, k) and (d, k-1)
                a = min(before[0] + (not 0 <= depth - 2 < length or q[depth - 2] != c), before[1] + 1) if depth >= 1 else 2
                b = min(before[1] + (depth - 1 >= length or q[depth - 1] != c), before[2] + 1, a + 1)
                e = min(before[2] + (depth >= length or q[depth] != c), b + 1)
                row = (a if a < 2 else 2, b if b < 2 else 2, e if e < 2 else 2)
                rows.append(row)
                low = min(row)
                if low > 1:
                    break
            last = w
            if low > 1:  # no word that begins like this is near
                j = bisect_left(words, w[: depth - 1] + chr(ord(w[depth - 1]) + 1), j + 1)
                continue
            gap = length - len(w)
            if -1 <= gap <= 1 and rows[len(w)][gap + 1] == 1:
                yield i, j
            j += 1


def scan_ranges(range_words: int):
    """mapInPandas function over sorted rows (m, back, half, part, parts, place, word, n): near words of each range."""

    def near(key: tuple, block: list[tuple[str, int]]) -> Iterator[tuple]:
        m, back, half, part, parts = key
        if len(block) < 2:
            return
        words = [w[::-1] for w, _ in block] if back else [w for w, _ in block]
        found: dict[int, list] = {}
        for i, j in within_one(words, len(half), lambda q: parts == 1 or crc32(q.encode()) % parts == part):
            if min(len(words[i]), len(words[j])) != m or (back and shared(block[i][0], block[j][0]) >= m // 2):
                continue
            for x, y in ((i, j), (j, i)):
                other = (-block[y][1], block[y][0])
                mine = found.get(x)
                found[x] = [1, other] if mine is None else [mine[0] + 1, min(mine[1], other)]
        for x, (k, (minus, best)) in found.items():
            yield block[x][0], k, minus, best

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, block = None, []
        out: list[tuple] = []
        frame = lambda: pd.DataFrame(out, columns=["word", "n_near", "minus", "best"]).astype({"word": object, "best": object})
        for b in batches:
            for r in zip(b["m"], b["back"], b["half"], b["part"], b["parts"], b["word"], b["n"]):
                if r[:5] != key:
                    out += near(key, block) if block else ()
                    key, block = r[:5], []
                block.append(r[5:])
            if out:
                yield frame()
                out = []
        out += near(key, block) if block else ()
        yield frame()

    return scan


def near_words(words: DataFrame, range_words: int = 4000) -> DataFrame:
    """(word, n_near, best, best_n) for each of the distinct ``words`` (word, n) that has a near word; best is the one of largest n."""
    length = F.length("word")
    sides = F.flatten(F.transform(F.array(length, length - 1), lambda m: F.transform(F.array(F.lit(False), F.lit(True)), lambda back: F.struct(m.alias("m"), back.alias("back")))))
    rows = words.where(F.length("word") > 0).select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.*").where("m > 0")
    half = F.floor(F.col("m") / 2).cast("int")
    first, rest = F.expr("substring(word, 1, cast(floor(m / 2) as int))"), F.reverse(F.expr("right(word, cast(m - floor(m / 2) as int))"))
    rows = rows.withColumn("half", F.when(F.col("back"), rest).when(half > 0, first).otherwise(F.lit("")))
    rows = rows.withColumn("place", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    key = ["m", "back", "half"]
    large = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > range_words).select(*key, F.ceil(F.col("size") / range_words).cast("int").alias("parts"))
    dealt = rows.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.repartition(*key, "part").sortWithinPartitions(*key, "part", "place")
    found = dealt.select(*key, "part", "parts", "word", "n").mapInPandas(scan_ranges(range_words), "word string, n_near long, minus long, best string")
    best = F.min(F.struct("minus", "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.minus")).alias("best_n"))


def group_variants(words: DataFrame, ratio: int = 5, range_words: int = 4000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a counted vocabulary (word, n).

    A word's form is its most frequent near word if that is ``ratio`` times as frequent (at least twice); the root is the end of the chain of forms. Counts grow
    along a chain, so it ends; each round doubles the steps taken.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2: chains of forms must end")
    words = written(words.select("word", "n"), "words")
    near = near_words(words, range_words)
    known = words.join(near, "word", "left")
    keep = F.col("best_n") >= ratio * F.col("n")
    known = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(keep, F.col("best")).alias("form"), F.when(keep, F.col("best_n")).alias("form_n")))
    chain = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        up = chain.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = cut(chain.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        chain = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            break
    return known.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
