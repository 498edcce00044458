"""Spelling variants against all pairs: the scan of one sorted range, the whole query, odd rows."""

import random
import re
from zlib import crc32

import pytest

from flowspark.llm import spelling as sp

RNG = random.Random(11)


def near(a, b):
    """One edit, straight from the definition."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(n, letters="abé", low=6, high=9, seed=1):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(low, high))) for _ in range(n)})


@pytest.mark.parametrize("known", [0, 1, 3])
def test_sorted_range_equals_all_pairs(known):
    words = sorted({"abc"[:known] + w for w in words_of(150, low=1, high=7, seed=known)})
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and near(a, b)}
    assert want and set(sp.within_one(words, known, lambda q: True)) == want


def brute(rows, every=199, min_length=6, min_count=5, ratio=5):
    count = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= min_length:
                count[w] = count.get(w, 0) + 1
    count = {w: n for w, n in count.items() if n >= min_count}
    rows, form = {}, {}
    for w, n in count.items():
        others = [x for x in count if near(w, x)]
        best = min(others, key=lambda x: (-count[x], x), default=None)
        if best is not None and count[best] >= ratio * n:
            form[w] = best
        rows[w] = (n, len(others))
    out = set()
    for w, (n, k) in rows.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, k, count[form[w]] if w in form else None))
    return out


def sample_rows():
    vocabulary = words_of(60, "abcdeÉé", 5, 9, 3)
    vocabulary += [w[:2] + w[3:] for w in vocabulary[:20]] + [w[:4] + "x" + w[4:] for w in vocabulary[10:30]] + [w + "s" for w in vocabulary[:10]]
    weights = [RNG.choice([1, 1, 6, 40]) for _ in vocabulary]
    rows = [(i, " ".join(RNG.choices(vocabulary, weights, k=RNG.randint(0, 60)))) for i in range(150)]
    rows += [(None, "Word Ending WORD word ending word ending Ending"), (7, None), (8, ""), (9, "a-b 12 ×÷×÷×÷ ×÷×÷×÷"), (10, "ÀÉÎÕÜß " * 9), (14, "walking " * 6), (15, "walkingy " * 40), (16, "walkingyy " * 250)]
    return rows + rows[:3]


@pytest.mark.parametrize("range_words", [4000, 5])
def test_query_equals_brute_force(spark, range_words):
    rows = sample_rows()
    docs = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string").repartition(5)
    counted = sp.word_counts(docs, change=sp.drop_letter(7))
    got = {tuple(r) for r in sp.group_variants(counted, range_words=range_words).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = brute(rows, every=7)
    assert got == want
    assert any(r[1] and r[1] != r[2] for r in want)


def test_short_words_and_chains(spark):
    words = [("a", 9), ("b", 60), ("ab", 400), ("abc", 3000), ("c", 1), ("", 5)]
    got = {r.word: (r.form, r.root, r.n_near) for r in sp.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"a": ("ab", "abc", 3), "b": ("ab", "abc", 3), "c": ("b", "abc", 2), "ab": ("abc", "abc", 3), "abc": (None, "abc", 1), "": (None, "", 0)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sp.group_variants(sp.word_counts(docs)).count() == 0
