"""Near-duplicate classes against brute force over all pairs, odd inputs."""

import random

import numpy as np
import pandas as pd
import pytest

from flowspark.llm import jaccard
from flowspark.llm.hashing import Powers

DOC = "doc_id long, text string, component_id string"


def brute(rows, n, percent):
    def grams(t):
        w = (t or "").encode().lower().split()
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + min(n, len(w))]) for i in range(max(1, len(w) - n + 1)))

    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(root(i), []).append(d)
    return sorted(((d, len(s), min((x for x in low[root(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed, families, members):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    shared = [word() for _ in range(30)]
    rows, at = [], 0
    for _ in range(families):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120]))] + (shared if rng.random() < 0.4 else [])
        for _ in range(rng.randrange(1, members)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = word()
            rows.append((at, rng.choice([" ", "\n", " \t"]).join(t).replace("a", rng.choice("aA"))))
            at += 1
    return rows


@pytest.mark.parametrize("seed, n, percent", [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_classes_against_all_pairs(spark, monkeypatch, seed, n, percent):
    monkeypatch.setattr(jaccard, "CHUNK", 5)
    monkeypatch.setattr(jaccard, "QUERY_BLOCK", 3)
    rows = corpus(seed, 30, 9) + [(None, "lonely row without an id"), (5000, None), (5001, ""), (5002, " \n\t"), (5003, "A b c"), (5004, "a B C"), (5, "twin id"), (5, "twin id"), (6000, "w " * 30000), (6001, "w " * 29000)]
    got = jaccard.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], DOC).repartition(5), n, percent).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, n, percent)


def test_large_family_and_first_of_each(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in ((i, rng.randrange(200)) for i in range(400))] + [(900 + i, " ".join(base)) for i in range(200)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], DOC)
    assert {r.component_id for r in jaccard.near_duplicates(df, 4, 85).collect()} == {0}
    assert [r.doc_id for r in jaccard.keep_first(df).collect()] == [0]


def test_family_around_the_threshold(spark, monkeypatch):
    """Sets that share a min-hash without being linked stand in one group, and their links are still found."""
    monkeypatch.setattr(jaccard, "CHUNK", 20)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.choice([3, 5, 6, 9])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    expected = brute(rows, 4, 85)
    assert 1 < len({c for _, _, c in expected}) < 120
    got = jaccard.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], DOC).repartition(4), 4, 85).collect()
    assert sorted(map(tuple, got), key=repr) == expected


def test_pairs_grow_with_a_family_not_with_its_square(spark, monkeypatch):
    """Copies of one text with some other words, linked by chains: the pairs listed, and classes by brute force."""
    listed = []
    blocks = jaccard._blocks
    monkeypatch.setattr(jaccard, "_blocks", lambda pairs, groups: (listed.append(pairs.count()), blocks(pairs, groups))[1])
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    sizes = []
    for members in (150, 300):
        rng = random.Random(4)
        base = [f"w{i}" for i in range(90)]
        rows = []
        for i in range(members):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2])):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(t)))
        listed.clear()
        got = jaccard.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], DOC).repartition(4), 5, 80).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, 5, 80)
        sizes.append(sum(listed))
    print("pairs listed", sizes)
    assert sizes[1] < 3 * max(sizes[0], 150)


def test_signatures_rule_out_no_link():
    """Isolated pairs of 300 to 5000 tokens around the threshold, by the signature test alone."""
    rng = np.random.default_rng(5)
    rows, linked = [], set()
    for g in range(120):
        n = int(rng.choice([300, 1000, 2000, 5000]))
        share = rng.uniform(0.85, 0.92)
        both = int(2 * n * share / (1 + share)) + 1
        all_tokens = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * n - both, dtype=np.uint64)
        a, b = np.sort(all_tokens[:n]), np.sort(all_tokens[n - both :])
        rows += [(g, 0, 2 * g, 2 * g, len(a), jaccard.signature(a), True), (g, 0, 2 * g + 1, 2 * g + 1, len(b), jaccard.signature(b), False)]
        if jaccard.similar(a, b, 85):
            linked.add(2 * g)
    assert len(linked) > 20
    got = jaccard._face_groups(85)(pd.DataFrame(rows, columns=["gid", "block", "k", "leader", "n", "sig", "is_query"]))
    assert linked <= set(got["k"])


def test_shingles_are_told_apart():
    """Characters of neighbouring words don't change places unseen."""
    powers = Powers()
    assert jaccard.shingles("the of an he", 4, powers) != jaccard.shingles("the of en ha", 4, powers)
    assert jaccard.shingles("x y to be", 4, powers) != jaccard.shingles("x y eo bt", 4, powers)
    rng = random.Random(13)
    for n in (2, 4, 5):
        words = [f"{rng.randrange(100):02d}" for _ in range(40_000)]
        assert len(jaccard.shingles(" ".join(words), n, powers)) == len({tuple(words[i : i + n]) for i in range(len(words) - n + 1)})


def test_similar_at_the_threshold():
    a = np.arange(100, dtype=np.uint64)
    assert jaccard.similar(a, a[:85], 85) and not jaccard.similar(a, a[:84], 85)


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
