"""Closed syncmers against the definition, successors across ranges, odd inputs."""

import hashlib
import random

from flowspark.llm import syncmers as y
from flowspark.llm.hashing import rolling

DOC = "doc_id long, text string, fingerprint string"


def test_syncmers_against_the_definition():
    rng = random.Random(2)
    for n in (0, 5, 15, 16, 17, 200):
        codes = y.codes_of("".join(rng.choice("abé漢 ") for _ in range(n)))
        h, at = y.syncmers(codes)
        small = rolling(codes, y.S).tolist()
        w = y.K - y.S + 1
        want = [p for p in range(n - y.K + 1) if min(small[p : p + w]) in (small[p], small[p + w - 1])]
        assert at.tolist() == want and len(h) == len(want)


def test_likeness():
    rng = random.Random(4)
    a, b = (" ".join(rng.choice(["red", "green", "blue", "sky", "sea"]) + str(rng.randrange(999)) for _ in range(600)) for _ in range(2))
    fa = y.read(y.fingerprint(a))
    assert y.likeness(fa, y.read(y.fingerprint(a))) == 1.0 and y.likeness(fa, y.read(y.fingerprint(b))) < 0.1
    assert y.likeness(fa, y.read(y.fingerprint("intro " + a))) > 0.85
    assert y.likeness({}, {}) == 1.0 and y.likeness(fa, {}) == 0.0
    assert y.fingerprint("") == "" and y.fingerprint("abc") != y.fingerprint("abd")


def test_anchors_follow_from_themselves():
    """Every anchor of a long text's fingerprint is kept or not whatever else the text holds, and their number grows with it."""
    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    alone, inside = y.read(y.fingerprint(part)), y.read(y.fingerprint(other + part + other))
    assert len(alone) > 40 and len(inside) > 4000
    assert all(h in inside for h in alone)


def test_successors_and_edits_against_a_plain_loop(spark):
    rng = random.Random(9)
    rows = [(i * 3, "".join(rng.choice("abc dé漢") for _ in range(rng.choice([0, 1, 3, 40, 300])))) for i in range(150)]
    rows += [(None, "no id"), (None, None), (9, "twin"), (9, "twin"), (9, "other"), (10**15, "far " * 30000)]
    out = y.compare_with_next(spark.createDataFrame([(i, t, "x") for i, t in rows], DOC), ranges=7).collect()
    order = sorted(((i if i is not None else y.LOWEST, t or "") for i, t in rows))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        a, b, c = y.fingerprint(t), y.fingerprint(e), y.fingerprint(nxt)
        want.append((i if i != y.LOWEST else None, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, y.likeness(y.read(a), y.read(b)), y.likeness(y.read(a), y.read(c))))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_single_and_empty(spark):
    one = y.compare_with_next(spark.createDataFrame([(5, "abcdefgh", None)], DOC)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0
    assert y.compare_with_next(spark.createDataFrame([], DOC)).count() == 0
