"""Personal data: base spans against plain patterns, gradients against differences, decoding against search, held-out spellings."""

import itertools
import random
import re

import numpy as np
import pytest

from flowspark.llm import pii

RNG = random.Random(4)


def plain_base(text):
    """The base rules with whole patterns, as written in the definition."""
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            checked = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            if [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(digits) <= 19 and checked % 10 == 0, 9 <= len(digits) <= 15][k]:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


ODD = ["a@b.c_d@e.f", "a@b.c@d.e", "@x.y", "a@@b.cc", "über.36@mail5.example.com", "1.2.3.4.5.6.7.8.9", "001.2.3.4", "1.2.3.256", "1.2.3.0000000000255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (443) 555-5793.", "+1" + " " * 50, "+12345678 9+", "", None, "5500005555555559" * 3]


def test_base_spans_follow_the_patterns():
    texts = ODD + ["".join(RNG.choice("aZ09.@+-_ ()%ü12") for _ in range(RNG.randrange(1, 120))) for _ in range(3000)]
    texts += [" ".join(RNG.choice(["4111 1111 1111 1111", "x@y.zz", "10.0.0.1", "+49 30 123456789", ".", "@", "12"]) for _ in range(6)) for _ in range(300)]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t
    long = "a" * 300_000 + "@" + "1" * 300_000 + "." * 300_000
    assert pii.base_spans(long) == []


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = pii.Network(*[w.astype(np.float64) for w in pii.Network.fresh(3, rng).weights()])
    net.trans += rng.normal(0, 0.5, net.trans.shape)
    x, y = rng.integers(0, pii._SYMBOLS, (2, 6)), rng.integers(0, 5, (2, 6))
    _, grads = pii.gradients(net, x, y)
    for w, g in zip(net.weights(), grads):
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(6)] + [tuple(np.unravel_index(np.abs(g).argmax(), g.shape))]:
            was, eps = w[at], 1e-3
            w[at] = was + eps
            up = pii.gradients(net, x, y)[0]
            w[at] = was - eps
            down = pii.gradients(net, x, y)[0]
            w[at] = was
            assert (up - down) / (2 * eps) == pytest.approx(g[at], abs=2e-4)


def test_decoding_equals_search_over_all_tag_sequences():
    rng = np.random.default_rng(2)
    net = pii.Network.fresh(4, rng)
    net.trans[:], net.begin[:] = rng.normal(0, 1, net.trans.shape), rng.normal(0, 1, 5)
    for shift in (0.0, 3.0, 8.0):
        net.bias[0] = shift
        windows = rng.integers(0, pii._SYMBOLS, (9, 5)).astype(np.uint8)
        score = net.emissions(windows)
        got = net.decode(score)
        for b in range(9):
            worth = lambda s, b=b: net.begin[s[0]] + sum(score[t, k, b] for t, k in enumerate(s)) + sum(net.trans[i, j] for i, j in zip(s, s[1:]))
            best = max(itertools.product(range(5), repeat=5), key=worth)
            assert worth(tuple(got[:, b])) == pytest.approx(worth(best), abs=1e-4)


def test_reconciling_windows():
    whole = [(10, 30, 0, 9.0, False, False)]
    assert pii.reconcile(whole + [(15, 30, 0, 4.0, True, False)]) == [(10, 30, 0)]
    assert pii.reconcile([(10, 20, 0, 5.0, False, True), (16, 30, 0, 5.0, True, False)]) == [(10, 30, 0)]
    assert pii.reconcile([(0, 10, 1, 5.0, False, False), (8, 14, 2, 3.0, False, False), (12, 20, 3, 4.0, False, False)]) == [(0, 10, 1), (12, 20, 3)]
    assert pii.reconcile([]) == []


WORDS = sorted({"".join(random.Random(i).choices(["an", "ver", "tion", "é", "la", "st", "o", "re", "ing", "qu", "ß", "ment", "e"], k=1 + i % 4)) for i in range(400)})


def filler(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(5)
    sample = []
    for i in range(600):
        kind = i % 4
        value = [f"{RNG.choice(WORDS)}.{i}@mail.example.com", f"10.{i % 256}.7.9", pii._card(rng), f"+1 ({100 + i}) 555-{1000 + i}"][kind]
        sample.append((filler(15) + " ", value, " " + filler(15), kind))
    return pii.train(pii.labelled(sample))


def test_held_out_spellings_are_found_and_plain_text_left_alone(net):
    rng = np.random.default_rng(99)
    texts, want = [], []
    for i in range(400):
        kind = i % 4
        value = pii.respelled(kind, "x@y", rng, WORDS)
        before = filler(int(rng.integers(0, 120)))
        texts.append(f"{before} {value} {filler(10)}")
        want.append((len(before) + 1, len(before) + 1 + len(value), kind))
    got = pii.Finder(net).find(texts)
    hit = sum(any(s[0] <= w[0] + 1 and s[1] >= w[1] - 1 and s[2] == w[2] for s in found) for (_, found), w in zip(got, want))
    assert hit >= 0.9 * len(texts), [(pii.KINDS[w[2]], t[w[0] - 2 : w[1] + 2], f) for (_, f), w, t in zip(got, want, texts) if w not in f][:12]
    clean = [filler(200) + " " + pii.harmless(rng, WORDS) + " " + filler(50) for _ in range(400)]
    assert sum(len(a) > len(b) for b, a in pii.Finder(net).find(clean)) <= 8


def test_table(spark, net):
    texts = [*ODD, "mail bob at example dot org today " * 3, "y" * 5000 + " 10.0.0.1", "漢字 a@b.cc", "漢字 a@b.cc"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, _spans string").repartition(3)
    rows = sorted(pii.find(docs, net).collect())
    assert [r.doc_id for r in rows] == list(range(len(texts))) and rows[0]._spans == "s"
    for r in rows:
        base = [(s.start, s.end, pii.KINDS.index(s.kind)) for s in r.base_spans]
        assert base == plain_base(r.text) and set(map(tuple, r.base_spans)) <= set(map(tuple, r.all_spans))
    alone = pii.Finder(net, block=2).find(texts)
    assert [[(pii.KINDS[k], a, b) for a, b, k in found] for _, found in alone] == [[tuple(s) for s in r.all_spans] for r in rows]
    assert tuple(rows[-1].all_spans) == tuple(rows[-2].all_spans)
    assert pii.find(docs.limit(0), net).count() == 0


def test_fit_from_a_table(spark):
    docs = spark.createDataFrame([(i, f"{filler(20)} {v} {filler(20)}") for i, v in enumerate(["a.b@c.example.com", "10.1.2.3", "+1 (443) 555-5793", "4111 1111 1111 1111", "none"] * 8)], "doc_id long, text string")
    sample = pii.sample_spans(docs, "text", 1000, 20)
    assert len(sample) == 20 and all(pii.base_spans(v)[0][2] == k for _, v, _, k in sample)
    assert pii.fit(docs.where("text like '%none%'")) is None and pii.fit(docs.limit(0)) is None
    found = pii.find(docs, None).collect()
    assert all(r.base_spans == r.all_spans for r in found)


def test_spans_that_keep_a_rule_lie_in_places():
    rng = np.random.default_rng(8)
    near = ["at", "At", "dot", "DOT", "@", ".", "-", " ", "  ", "(", ")", "[", "]", "+", "/", "1", "22", "255", "4111", "x", "ab", "com", "é", "%", "_", "\n", "\u3000", "ß", ","]
    kept = 0
    for i in range(4000):
        text = "".join(RNG.choice(near) for _ in range(RNG.randrange(2, 16)))
        if i % 2:
            text = RNG.choice(near) + pii.respelled(i // 2 % 4, "x@y", rng, ["bob", "mail", "at", "dot-x"]) + text
        inside = pii.places(text)
        for a in range(len(text)):
            for b in range(a + 1, len(text) + 1):
                if any(pii.reads_as(k, text[a:b]) for k in range(4)):
                    kept += 1
                    assert any(x <= a and b <= y for x, y in inside), text[a:b]
    assert kept > 1000
    for text in ("at-" * 100_000, "@ " * 100_000, "@" + " " * 300_000, "1 " * 100_000 + "(" * 100_000, ("1" + " " * 50_000 + "x") * 5):
        pii.places(text)


def all_windows(self, text, size):
    return set(range(self.windows(size)))


def test_windows_without_a_place_change_nothing(net, monkeypatch):
    rng = np.random.default_rng(6)
    texts = []
    for i in range(300):
        pieces = [filler(int(rng.integers(0, 100))) for _ in range(6)]
        for j in range(1, 6):
            pieces[j] = (pii.respelled((i + j) % 4, "x@y", rng, WORDS) if rng.integers(3) == 0 else pii.harmless(rng, WORDS)) + RNG.choice([" ", ", ", ""]) + pieces[j]
        texts.append(" ".join(pieces))
    for i in range(380, 520, 3):  # spans across the borders of windows
        texts.append("y" * i + " " + pii.respelled(i % 4, "x@y", rng, WORDS) + " " + filler(150))
    asked = pii.Finder(net).added(texts)
    monkeypatch.setattr(pii.Finder, "asked", all_windows)
    assert asked == pii.Finder(net).added(texts)
    assert sum(map(len, asked)) > 300
    loose = pii.Network(net.inputs, net.recur, net.out, net.bias + np.float32([-2, 0, 0, 0, 0]), net.trans, net.begin)  # finds far too much
    every = pii.Finder(loose).added(texts)
    monkeypatch.undo()
    assert pii.Finder(loose).added(texts) == every


def test_plain_text_needs_no_window(net, monkeypatch):
    read = []
    through = pii.Finder.candidates
    monkeypatch.setattr(pii.Finder, "candidates", lambda self, waiting, length, into: (read.extend(w[:2] for w in waiting), through(self, waiting, length, into)))
    long = filler(1500) + ", bob at example dot org, " + filler(1500)
    pii.Finder(net).find([filler(2000) + " 12.03.2024 " + filler(500), long])
    assert {i for i, _ in read} == {1} and 1 <= len(read) <= 4 < len(long) // pii.STRIDE, (read, pii.places(long))
