"""Cross-tokenizer alignment against the definition, with texts of one and of many fragments; laws of the monoid."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowspark.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(12)
TEXTS = ["".join(RNG.choice("abcde thing \n\n  0123 éèñ漢字😀.,ß\t'") for _ in range(RNG.randrange(1, 200))) for _ in range(25)]
TEXTS += [None, "", " ", "\n", "x▁y", "<|endoftext|> </s><s> <0x41>", "one two  three", "one two  three", "ends with space ", "日本語のテキスト", "don't we'll", "\x00a", "   x"]
GIANTS = ["word and more words, " * 60, "x" * 700, "漢字" * 200, " " * 500 + "a", "ab▁c " * 100, "".join(RNG.choice("abcde fg\nhij ") for _ in range(900)), "no1 2spaces3" * 80, "\n" * 300]


def shown(b):
    byte = {}
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    more = 0
    for i in range(256):
        if i in keep:
            byte[chr(i)] = i
        else:
            byte[chr(256 + more)] = i
            more += 1
    return bytes(byte[c] for c in b)


@pytest.fixture(scope="module")
def plain():
    """groups(text): [(ids of A, ids of B)] straight from the libraries, or None."""
    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=B)

    def groups(text):
        if not text:
            return None
        a = ta.encode(" " + text, add_special_tokens=False).ids
        b = tb.encode(text)
        ba = [shown(ta.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [tb.id_to_piece(i)]]
        if b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            return None
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
        ea, eb = ends(ba), ends(bb)
        out, low = [], 0
        for c in sorted(set(ea) & set(eb)):
            out.append(([i for i, e in zip(a, ea) if low < e <= c], [i for i, e in zip(b, eb) if low < e <= c]))
            low = c
        return out

    return groups


def brute(texts, groups):
    per = [groups(t) for t in texts]
    count = {}
    for g in per:
        for p in {(x, y) for a, b in g or () for x in a for y in b}:
            count[p] = count.get(p, 0) + 1
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for i, g in enumerate(per):
        links = [(x, y) for a, b in g or () for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        out.append((i, sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


@pytest.fixture(scope="module")
def files():
    return al.load(A, B)


@pytest.mark.parametrize("chunk, fan, top", [(64, 3, 20), (32768, 16, 1 << 18)])
def test_equals_the_definition(spark, files, plain, chunk, fan, top):
    texts = TEXTS + GIANTS
    docs = spark.createDataFrame([(i, t, 0, "r") for i, t in enumerate(texts)], "doc_id long, text string, n long, row string").repartition(4)
    out = al.align(docs, files, chunk_chars=chunk, fan=fan, top_pairs=top)
    got = sorted(tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == brute(texts, plain)


def test_monoid_is_associative(files, plain):
    pair = files.pair()
    for text in ["漢字" * 30, "x" * 300, TEXTS[3] + TEXTS[4], "some words here " * 9]:
        a, b = pair.encode(text)
        ea, eb = [sum(pair.len_a[a[: i + 1]]) for i in range(len(a))], [sum(pair.len_b[b[: i + 1]]) for i in range(len(b))]
        step, leaves = 13, []
        for lo in range(0, ea[-1], step):
            xa, xb = ([i for i, e in zip(s, ends) if lo < e <= lo + step] for s, ends in ((a, ea), (b, eb)))
            before = max([e for e in ea if e <= lo], default=0) - max([e for e in eb if e <= lo], default=0)
            leaves.append(al.leaf(pair, xa, xb, before, lo)[0])
        for i in range(1, len(leaves) - 1):
            x, y, z = leaves[i - 1 : i + 2]
            left, g1 = al.compose(x, y)
            left, g2 = al.compose(left, z)
            right, h1 = al.compose(y, z)
            right, h2 = al.compose(x, right)
            assert left == right and [g for g in (g1, g2) if g] == [h for h in (h2, h1) if h]


def test_large_groups_count_distinct_ids(files, monkeypatch):
    pair = files.pair()
    coded = [pair.encode(t) for t in GIANTS[:3] if pair.encode(t)]
    want = al.group_stretches(pair, coded)
    monkeypatch.setattr(al, "_LARGE", 1)
    got = al.group_stretches(pair, coded)
    assert [x.tolist() for x in got.pairs] == [x.tolist() for x in want.pairs] and [x.tolist() for x in got.times] == [x.tolist() for x in want.times]


def test_both_libraries_agree_for_every_character(files):
    coder = files.pair().a
    for block in range(0, 0x11000, 0x400):
        chars = [chr(c) for c in range(block, block + 0x400) if not 0xD800 <= c < 0xE000]
        texts = [f"a{c}b {c} 1{c}2{c}{c} {c}x  {c}. '{c}s{c}  {c}{c}" for c in chars]
        for t, e in zip(texts, coder.slow.encode_batch(texts, add_special_tokens=False)):
            assert coder.fast.encode_ordinary(t) == e.ids


def test_empty_table(spark, files):
    assert al.align(spark.createDataFrame([], "doc_id long, text string"), files).count() == 0


def test_copies_and_missing_ids(spark, files):
    docs = spark.createDataFrame([(None, "same words"), (None, "same words"), (3, "same")], "doc_id long, text string")
    got = al.align(docs, files).where(F.col("doc_id").isNull()).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].n_best == got[0].n_links and got[0].count_sum > got[0].n_links
