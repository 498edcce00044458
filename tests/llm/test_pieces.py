"""Max-plus SentencePiece: equal to the library for BPE and unigram, chunked or not; exact round trip; odd inputs."""

import math
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from flowspark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(5)
ODD = ["".join(RNG.choice("abcde thing \n\n  0123 éèñ漢字😀.,ß\t") for _ in range(RNG.randrange(1, 200))) for _ in range(80)]
ODD += ["".join(RNG.choice("abetshionr") for _ in range(300)) for _ in range(20)] + [" " * 70 + "x", " ", "\n", " \n ", "</s><unk>", "▁x"]


@pytest.fixture(scope="module")
def bpe():
    return pieces.load(PATH)


@pytest.fixture(scope="module")
def unigram_data():
    """The same vocabulary read as a unigram model, with weights that fall with the rank."""
    p = pb.ModelProto.FromString(open(PATH, "rb").read())
    p.trainer_spec.model_type = 1
    for x in p.pieces:
        if x.type == 1:
            x.score = -math.log(2 - x.score) if x.score > -1e8 else -12.0
    return p.SerializeToString()


def chunked(model, text, size):
    s = pieces.SPACE + text.replace(" ", pieces.SPACE)
    cut = [(s[max(0, i - model.longest) : i + size + model.longest], min(i, model.longest), min(i, model.longest) + min(size, len(s) - i)) for i in range(0, len(s), size)]
    mats = [model.transfer(*c) for c in cut]
    whole = mats[0]
    for m in mats[1:]:
        whole = pieces.product(whole, m)
    best = max((r for r in whole if r[:2] == (0, "")), key=lambda r: r[4])
    states = pieces.best_states(mats, (0, ""), (best[2], best[3]))
    return [i for c, a, b in zip(cut, states, states[1:]) for i in model.chunk_ids(*c, a, b)], best[4]


def test_bpe_equals_the_library(bpe):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in ODD:
        want = sp.encode(t)
        assert list(bpe.encode(t)) == want
        assert chunked(bpe, t, RNG.choice([1, 2, 5, 17, 64]))[0] == want
        assert bpe.decode(want) == t.replace("▁", " ")


def test_unigram_reaches_the_library_s_weight(unigram_data):
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=unigram_data), pieces.Pieces(unigram_data)
    weigh = lambda ids: sum(own.scores.get(own.texts[i], 0.0) for i in ids)
    for t in ODD:
        want = sp.encode(t)
        assert own.decode(own.encode(t)) == t.replace("▁", " ")
        if t.isascii():  # bytes of other characters carry the weight of the unknown character
            assert weigh(own.encode(t)) == pytest.approx(weigh(want), abs=1e-3)
        ids, _ = chunked(own, t, RNG.choice([1, 2, 5, 17, 64]))
        assert weigh(ids) == pytest.approx(weigh(own.encode(t)), abs=1e-6)


def test_spark_scan_over_giants(spark, bpe):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [*ODD, None, "", "word " * 4000, "x" * 9000, "\n" * 700, "word " * 4000]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    out = pieces.decode(pieces.encode(df, bpe, chunk_chars=50, fan=3), bpe).withColumn("same", F.col("decoded") == F.coalesce("text", F.lit(""))).collect()
    assert len(out) == len(texts) and set(out[0].asDict()) == {"doc_id", "text", "key", "ids", "decoded", "same"}
    for r in out:
        assert r.ids == (sp.encode(r.text) if r.text else [])
        assert r.same or "▁" in r.text


def test_empty_table(spark, bpe):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), bpe).count() == 0


def test_words_of_a_block_are_merged_together_and_not_kept(bpe, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    words = ["".join(RNG.choice("abetshionrlé") for _ in range(RNG.randrange(1, 20))) for _ in range(4000)]
    texts = [" ".join(words[i : i + 50]) + RNG.choice(["", " 12", "  x"]) for i in range(0, 4000, 50)]
    want = [sp.encode(t) for t in texts]
    monkeypatch.setattr(pieces.Pieces, "merged", lambda self, text: pytest.fail(f"{text} merged alone"))
    monkeypatch.setattr(pieces.Pieces, "BLOCK", 3000)
    kept = {k: len(v) for k, v in vars(bpe).items() if isinstance(v, (dict, set, list))}
    blocks = list(bpe.encode_all(pa.array(texts)))
    assert len(blocks) > 5 and [ids for block in blocks for ids in block.to_pylist()] == want
    assert {k: len(v) for k, v in vars(bpe).items() if k in kept} == kept


def test_runs_of_spaces_share_a_score_and_are_merged_by_definition(bpe):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [" " * n + w for n in range(40) for w in ("", "x", "the  end", "\n  y")] + [None, "", "▁▁ a▁b"]
    blocks = list(bpe.encode_all(pa.array(texts).slice(3)))
    assert [ids for block in blocks for ids in block.to_pylist()] == [sp.encode(t) if t else [] for t in texts[3:]]


def test_chunks_end_where_no_piece_spans(bpe):
    s = pieces.SPACE + ("some words 12 of a text " * 40).replace(" ", pieces.SPACE) + "y" * 200
    at = bpe.borders(s, 50)
    assert at[0] == 0 and at[-1] == len(s) and all(0 < b - a <= 50 for a, b in zip(at, at[1:]))
    inner = [p for p in at[1:-1] if p < len(s) - 250]
    assert len(inner) > 10 and all(bpe.hard(s, p) for p in inner)
    assert all(len(bpe.transfer(s, a, b)) == 1 for a, b in zip(at, at[1:]) if b < len(s) - 250)
