"""Alignment of two tokenizers by an associative monoid of fragments.

Both token sequences of a text cover the same bytes. Byte offsets where a token of each ends cut them into groups, the smallest
stretches that both agree on. A fragment is what a byte range knows alone: the tokens up to its first cut (open prefix: their group may
have begun before), the groups between its first and last cut (closed), and the tokens after the last cut (open suffix). Without a cut it is one
open stretch. Composing neighbours joins suffix and prefix to a group that thereby closes; this is associative, so the fragments of a very long
text are made by many tasks and composed in a tree. Only open ends climb the tree, closed groups stay where they closed. A text of at most
``chunk_chars`` characters is one fragment.

Long texts are encoded in pieces that begin at a space after a letter or digit: neither tokenizer joins the two there, so ids
are those of the whole text. A piece without such a space is encoded whole and cut into byte ranges afterwards.

Linked id pairs are counted over documents: tasks add up distinct pairs before the shuffle. To look the counts up, the most frequent pairs (at most
``top_pairs``) and the highest count of each id of the first vocabulary are broadcast; all other pairs meet their counts in a join.

Defined cases: null and empty texts, and texts whose token bytes differ from a space and the text (a U+2581 in it), have no tokens: zeros and
an empty digest; repeated rows are documents of their own; null ids are kept; an empty table gives an empty result; other columns are
ignored, whatever their names. A group of very many tokens is counted by distinct ids and their frequencies, never pair by pair.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from flowspark.llm.common import cut, written

_BREAK = re.compile(r"(?<=[^\W_]) (?=.)", re.DOTALL)
_BLANK = re.compile(r"\s{2000}")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LARGE = 4096


class ByteCoder:
    """A byte-level BPE tokenizer read from its JSON file; ids and the bytes of each.

    Texts are encoded by the faster of two libraries, built from the file's own vocabulary, where its merge order is the order of
    ids; very long blank runs, which that library can't split, go to the library of the file.
    """

    def __init__(self, data: bytes) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_buffer(data)
        self.slow.encode_special_tokens = True
        spec = json.loads(data)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        raw = {i: bytes(byte[c] for c in piece) for piece, i in model["vocab"].items()}
        self.bytes = [raw.get(i, b"") for i in range(max(raw) + 1)]
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        in_order = all(x < y for x, y in zip(merged, merged[1:])) and all(len(raw[i]) == 1 for i in raw if not merged or i < merged[0])
        self.fast = tiktoken.Encoding("pairs", pat_str=_PATTERN, mergeable_ranks={b: i for i, b in raw.items()}, special_tokens={}) if in_order else None

    def encode(self, text: str) -> list[int]:
        if self.fast is None or _BLANK.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceCoder:
    """A piece model that adds a space in front; ids and the bytes of each."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = self.lib.get_piece_size()
        texts = [self.lib.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(texts)]
        self.breaks = not any("▁" in p.lstrip("▁") for p in texts)

    def encode(self, text: str) -> list[int]:
        return self.lib.encode(text)


class Pair:
    """Both tokenizers with tables over their ids."""

    def __init__(self, a: bytes, b: bytes) -> None:
        self.a, self.b = ByteCoder(a), PieceCoder(b)
        self.size_b = len(self.b.bytes)
        if len(self.a.bytes) * self.size_b >= 1 << 31:
            raise ValueError("the vocabularies are too large for 32-bit pairs")
        self.len_a, self.len_b = (np.array([len(x) for x in c.bytes], dtype=np.int64) for c in (self.a, self.b))
        digits = [np.array([str(i) for i in range(max(len(self.a.bytes), self.size_b))], dtype=object)] * 2
        self.more, self.bar, self.end = digits[0] + ",", digits[0] + "|", digits[0] + ";"

    def encode(self, body: str) -> tuple[list[int], list[int]] | None:
        """Ids of a space and ``body`` by each, or None if the bytes of either differ from it."""
        text = " " + body
        raw = text.encode()
        a, b = self.a.encode(text), self.b.encode(body)
        same = b"".join(map(self.a.bytes.__getitem__, a)) == raw and b"".join(map(self.b.bytes.__getitem__, b)) == raw
        return (a, b) if same else None


_PAIRS: dict[str, Pair] = {}


@dataclass
class Files:
    """The two vocabulary files' bytes, broadcast to the tasks: their size is that of the vocabularies."""

    a: bytes
    b: bytes

    def pair(self) -> Pair:
        key = hashlib.sha256(self.a + self.b).hexdigest()
        if key not in _PAIRS:
            _PAIRS.clear()
            _PAIRS[key] = Pair(self.a, self.b)
        return _PAIRS[key]


def load(a_path: str, b_path: str) -> Files:
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return Files(a.read(), b.read())


# -- groups ---------------------------------------------------------------------------------------------------------
@dataclass
class Groups:
    """Groups of neighbouring stretches of tokens: per stretch the counts, the written groups and the linked pairs."""

    n_groups: np.ndarray
    n_links: np.ndarray
    texts: list[str]
    pairs: list[np.ndarray]
    times: list[np.ndarray]


def group_stretches(pair: Pair, stretches: list[tuple[list[int], list[int]]]) -> Groups:
    """Groups of stretches that begin and end with cuts of their own."""
    count = len(stretches)
    a = np.fromiter((i for s in stretches for i in s[0]), dtype=np.int64)
    b = np.fromiter((i for s in stretches for i in s[1]), dtype=np.int64)
    end_a, end_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])
    total = int(end_a[-1]) if len(a) else 0
    mark = np.zeros(total + 1, dtype=np.int8)
    mark[end_a] = 1
    mark[end_b] += 2
    last_a, last_b = mark[end_a] == 3, mark[end_b] == 3
    in_a, in_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    groups = int(last_a.sum())
    num_a, num_b = np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups)
    from_a, from_b = np.cumsum(num_a) - num_a, np.cumsum(num_b) - num_b
    # the written form: tokens of a group by the first tokenizer, then by the second, each followed by its mark
    out = np.empty(len(a) + len(b), dtype=object)
    out[np.arange(len(a)) + from_b[in_a]] = np.where(last_a, pair.bar[a], pair.more[a])
    out[np.arange(len(b)) + (from_a + num_a)[in_b]] = np.where(last_b, pair.end[b], pair.more[b])
    ends = np.cumsum([len(s[0]) + len(s[1]) for s in stretches]) if count else np.zeros(0, dtype=np.int64)
    written_out = out.tolist()
    texts = ["".join(written_out[lo:hi])[:-1] for lo, hi in zip([0, *ends.tolist()], ends.tolist())]
    # groups and links of each stretch
    stretch_end = np.cumsum([len(s[0]) for s in stretches]) if count else np.zeros(0, dtype=np.int64)
    of_group = np.searchsorted(stretch_end, from_a, side="right")
    links = num_a * num_b
    n_groups = np.bincount(of_group, minlength=count)
    n_links = np.zeros(count, dtype=np.int64)
    np.add.at(n_links, of_group, links)
    # linked pairs: one by one in ordinary groups, by distinct ids in very large ones
    span = np.int64(len(pair.a.bytes)) * pair.size_b
    plain = links <= _LARGE
    rep = np.where(plain, num_b, 0)[in_a]
    first = np.repeat(np.cumsum(rep) - rep, rep)
    at = np.repeat(from_b[in_a], rep) + np.arange(len(first)) - first
    keys = np.repeat(of_group[in_a] * span + a * pair.size_b, rep) + b[at]
    keys, times = np.unique(keys, return_counts=True)
    if not plain.all():
        more, often = [keys], [times]
        for g in np.flatnonzero(~plain):
            xa, ka = np.unique(a[from_a[g] : from_a[g] + num_a[g]], return_counts=True)
            xb, kb = np.unique(b[from_b[g] : from_b[g] + num_b[g]], return_counts=True)
            more.append((of_group[g] * span + xa[:, None] * pair.size_b + xb[None, :]).ravel())
            often.append((ka[:, None] * kb[None, :]).ravel())
        keys, back = np.unique(np.concatenate(more), return_inverse=True)
        times = np.zeros(len(keys), dtype=np.int64)
        np.add.at(times, back, np.concatenate(often))
    borders = np.searchsorted(keys, np.arange(count + 1) * span)
    codes = (keys % span).astype(np.int32)
    cut_up = list(zip(borders[:-1].tolist(), borders[1:].tolist()))
    return Groups(n_groups, n_links, texts, [codes[lo:hi] for lo, hi in cut_up], [times[lo:hi].astype(np.int64) for lo, hi in cut_up])


# -- the monoid -------------------------------------------------------------------------------------------------------
@dataclass
class Fragment:
    """Open ends of a byte range. Without a cut all its tokens are the prefix. ``first`` is the place of the leaf with the first cut."""

    cut: bool
    pa: list[int]
    pb: list[int]
    sa: list[int]
    sb: list[int]
    first: int


def leaf(pair: Pair, a: list[int], b: list[int], skew: int, place: int) -> tuple[Fragment, tuple[list[int], list[int]]]:
    """The fragment of a byte range, and its closed tokens. ``skew``: how far the first sequence begins beyond the second."""
    end_a, end_b = np.cumsum(pair.len_a[a]) + skew, np.cumsum(pair.len_b[b])
    common, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
    if not len(common):
        return Fragment(False, a, b, [], [], place), ([], [])
    fa, fb, la, lb = at_a[0] + 1, at_b[0] + 1, at_a[-1] + 1, at_b[-1] + 1
    return Fragment(True, a[:fa], b[:fb], a[la:], b[lb:], place), (a[fa:la], b[fb:lb])


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, tuple[int, list[int], list[int]] | None]:
    """The fragment of two neighbouring ranges, and the group that closes between them with its place."""
    if not x.cut:
        return Fragment(y.cut, x.pa + y.pa, x.pb + y.pb, y.sa, y.sb, y.first), None
    if not y.cut:
        return Fragment(True, x.pa, x.pb, x.sa + y.pa, x.sb + y.pb, x.first), None
    return Fragment(True, x.pa, x.pb, y.sa, y.sb, x.first), (y.first, x.sa + y.pa, x.sb + y.pb)


# -- Spark ------------------------------------------------------------------------------------------------------------
_LONG, _INTS = LongType(), ArrayType(IntegerType())
_FRAGMENT = "row long, idx long, kind int, cut boolean, pa array<int>, pb array<int>, sa array<int>, sb array<int>, first long, n_a long, n_b long, text string, n_groups long, n_links long, pairs array<int>, times array<long>"


def _fragment_row(row: int, idx: int, f: Fragment, n_a: int, n_b: int) -> dict:
    return dict(row=row, idx=idx, kind=0, cut=f.cut, pa=f.pa, pb=f.pb, sa=f.sa, sb=f.sb, first=f.first, n_a=n_a, n_b=n_b)


def _closed_rows(pair: Pair, row: int, places: list[int], stretches: list[tuple[list[int], list[int]]]) -> list[dict]:
    g = group_stretches(pair, stretches)
    return [dict(row=row, idx=p, kind=1, text=t, n_groups=int(n), n_links=int(k), pairs=c.tolist(), times=w.tolist()) for p, t, n, k, c, w in zip(places, g.texts, g.n_groups, g.n_links, g.pairs, g.times)]


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [x.split()[0] for x in _FRAGMENT.split(", ")]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})


def short_texts(docs: DataFrame, files: Files, slice_chars: int = 1 << 20) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of the rows (row, doc_id, text), each text a single fragment."""
    shared = docs.sparkSession.sparkContext.broadcast(files)
    schema = StructType([StructField("row", _LONG), StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(c, _LONG) for c in ("n_a", "n_b", "n_groups", "n_links")), StructField("groups_sha256", StringType()), StructField("pairs", _INTS), StructField("times", ArrayType(_LONG))])

    def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
        lo = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= slice_chars:
                yield lo, i + 1
                lo, size = i + 1, 0
        if lo < len(texts):
            yield lo, len(texts)

    def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared.value.pair()
        none = np.zeros(0, dtype=np.int64)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in slices(texts):
                coded = [pair.encode(t) if t else None for t in texts[lo:hi]]
                have = [i for i, c in enumerate(coded) if c]
                g = group_stretches(pair, [coded[i] for i in have])
                place = {i: k for k, i in enumerate(have)}
                pick = lambda values, empty, place=place, n=hi - lo: [values[place[i]] if i in place else empty for i in range(n)]
                counts = [[len(coded[i][0]) for i in have], [len(coded[i][1]) for i in have], g.n_groups.tolist(), g.n_links.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").slice(lo, hi - lo), b.column("doc_id").slice(lo, hi - lo), *(pa.array(pick(c, 0), pa.int64()) for c in counts),
                     pa.array(pick([hashlib.sha256(t.encode()).hexdigest() for t in g.texts], ""), pa.string()), lists(pick(g.pairs, none), pa.int32()), lists(pick(g.times, none), pa.int64())],
                    schema.names,
                )

    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def long_texts(docs: DataFrame, files: Files, chunk_chars: int, fan: int) -> DataFrame:
    """The same columns for texts of many fragments."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breaks = shared.value.pair().b.breaks
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                at = place = 0
                while True:
                    found = _BREAK.search(text, at + chunk_chars) if breaks and at + chunk_chars < len(text) else None
                    body = text[at : found.start()] if found else text[at:]
                    yield pd.DataFrame({"row": [row], "place": [place], "body": pd.Series([body], dtype=object)})
                    if not found:
                        break
                    place += len(body.encode()) + 1
                    at = found.end()

    pieces = cut(docs.select("row", "text").mapInPandas(split, "row long, place long, body string")).repartition("row", "place")

    def fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = shared.value.pair()
        for batch in batches:
            for row, place, body in zip(batch["row"], batch["place"], batch["body"]):
                coded = pair.encode(body)
                if coded is None:
                    yield _frame([dict(row=row, idx=place, kind=2)])
                    continue
                a, b = coded
                end_a, end_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])
                size = int(end_a[-1])
                low_a = low_b = 0
                for lo in range(0, size, chunk_chars):  # byte ranges of the piece; a token belongs where it ends
                    hi_a, hi_b = (int(np.searchsorted(e, min(lo + chunk_chars, size), side="right")) for e in (end_a, end_b))
                    skew = (int(end_a[low_a - 1]) if low_a else 0) - (int(end_b[low_b - 1]) if low_b else 0)
                    f, closed = leaf(pair, a[low_a:hi_a], b[low_b:hi_b], skew, place + lo)
                    rows = [_fragment_row(row, place + lo, f, hi_a - low_a, hi_b - low_b)]
                    if closed[0]:
                        rows += _closed_rows(pair, row, [2 * (place + lo) + 1], [closed])
                    yield _frame(rows)
                    low_a, low_b = hi_a, hi_b

    made = cut(pieces.mapInPandas(fragments, _FRAGMENT))
    wrong = made.where("kind = 2").select("row").distinct()
    closed, open_ends = [made.where("kind = 1")], made.where("kind = 0").join(wrong, "row", "left_anti")
    order = F.row_number().over(_by_row()) - 1
    open_ends = cut(open_ends.withColumn("idx", order.cast("long")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pair = shared.value.pair()
        pdf = pdf.sort_values("idx")
        acc, places, groups = None, [], []
        for r in pdf.itertuples():
            f = Fragment(r.cut, list(r.pa), list(r.pb), list(r.sa), list(r.sb), r.first)
            acc, group = (f, None) if acc is None else compose(acc, f)
            if group:
                places.append(2 * group[0])
                groups.append(group[1:])
        row, idx = int(pdf["row"].iloc[0]), int(pdf["idx"].iloc[0]) // fan
        kept = [(p, g) for p, g in zip(places, groups) if g[0]]
        rows = _closed_rows(pair, row, [p for p, _ in kept], [g for _, g in kept]) if kept else []
        return _frame([_fragment_row(row, idx, acc, int(pdf["n_a"].sum()), int(pdf["n_b"].sum())), *rows])

    most = open_ends.agg(F.max("idx")).first()[0] or 0
    while most > 0:
        level = cut(open_ends.groupBy("row", F.floor(F.col("idx") / fan)).applyInPandas(lambda pdf: fold(pdf), _FRAGMENT))
        closed.append(level.where("kind = 1"))
        open_ends = level.where("kind = 0")
        most //= fan

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first group of each text, closed by its beginning."""
        pair = shared.value.pair()
        for batch in batches:
            for r in batch.itertuples():
                yield _frame(_closed_rows(pair, r.row, [-1], [(list(r.pa), list(r.pb))]))

    groups = open_ends.mapInPandas(last, _FRAGMENT)
    for part in closed:
        groups = groups.unionByName(part)
    groups = cut(groups.join(wrong, "row", "left_anti"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda g: g["text"]), ";")
    whole = groups.groupBy("row").agg(F.sum("n_groups").alias("n_groups"), F.sum("n_links").alias("n_links"), F.sha2(joined.cast("binary"), 256).alias("groups_sha256"))
    linked = groups.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy("row", F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("time"))
    linked = linked.groupBy("row").agg(F.collect_list(F.struct("pair", "time")).alias("l")).select("row", F.col("l.pair").alias("pairs"), F.col("l.time").alias("times"))
    sizes = open_ends.select("row", "n_a", "n_b")
    out = docs.select("row", "doc_id").join(sizes, "row", "left").join(whole, "row", "left").join(linked, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "row", "doc_id", zero("n_a"), zero("n_b"), zero("n_groups"), zero("n_links"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
        F.coalesce("pairs", F.array().cast("array<int>")).alias("pairs"), F.coalesce("times", F.array().cast("array<bigint>")).alias("times"),
    )


def _by_row():
    from pyspark.sql import Window

    return Window.partitionBy("row").orderBy("idx")


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of each document, added up within the task."""
    keys, counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    out = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n, pa.int64())], ["pair", "n"])
    for b in batches:
        k, n = np.unique(b.column("pairs").flatten().to_numpy(zero_copy_only=False), return_counts=True)
        both = np.concatenate([keys, k])
        keys, back = np.unique(both, return_inverse=True)
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, back, np.concatenate([counts, n]))
        counts = total
        if len(keys) > 2_000_000:
            yield out(keys, counts)
            keys, counts = keys[:0], counts[:0]
    yield out(keys, counts)


def align(docs: DataFrame, files: Files, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32768, fan: int = 16, top_pairs: int = 1 << 18) -> DataFrame:
    """Groups, links and how common the links are, one row per document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    An id pair's count is the number of documents that hold it linked. ``n_best`` counts the links whose count is the highest among
    all pairs of their first id; ``count_sum`` adds the counts of all links.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    giant = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    giants = cut(rows.where(giant).withColumn("row", -1 - F.col("row")))
    coded = written(short_texts(rows.where(~giant), files).unionByName(long_texts(giants, files, chunk_chars, fan)), "aligned")
    counts = written(coded.select("pairs").mapInArrow(_pair_counts, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    size_b = files.pair().size_b

    ids = counts.groupBy(F.floor(F.col("pair") / size_b).cast("int").alias("a")).agg(F.max("n").alias("n")).toArrow()  # at most one row per id of the first vocabulary
    best = np.zeros(len(files.pair().a.bytes), dtype=np.int64)
    best[ids["a"].to_numpy()] = ids["n"].to_numpy()
    rank = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r["k"], r["c"]) for r in counts.groupBy(rank.alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)  # at most 512 rows
    limit, held = 1 << 30, 0
    for k, c in sizes:
        if held + c > top_pairs:
            break
        limit, held = k, held + c
    top = counts.where(rank >= limit).toArrow()
    order = np.argsort(top["pair"].to_numpy())
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy()[order], top["n"].to_numpy()[order], best, size_b))
    fields = [f for f in coded.schema.fields if f.name not in ("pairs", "times")]
    rest_type = ArrayType(StructType([StructField("pair", IntegerType()), StructField("time", _LONG)]))
    schema = StructType([*fields, StructField("n_best", _LONG), StructField("count_sum", _LONG), StructField("rest", rest_type)])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best, size_b = shared.value
        for b in batches:
            pairs, times = b.column("pairs").flatten().to_numpy(zero_copy_only=False), b.column("times").flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(b.column("pairs").value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
            n = np.where(hit, count[at] if len(known) else 0, 0)
            total = lambda v, ends=ends: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
            rest_ends = np.concatenate([[0], np.cumsum(~hit)])[ends].astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(pairs[~hit], pa.int32()), pa.array(times[~hit], pa.int64())], ["pair", "time"])
            cols = [b.column(f.name) for f in fields]
            cols += [pa.array(total(np.where(hit & (n == best[pairs // size_b]), times, 0)), pa.int64()), pa.array(total(n * times), pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(rest_ends, pa.int32()), rest)], schema.names)

    found = written(coded.mapInArrow(look_up, schema), "looked-up")
    best_of = counts.groupBy(F.floor(F.col("pair") / size_b).cast("int").alias("a")).agg(F.max("n").alias("most"))
    rare = counts.where(rank < limit).withColumn("a", F.floor(F.col("pair") / size_b).cast("int")).join(best_of, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    late = found.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.time").join(rare, "pair")
    late = late.groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("time")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("time")).alias("more_sum"))
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).cast("long").alias(c)
    return found.join(late, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")
