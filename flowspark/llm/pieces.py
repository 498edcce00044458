"""SentencePiece encoding and decoding as a max-plus parallel scan.

A segmentation is a path through a text: states are positions (with the last piece, for BPE), edges are pieces with weights,
and the encoding is the heaviest path. Giant documents are cut into chunks. A chunk's transfer matrix holds, for each
state in which a path can cross its start and each in which it can cross its end, the greatest weight between them; these
matrices multiply in the max-plus semiring, which is associative, so a tree of small products finds the states at
all chunk borders, and each chunk is then traced back on its own.

Both kinds of model fit the scheme. Unigram: the state is the position, the weight the piece's score. BPE: a sequence of
pieces is the BPE encoding of a text exactly if every two neighbours are the BPE encoding of their concatenation (merging
restricted to two neighbours runs as it does inside the whole); the state is position and last piece, the weight 0 for such
neighbours, minus infinity otherwise. The result equals the library's encoding for either kind.

A place that no piece spans (before a space mark that follows something else; around line feeds and digits where the
vocabulary has them alone) is crossed in one state only: there the matrices have rank one, and words between such places
are searched once in a block of texts; the one BPE path of a short word is found by merging, which is its definition, for
all words of a block at once. Chunks end at such places where they can, so that most matrices have one entry.

Defined cases: null and empty texts have no ids and decode to the empty text; the space mark U+2581 in a text is read as a
space; characters outside the vocabulary become bytes (or the unknown id); repeated rows each get their ids; an empty
table gives an empty result; other columns are kept. Equal weights of a unigram model go to the earlier, longer piece.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from flowspark.llm.common import cut

SPACE = "▁"
DEAD = float("-inf")


class Pieces:
    """Vocabulary, weights and the search of one model file."""

    PAIRS = 200_000
    SHORT, BLOCK = 64, 2 << 20

    def __init__(self, data: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(data)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        self.bpe = proto.trainer_spec.model_type == 2
        if not self.bpe and proto.trainer_spec.model_type != 1:
            raise ValueError("only unigram and BPE models are supported")
        self.texts = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4, 5)}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type in (1, 4, 5)}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unk, self.unk_surface = self.types.index(2), proto.trainer_spec.unk_surface
        shown = {2: lambda p: self.unk_surface, 3: lambda p: "", 6: lambda p: chr(b) if (b := int(p[3:5], 16)) < 128 else None}
        self.surface = [shown[t](p) if t in shown else p.replace(SPACE, " ") for p, t in zip(self.texts, self.types)]
        self.unk_score = min(self.scores.values(), default=0.0) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        longer = "".join(p for p in self.ids if len(p) > 1)
        self.spaces_lead = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.lone = {c for c in "\n\t0123456789" if c not in longer}
        self.kinds = np.zeros(256, np.uint8)  # of a byte: 1 for a space, 2 for a character that is a word alone
        self.kinds[[ord(" "), *map(ord, self.lone)]] = [1, *[2] * len(self.lone)]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.merges: Merges | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": {}, "merges": None}

    # -- weights ------------------------------------------------------------------------------------------------
    def merged(self, text: str) -> list[str]:
        """BPE of a short text by its definition: merge the best-scored neighbours, leftmost first."""
        parts, score = list(text), self.scores.get
        heights = [score(a + b, DEAD) for a, b in zip(parts, parts[1:])]
        while heights and (best := max(heights)) != DEAD:
            at = heights.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del heights[at]
            if at < len(heights):
                heights[at] = score(parts[at] + parts[at + 1], DEAD)
            if at:
                heights[at - 1] = score(parts[at - 1] + parts[at], DEAD)
        return parts

    def weight(self, last: str, piece: str) -> float:
        """Weight of ``piece`` after ``last`` ('' where nothing before matters)."""
        if not self.bpe:
            return self.scores.get(piece, self.unk_score)
        known = self.pairs.get((last, piece))
        if known is None:
            if len(self.pairs) > self.PAIRS:
                self.pairs.clear()
            known = self.pairs[last, piece] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return 0.0 if known else DEAD

    # -- search -------------------------------------------------------------------------------------------------
    def walk(self, s: str, starts: dict[tuple[int, str], float], stop: int) -> dict[int, dict[str, tuple]]:
        """Best way to each state: position -> last piece -> (weight, position before, piece before). Pieces start before ``stop``."""
        nodes: dict[int, dict[str, tuple]] = {}
        for (at, last), w in starts.items():
            nodes.setdefault(at, {})[last] = (w, -1, "")
        ids, longest, n, bpe = self.ids, self.longest, len(s), self.bpe
        for p in range(min(nodes, default=stop), stop):
            here = nodes.get(p)
            if not here:
                continue
            for q in range(p + 1, min(p + longest, n) + 1):
                piece = s[p:q]
                if q > p + 1 and piece not in ids:
                    continue
                for last, (w, _, _) in here.items():
                    w2 = w + self.weight(last, piece)
                    if w2 == DEAD:
                        continue
                    there = nodes.setdefault(q, {})
                    key = piece if bpe else ""
                    if key not in there or w2 > there[key][0]:
                        there[key] = (w2, p, last)
        return nodes

    def trace(self, s: str, nodes: dict[int, dict[str, tuple]], at: int, last: str) -> list[int]:
        """Ids of the pieces of the best way that ends in a state."""
        found = []
        while True:
            _, before, was = nodes[at][last]
            if before < 0:
                return [i for piece in reversed(found) for i in self.ids_of(piece)]
            found.append(s[before:at])
            at, last = before, was

    def ids_of(self, piece: str) -> Iterable[int]:
        if (i := self.ids.get(piece)) is not None:
            return (i,)
        return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte else (self.unk,)

    def word(self, word: str) -> list[int]:
        """Ids of the text between two places that no piece spans."""
        if self.bpe and len(word) <= self.SHORT:
            return [i for piece in self.merged(word) for i in self.ids_of(piece)]
        nodes = self.walk(word, {(0, ""): 0.0}, len(word))
        last = max(nodes[len(word)].items(), key=lambda kv: kv[1][0])[0]
        return self.trace(word, nodes, len(word), last)

    def split_words(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """Words of the texts, in which spaces stand for the space mark, and the number of the first word of each text."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        if not ends[-1]:
            return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[: ends[-1]]
        if self.spaces_lead:
            kinds = self.kinds[data]
            starts = kinds == 2
            starts[1:] |= (kinds[:-1] == 2) | ((kinds[1:] == 1) & (kinds[:-1] != 1))
        else:
            starts = np.zeros(len(data), bool)
        starts[ends[:-1][np.diff(ends) > 0]] = True
        at = np.append(np.flatnonzero(starts), ends[-1]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), texts.buffers()[2]), np.searchsorted(at, ends)

    def distinct_ids(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of distinct words."""
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # numbers of words with equally many ids, and these
        slow = np.arange(len(words))
        if self.bpe and len(words):
            if self.merges is None:
                self.merges = Merges(self)
            points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
            begins, order = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable")
            borders = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
            left = []
            for same in (order[a:b] for a, b in zip(borders[:-1], borders[1:])):
                size = int(sizes[same[0]])
                parts = self.merges.characters(points[begins[same][:, None] + np.arange(size)]) if size <= self.SHORT else np.full((len(same), 1), -1)
                known = (parts >= 0).all(axis=1)
                left.append(same[~known])
                for rows, ids in self.merges.merge(parts[known]):
                    if ids is None:
                        left.append(same[known][rows])
                    else:
                        found.append((same[known][rows], ids))
            slow = np.concatenate(left)
        for i in slow.tolist():
            found.append((np.array([i]), np.array([self.word(words[i].as_py().replace(" ", SPACE))], np.int32)))
        ends = np.zeros(len(words) + 1, np.int32)
        for rows, ids in found:
            ends[rows + 1] = ids.shape[1]
        np.cumsum(ends, out=ends)
        flat = np.empty(ends[-1], np.int32)
        for rows, ids in found:
            flat[ends[rows][:, None] + np.arange(ids.shape[1])] = ids
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    def word_ids(self, texts: pa.StringArray) -> pa.ListArray:
        """Ids of texts that begin and end at places that no piece spans; spaces stand for the space mark."""
        words, first = self.split_words(texts)
        coded = words.dictionary_encode()
        ids = self.distinct_ids(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends[first]), ids.values)

    def encode_all(self, texts: pa.Array) -> Iterator[pa.ListArray]:
        """Ids of texts of one chunk each, in blocks of texts in their order."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), SPACE, " ")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + self.BLOCK, side="right")))
            part = texts.slice(at, to - at)
            yield self.word_ids(pc.if_else(pc.equal(part, ""), "", pc.binary_join_element_wise(" ", part, "")))
            at = to

    def encode(self, text: str | None) -> array:
        """Ids of a text of one chunk."""
        return array("i", [i for block in self.encode_all(pa.array([text], pa.string())) for i in block.flatten().tolist()])

    def decode(self, ids: Iterable[int]) -> str:
        try:
            text = "".join(map(self.surface.__getitem__, ids))
            return text[1:] if text[:1] == " " else text
        except TypeError:  # bytes of characters beyond ASCII
            pass
        out, raw = [], bytearray()
        for i in ids:
            if self.types[i] == 6:
                raw.append(int(self.texts[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if self.types[i] == 2:
                out.append(self.unk_surface)
            elif self.types[i] != 3:
                out.append(self.texts[i].replace(SPACE, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text[:1] == " " else text

    # -- chunks -------------------------------------------------------------------------------------------------
    def hard(self, s: str, p: int) -> bool:
        """No piece spans the place before s[p]."""
        a, b = s[p - 1], s[p]
        return a in self.lone or b in self.lone or (self.spaces_lead and b == SPACE and a != SPACE)

    def crossings(self, s: str, at: int) -> list[tuple[int, str]]:
        """States in which a path can cross the border before s[at]: (how far its piece reaches beyond, piece)."""
        if at <= 0 or at >= len(s):
            return [(0, "")]
        if self.hard(s, at):
            return [(0, "")]
        found = set()
        for i in range(max(0, at - self.longest), at):
            for j in range(at, min(i + self.longest, len(s)) + 1):
                if j == i + 1 or s[i:j] in self.ids:
                    found.add((j - at, s[i:j] if self.bpe else ""))
        return sorted(found)

    def cuts(self, s: str, begin: int, end: int) -> tuple[int, int] | None:
        """First and last place in the chunk that no piece spans, beyond what can reach in from before."""
        first = next((p for p in range(begin + 1, end) if self.hard(s, p)), None)
        if first is None:
            return None
        return first, next(p for p in range(end - 1, begin, -1) if self.hard(s, p))

    def transfer(self, s: str, begin: int, end: int) -> list[tuple[int, str, int, str, float]]:
        """The chunk s[begin:end] as a sparse matrix (reach in, piece in, reach out, piece out, weight); s has its surroundings."""
        entries, exits = self.crossings(s, begin), self.crossings(s, end)
        ends = {(end + o, t) for o, t in exits}
        free = end >= len(s) or self.hard(s, end)

        def leave(nodes: dict, base: float = 0.0) -> Iterator[tuple[int, str, float]]:
            if free:
                if nodes.get(end):
                    yield 0, "", base + max(v[0] for v in nodes[end].values())
                return
            for at in range(end, end + self.longest):
                for last, v in nodes.get(at, {}).items():
                    if (at, last) in ends:
                        yield at - end, last, base + v[0]

        inner = self.cuts(s, begin, end)
        rows = []
        if inner is None:
            for o, t in entries:
                rows += [(o, t, *x) for x in leave(self.walk(s, {(begin + o, t): 0.0}, end))]
            return rows
        first, last = inner
        middle = 0.0
        if not self.bpe and first < last:
            for w in self.split_words(pa.array([s[first:last].replace(SPACE, " ")]))[0].to_pylist():
                nodes = self.walk(w.replace(" ", SPACE), {(0, ""): 0.0}, len(w))
                middle += max(v[0] for v in nodes[len(w)].values())
        tail = list(leave(self.walk(s, {(last, ""): 0.0}, end)))
        for o, t in entries:
            nodes = self.walk(s[:first], {(begin + o, t): 0.0}, first) if begin + o <= first else {}
            if nodes.get(first):
                w = max(v[0] for v in nodes[first].values())
                rows += [(o, t, xo, xt, w + middle + xw) for xo, xt, xw in tail]
        return rows

    def chunk_ids(self, s: str, begin: int, end: int, came: tuple[int, str], left: tuple[int, str]) -> array:
        """Ids of the pieces that start in the chunk, between two known states."""
        return array("i", self.all_chunk_ids([(s, begin, end, came, left)]).flatten().tolist())

    def all_chunk_ids(self, chunks: list[tuple[str, int, int, tuple[int, str], tuple[int, str]]]) -> pa.ListArray:
        """Ids of the pieces that start in each chunk; the words in the middle of all chunks are searched together."""

        def stretch(text: str, a: tuple[int, str], stop: int, at: int, last: str | None) -> list[int]:
            nodes = self.walk(text, {a: 0.0}, stop)
            if last is None:
                last = max(nodes[at].items(), key=lambda kv: kv[1][0])[0]
            return self.trace(text, nodes, at, last)

        parts = []
        for s, begin, end, came, left in chunks:
            start, goal = (begin + came[0], came[1]), (end + left[0], left[1])
            aim = (goal[0], None if end >= len(s) or self.hard(s, end) else goal[1])
            inner = self.cuts(s, begin, end)
            if inner is None:
                parts.append((stretch(s, start, end, *aim), "", []))
            else:
                first, last = inner
                parts.append((stretch(s[:first], start, first, first, None), s[first:last], stretch(s, (last, ""), end, *aim)))
        middles = pc.replace_substring(pa.array([m for _, m, _ in parts], pa.string()), SPACE, " ")
        ids = self.word_ids(middles)
        ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        joined = [np.concatenate([np.array(head, np.int32), flat[a:b], np.array(tail, np.int32)]) for (head, _, tail), a, b in zip(parts, ends, ends[1:])]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, joined)], dtype=np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *joined])))

    def borders(self, s: str, size: int) -> list[int]:
        """Borders of chunks of at most ``size`` characters, in the latter half of each at a place that no piece spans if there is one."""
        found = [0]
        while (at := found[-1]) < len(s):
            to = min(at + size, len(s))
            found.append(to if to == len(s) else next((p for p in range(to, at + size // 2, -1) if self.hard(s, p)), to))
        return found


class Merges:
    """BPE of many short words at once, by its definition: in each round every word merges its best-scored neighbours, leftmost first.

    ``keys`` are pairs (left id, right id) in a hash table with open addressing, ``ranks`` the order of the scores of what they make.
    """

    def __init__(self, model: Pieces) -> None:
        ids, self.width = model.ids, len(model.texts)
        order = sorted(set(model.scores.values()))
        rank = {s: i + 1 for i, s in enumerate(order)}
        made = [(ids[p[:i]] * self.width + ids[p[i:]], rank[model.scores[p]], j) for p, j in ids.items() for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        self.joined = np.zeros(len(order) + 1, np.int32)
        for _, r, j in made:
            self.joined[r] = j if self.joined[r] in (0, j) else -1  # -1: one score for several pieces, as runs of spaces have
        self.single = np.full(max((ord(p) for p in ids if len(p) == 1), default=0) + 2, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.single[ord(" ")] = ids.get(SPACE, -1)
        slots = 1 << (8 * len(made) + 8).bit_length()
        self.shift, self.mask = np.uint64(65 - slots.bit_length()), slots - 1
        self.keys, self.ranks = np.full(slots, -1, np.int64), np.zeros(slots, np.int32)
        keys, ranks = np.array([k for k, _, _ in made], np.int64), np.array([r for _, r, _ in made], np.int32)
        slot = self.slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.ranks[slot[mine]] = ranks[mine]
            keys, ranks, slot = keys[~mine], ranks[~mine], (slot[~mine] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def characters(self, points: np.ndarray) -> np.ndarray:
        """Ids of single characters, -1 for those without."""
        return self.single[np.minimum(points, len(self.single) - 1)]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair makes, 0 for nothing."""
        keys = (left.astype(np.int64) * self.width + right).ravel()
        slot = self.slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.ranks[slot], 0)
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            there = self.keys[slot[more]]
            same = there == keys[more]
            found[more[same]] = self.ranks[slot[more[same]]]
            more = more[~same & (there >= 0)]
        return found.reshape(left.shape)

    def merge(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Numbers of words with equally many ids, and these, of words of one length given as the ids of their characters (words, characters).

        None instead of ids: words in which the rank of a pair does not tell the piece.
        """
        rows, size = np.arange(len(parts)), parts.shape[1]
        ranks = self.find(parts[:, :-1], parts[:, 1:])
        while len(rows):
            at = ranks.argmax(axis=1) if size > 1 else rows
            best = ranks[np.arange(len(rows)), at] if size > 1 else np.zeros(len(rows), np.int32)
            if (vague := self.joined[best] < 0).any():
                yield rows[vague], None
                rows, parts, ranks, at, best = rows[~vague], parts[~vague], ranks[~vague], at[~vague], best[~vague]
            goes = best > 0
            if not goes.all():
                yield rows[~goes], parts[~goes]
                rows, parts, ranks, at, best = rows[goes], parts[goes], ranks[goes], at[goes], best[goes]
            if not len(rows):
                return
            k, size = np.arange(len(rows)), size - 1
            after = np.arange(size) > at[:, None]
            parts = np.where(after, parts[:, 1:], parts[:, :-1])
            parts[k, at] = self.joined[best]
            ranks = np.where(after[:, 1:], ranks[:, 1:], ranks[:, :-1])
            i = np.concatenate([k[at > 0], k[at < size - 1]])
            j = np.concatenate([at[at > 0] - 1, at[at < size - 1]])
            ranks[i, j] = self.find(parts[i, j], parts[i, j + 1])


def product(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """Max-plus product of two sparse matrices of (in, in, out, out, weight)."""
    by: dict[tuple, list] = {}
    for i, j, k, m, w in b:
        by.setdefault((i, j), []).append((k, m, w))
    best: dict[tuple, float] = {}
    for i, j, k, m, w in a:
        for x, y, v in by.get((k, m), ()):
            key = (i, j, x, y)
            if w + v > best.get(key, DEAD):
                best[key] = w + v
    return [(*k, w) for k, w in best.items()]


def best_states(mats: list[list[tuple]], came: tuple, left: tuple) -> list[tuple]:
    """States at the borders of neighbouring chunks on the best way from ``came`` to ``left``."""
    layer: dict[tuple, float] = {came: 0.0}
    back: list[dict[tuple, tuple]] = []
    for m in mats:
        after: dict[tuple, float] = {}
        via: dict[tuple, tuple] = {}
        for i, j, k, x, w in m:
            if (i, j) in layer and layer[i, j] + w > after.get((k, x), DEAD):
                after[k, x], via[k, x] = layer[i, j] + w, (i, j)
        layer = after
        back.append(via)
    states = [left]
    for via in reversed(back):
        states.append(via[states[-1]])
    return states[::-1]


def load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


_MATRIX = "array<struct<i:int,a:string,o:int,b:string,w:double>>"
_KEY = "key string, level int, idx long, m " + _MATRIX


def _rows(m: list[tuple]) -> list[dict]:
    return [dict(zip("iaobw", r)) for r in m]


def _tuples(m) -> list[tuple]:
    return [(r["i"], r["a"], r["o"], r["b"], r["w"]) for r in m]


def encode(docs: DataFrame, model: Pieces, text_col: str = "text", out_col: str = "ids", chunk_chars: int = 16384, fan: int = 64) -> DataFrame:
    """``docs`` with the ids of each text. Texts up to ``chunk_chars`` are one chunk; longer ones go through the scan."""
    giant = F.coalesce(F.length(text_col) > chunk_chars, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small = encode_small(docs.where(~giant), shared, text_col, out_col)
    large = docs.where(giant)
    key = F.sha2(F.col(text_col).cast("binary"), 256)
    ids = scan(large.select(key.alias("key"), F.col(text_col).alias("text")), shared, chunk_chars, fan)
    ids = ids.select(F.col("key").alias("_key"), F.col("ids").alias(out_col))
    return small.unionByName(large.withColumn("_key", key).join(ids, "_key").drop("_key"))


def encode_small(docs: DataFrame, shared: Broadcast, text_col: str, out_col: str) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for b in batches:
            at = 0
            for ids in pieces.encode_all(b.column(names.index(text_col))):
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(ids)).columns, ids], [*names, out_col])
                at += len(ids)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out_col, ArrayType(IntegerType()))]))


def scan(texts: DataFrame, shared: Broadcast, chunk_chars: int, fan: int) -> DataFrame:
    """(key, ids) of the distinct giant texts (key, text); ``shared`` is the model."""
    margin = shared.value.longest

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text in zip(b["key"], b["text"]):
                s = SPACE + text.replace(" ", SPACE)
                borders = shared.value.borders(s, chunk_chars)
                n, lows = len(borders) - 1, [max(0, at - margin) for at in borders]
                for i in range(0, n, fan):
                    some = range(i, min(i + fan, n))
                    rows = [(key, k, n, s[lows[k] : borders[k + 1] + margin], borders[k] - lows[k], borders[k + 1] - lows[k]) for k in some]
                    yield pd.DataFrame(rows, columns=["key", "idx", "n", "s", "begin", "end"])

    chunks = texts.dropDuplicates(["key"]).mapInPandas(split, "key string, idx long, n long, s string, begin int, end int").repartition("key", "idx")
    chunks = cut(chunks)

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ms = [_rows(shared.value.transfer(s, x, y)) for s, x, y in zip(b["s"], b["begin"], b["end"])]
            yield pd.DataFrame({"key": b["key"], "level": 0, "idx": b["idx"], "m": ms})

    def side_by_side(df: DataFrame) -> DataFrame:
        """Neighbouring matrices, at most ``fan``, in one row: (key, up, level, ms)."""
        return df.groupBy("key", F.floor(F.col("idx") / fan).alias("up"), "level").agg(F.sort_array(F.collect_list(F.struct("idx", "m"))).alias("ms"))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for ms in b["ms"]:
                acc = _tuples(ms[0]["m"])
                for m in ms[1:]:
                    acc = product(acc, _tuples(m["m"]))
                made.append(_rows(acc))
            yield pd.DataFrame({"key": b["key"], "level": b["level"] + 1, "idx": b["up"], "m": made})

    levels = [cut(chunks.mapInPandas(matrices, _KEY))]
    most = chunks.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(cut(side_by_side(levels[-1]).mapInPandas(multiply, _KEY)))
        most = -(-most // fan)

    state = "key string, idx long, ci int, ca string, lo int, la string"
    best = F.array_max(F.transform(F.filter("m", lambda r: (r["i"] == 0) & (r["a"] == "")), lambda r: F.struct(r["w"].alias("w"), r["o"].alias("o"), r["b"].alias("b"))))
    known = levels[-1].select("key", "idx", F.lit(0).alias("ci"), F.lit("").alias("ca"), best["o"].alias("lo"), best["b"].alias("la"))

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                at = best_states([_tuples(m["m"]) for m in r.ms], (r.ci, r.ca), (r.lo, r.la))
                rows += [(r.key, m["idx"], *came, *left) for m, came, left in zip(r.ms, at, at[1:])]
            yield pd.DataFrame(rows, columns=["key", "idx", "ci", "ca", "lo", "la"])

    for below in reversed(levels[:-1]):
        known = cut(side_by_side(below).join(known.withColumnRenamed("idx", "up"), ["key", "up"]).mapInPandas(descend, state))

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), fan):
                part = b.slice(at, fan)
                rows = part.select(["s", "begin", "end", "ci", "ca", "lo", "la"]).to_pylist()
                ids = shared.value.all_chunk_ids([(r["s"], r["begin"], r["end"], (r["ci"], r["ca"]), (r["lo"], r["la"])) for r in rows])
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("idx"), ids], ["key", "idx", "part"])

    parts = chunks.join(known, ["key", "idx"]).mapInArrow(backtrace, "key string, idx long, part array<int>")
    return parts.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("idx", "part"))), lambda p: p["part"])).alias("ids"))


def decode(df: DataFrame, model: Pieces, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def texts(ids: pd.Series) -> pd.Series:
        return pd.Series([shared.value.decode(i.tolist()) if i is not None else None for i in ids], dtype=object)

    return df.withColumn(out_col, F.pandas_udf(texts, "string")(F.col(ids_col)))
