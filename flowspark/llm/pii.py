"""Personal data: a character-level bidirectional LSTM with CRF transitions next to four base patterns.

The network reads a text in overlapping windows: all of them in which a span could read as its kind (see ``places``), and their neighbours as far
as a span reaches over to them. No other window can add a span or change one, so the result is that of reading them all. Each window is decoded to the best tag sequence under the
CRF; spans of all windows of a text are then reconciled: parts of a span that a window border cut are joined where their windows overlap, and of
conflicting spans those with the greatest total weight stay (weighted interval scheduling over the whole text). A span that the network
adds must read as its kind (an address with a host, four numbers up to 255, a card number with a valid check digit, 9 to 15 digits with
separators) and must not touch a base span; base spans always stay.

Training is numpy on the driver, from labelled spans: base spans of about ``max_docs`` documents in their surroundings, at most ``max_windows`` of them.
Half of them are rewritten to other spellings of their kind ("name at host dot org", numbers with other separators), and
numbers that are no personal data (dates, prices, versions, keys) stand between them as negatives.

Defined cases: null and empty texts have no spans; offsets are code points, end exclusive; equal texts have equal spans; repeated rows each get theirs; without a
labelled span in the sample only the base spans are found; an empty table gives an empty result; other columns are kept, whatever their names.
Whole texts are searched, long ones in windows like all others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, STEP = 512, 448, 64
_OTHERS, _PAD = 128, 133
_SYMBOLS = 134

Span = tuple[int, int, int]  # start, end, kind


# -- base patterns --------------------------------------------------------------------------------------------------
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with the local characters before it and a host behind it; linear where a search for the whole pattern is not."""
    end, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at)
        if host:
            low = max(end, text.rfind("@", end, at) + 1)
            reach = _LOCAL_END.match(text[low:at][::-1]).end()
            if reach:
                end = host.end()
                yield at - reach, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that hold its rule, by start, then kind."""
    if not text:
        return []
    found = [(a, b, 0) for a, b in _emails(text)]
    for m in _DOTTED.finditer(text):
        at = m.start()
        parts = m[0].split(".")
        for i in range(0, len(parts), 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if len(four) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                found.append((at, at + size, 1))
            at += size + 1
    for m in _DIGITS.finditer(text):
        if 12 <= m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


# -- characters -----------------------------------------------------------------------------------------------------
_TABLE: np.ndarray | None = None


def codes(text: str) -> np.ndarray:
    """One symbol per character: ASCII as it is, other characters by what they are."""
    global _TABLE
    if _TABLE is None:
        kind = lambda c: 131 if c.isspace() else 130 if c.isdigit() else 128 if c.isupper() else 129 if c.isalpha() else 132
        _TABLE = np.array([i if i < _OTHERS else kind(chr(i)) for i in range(1 << 16)] + [132], dtype=np.uint8)
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 1 << 16)]


# -- network --------------------------------------------------------------------------------------------------------
@dataclass
class Network:
    """Both directions in one: ``inputs`` (2, symbols, 4H) with biases, ``recur`` (2, H, 4H), ``out`` (2, H, tags), ``bias`` and CRF weights.

    The four parts of a row are input, forget and output gate and the new value; gates are kept halved, sigmoid(x) = (1 + tanh(x / 2)) / 2.
    """

    inputs: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray
    begin: np.ndarray

    @staticmethod
    def fresh(hidden: int, rng: np.random.Generator) -> "Network":
        tags = len(KINDS) + 1
        draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        net = Network(draw(2, _SYMBOLS, 4 * hidden, s=0.3), draw(2, hidden, 4 * hidden, s=0.6 / np.sqrt(hidden)), draw(2, hidden, tags, s=0.3), np.zeros(tags, np.float32), np.zeros((tags, tags), np.float32), np.zeros(tags, np.float32))
        net.inputs[:, :, hidden : 2 * hidden] += 0.5
        return net

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.recur, self.out, self.bias, self.trans, self.begin]

    def emissions(self, windows: np.ndarray) -> np.ndarray:
        """(T, tags, B) scores of the windows (B, T)."""
        n, length = windows.shape
        hidden = self.recur.shape[1]
        steps = np.ascontiguousarray(windows.T).astype(np.intp)
        score = np.empty((length, len(self.bias), n), np.float32)
        score[:] = self.bias[:, None]
        for d in (0, 1):
            # twice the hidden state is carried, so gates need no halving: 1 + tanh(x) is twice the sigmoid of 2x
            table, recur, out = self.inputs[d], self.recur[d] * np.float32(0.5), np.ascontiguousarray(self.out[d].T) * np.float32(0.5)
            h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
            z, x, new, e = np.empty((n, 4 * hidden), np.float32), np.empty((n, 4 * hidden), np.float32), np.empty((n, hidden), np.float32), np.empty((len(self.bias), n), np.float32)
            gates, enter, keep, leave, value = z[:, : 3 * hidden], z[:, :hidden], z[:, hidden : 2 * hidden], z[:, 2 * hidden : 3 * hidden], z[:, 3 * hidden :]
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                np.dot(h, recur, out=z)
                np.take(table, steps[t], axis=0, out=x, mode="clip")
                z += x
                np.tanh(z, out=z)
                gates += 1.0
                np.multiply(enter, value, out=new)
                c *= keep
                c += new
                c *= 0.5
                np.tanh(c, out=h)
                h *= leave
                np.dot(out, h.T, out=e)
                score[t] += e
        return score

    def decode(self, score: np.ndarray) -> np.ndarray:
        """Best tags (T, B). Windows in which no run of tags can pay for leaving "outside" need no search back."""
        length, tags, n = score.shape
        found = np.zeros((length, n), np.int8)
        worth = score[:, 1:] - score[:, :1]  # of a tag over "outside"
        step, stay = self.trans - self.trans[0, 0], np.maximum(self.trans[1:, 1:].max(axis=0), self.trans[0, 1:]) - self.trans[0, 0]
        leave = np.maximum(step[1:, 0], 0.0)
        first = np.maximum(self.begin[1:] - self.begin[0], stay)
        # no tag is worth a place even with its best neighbours; else, no run of tags pays for itself
        rows = np.flatnonzero(((worth.max(axis=0) + (np.maximum(first, stay) + leave)[:, None]) > 0).any(axis=0))
        if len(rows):
            part = worth[:, :, rows]
            run = part[0] + (self.begin[1:] - self.begin[0])[:, None]
            pays = (run + (step[1:, :1] if length > 1 else 0.0)).max(axis=0)
            for t in range(1, length):
                ahead = np.maximum((run[:, None, :] + step[1:, 1:, None]).max(axis=0), step[0, 1:, None])
                run = part[t] + ahead
                np.maximum(pays, (run + (step[1:, :1] if t < length - 1 else 0.0)).max(axis=0), out=pays)
            rows = rows[pays > 0]
        if not len(rows):
            return found
        part = score[:, :, rows].transpose(0, 2, 1)
        best = part[0] + self.begin
        back = np.empty((length, len(rows), tags), np.int8)
        for t in range(1, length):
            ways = best[:, :, None] + self.trans
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + part[t]
        at = best.argmax(axis=1)
        span = np.arange(len(rows))
        for t in range(length - 1, -1, -1):
            found[t, rows] = at
            if t:
                at = back[t, span, at]
        return found


def gradients(net: Network, windows: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the tags (B, T) per character, and its gradients, by backpropagation through time."""
    n, length = windows.shape
    hidden, k = net.recur.shape[1], len(net.bias)
    steps, truth = windows.T, tags.T
    hs, kept = np.zeros((2, length, n, hidden), np.float32), [[None] * length, [None] * length]
    for d in (0, 1):
        h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            z = np.tanh(h @ net.recur[d] + net.inputs[d][steps[t]])
            i, f, o = (0.5 + 0.5 * z[:, j * hidden : (j + 1) * hidden] for j in range(3))
            g = z[:, 3 * hidden :]
            before = (h, c)
            c = f * c + i * g
            r = np.tanh(c)
            h = o * r
            hs[d, t], kept[d][t] = h, (before, i, f, o, g, r)
    score = hs[0] @ net.out[0] + hs[1] @ net.out[1] + net.bias
    # CRF: forward and backward sums, expected minus observed
    logsum = lambda v, axis: (m := v.max(axis=axis, keepdims=True), np.log(np.exp(v - m).sum(axis=axis)) + m.squeeze(axis))[1]
    fwd, bwd = np.empty_like(score), np.zeros_like(score)
    fwd[0] = score[0] + net.begin
    for t in range(1, length):
        fwd[t] = logsum(fwd[t - 1][:, :, None] + net.trans, 1) + score[t]
    for t in range(length - 2, -1, -1):
        bwd[t] = logsum(net.trans + (score[t + 1] + bwd[t + 1])[:, None, :], 2)
    whole = logsum(fwd[-1], 1)
    hot = np.eye(k, dtype=np.float32)[truth]
    expected = np.exp(fwd + bwd - whole[None, :, None])
    pairs = np.exp(fwd[:-1, :, :, None] + net.trans + (score[1:] + bwd[1:])[:, :, None, :] - whole[None, :, None, None]).sum(axis=(0, 1))
    seen = np.zeros((k, k), np.float32)
    np.add.at(seen, (truth[:-1].ravel(), truth[1:].ravel()), 1)
    right = (score * hot).sum() + net.begin[truth[0]].sum() + (seen * net.trans).sum()
    size = np.float32(n * length)
    loss = float((whole.sum() - right) / size)
    d_score = (expected - hot) / size
    d_trans, d_begin = (pairs - seen) / size, d_score[0].sum(axis=0)
    d_inputs, d_recur, d_out = np.zeros_like(net.inputs), np.zeros_like(net.recur), np.zeros_like(net.out)
    for d in (0, 1):
        d_out[d] = hs[d].reshape(-1, hidden).T @ d_score.reshape(-1, k)
        dh, dc = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
        dzs = np.empty((length, n, 4 * hidden), np.float32)
        for t in range(length - 1, -1, -1) if d == 0 else range(length):
            (h0, c0), i, f, o, g, r = kept[d][t]
            dh = dh + d_score[t] @ net.out[d].T
            dc = dc + dh * o * (1 - r * r)
            dz = np.concatenate([dc * g * 2 * i * (1 - i), dc * c0 * 2 * f * (1 - f), dh * r * 2 * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            d_recur[d] += h0.T @ dz
            dh, dc = dz @ net.recur[d].T, dc * f
            dzs[t] = dz
        one = np.zeros((_SYMBOLS, length * n), np.float32)
        one[steps.ravel(), np.arange(length * n)] = 1
        d_inputs[d] = one @ dzs.reshape(-1, 4 * hidden)
    return loss, [d_inputs, d_recur, d_out, d_score.sum(axis=(0, 1)), d_trans, d_begin]


def train(windows: list[tuple[str, list[Span]]], hidden: int = 12, steps: int = 900, batch: int = 64, length: int = 96, rate: float = 0.03, seed: int = 7) -> Network:
    """Adam over labelled windows (text, spans), each padded or cut around a place drawn anew."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(hidden, rng)
    coded = []
    for text, spans in windows:
        tags = np.zeros(len(text), np.int8)
        for a, b, kind in spans:
            tags[a:b] = kind + 1
        coded.append((codes(text), tags))
    mean, square = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        x, y = np.full((batch, length), _PAD, np.uint8), np.zeros((batch, length), np.int8)
        for j, pick in enumerate(rng.integers(len(coded), size=batch)):
            c, t = coded[pick]
            at = int(rng.integers(max(1, len(c) - length + 1)))
            part = c[at : at + length]
            x[j, : len(part)], y[j, : len(part)] = part, t[at : at + length]
        _, grads = gradients(net, x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, s in zip(net.weights(), grads, mean, square):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


# -- labelled windows -----------------------------------------------------------------------------------------------
def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng) -> str:
    digits = str(rng.integers(3, 7)) + _number(rng, int(rng.choice([14, 14, 14, 13])))
    return next(digits + str(d) for d in range(10) if luhn(digits + str(d)))


def respelled(kind: int, value: str, rng, words: list[str]) -> str:
    """Another spelling of a labelled span, or another value of its kind."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    if kind == 0:
        user = pick(value.split("@")[0], pick(*words), f"{pick(*words)}.{pick(*words)}", f"{pick(*words)}{_number(rng, 2)}", f"{pick(*words)}_{pick(*words)}")
        host = [*(pick(*words) for _ in range(int(rng.integers(1, 3)))), pick("com", "org", "net", "de", "fr", "es", "edu", "io", "co", "info")]
        at, dot = pick(("@", "."), ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" AT ", " DOT "), (" @ ", "."))
        return user + at + dot.join(host)
    if kind == 1:
        return pick(".", ".", " . ", "[.]", "(.)", ". ").join(str(rng.integers(256)) for _ in range(4))
    if kind == 2:
        digits, sep = _card(rng), pick("", " ", "-", ".", "  ", " - ", "/")
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    n = lambda k: _number(rng, k)
    return pick(f"+{n(2)} {n(3)} {n(3)} {n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"00{n(2)} {n(3)} {n(7)}", f"0{n(3)}/{n(7)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"+{n(2)}/{n(3)}/{n(6)}")


def harmless(rng, words: list[str]) -> str:
    """Figures and words that look a little like personal data."""
    pick, n = lambda *xs: xs[int(rng.integers(len(xs)))], lambda k: _number(rng, k)
    return pick(
        f"20{n(2)}-0{rng.integers(1, 10)}-{rng.integers(10, 29)}", f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.20{n(2)}", f"{rng.integers(24)}:{rng.integers(10, 60)}", f"{n(2)}.{n(2)} EUR", f"${n(3)}.{n(2)}", f"{n(1)}.{n(1)}.{n(1)}",
        f"v{n(1)}.{n(2)}", f"{n(3)},{n(3)}", f"{n(5)}", f"{n(8)}", f"{n(10)}", f"{n(24)}", "".join(rng.choice(list("0123456789abcdef"), 40)), f"{n(2)} %", f"({n(2)})", f"{pick(*words)} at {pick(*words)} the dot {pick(*words)}",
        f"@{pick(*words)}", f"{pick(*words)} @ {n(2)}", f"{pick(*words)}.{pick(*words)}", f"{n(4)} - {n(4)}", f"+{n(2)} %", f"{n(3)} + {n(2)}", f"www.{pick(*words)}.com", f"{n(1)}.{n(1)}.{n(2)}.{rng.integers(300, 999)}", f"{n(4)}-{n(4)}",
    )


def labelled(sample: list[tuple[str, str, str, int]], seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Training windows from base spans in their surroundings (before, span, after, kind)."""
    rng = np.random.default_rng(seed)
    words = sorted({w for before, _, after, _ in sample for w in re.findall(r"[^\W\d_]{2,12}", before + after)})[:5000] or ["a"]
    out = []
    for before, value, after, kind in sample:
        out.append((before + value + after, [(len(before), len(before) + len(value), kind)]))
        for other in rng.integers(0, len(KINDS), 2).tolist():
            value = respelled(other, value if other == 0 and kind == 0 else "x@y", rng, words)
            out.append((before + value + after, [(len(before), len(before) + len(value), other)]))
        out.append((before + harmless(rng, words) + after, []))
        out.append((after + before, []))
    return out


def sample_spans(docs: DataFrame, text_col: str, max_docs: int, max_windows: int) -> list[tuple[str, str, str, int]]:
    """Base spans with 100 characters on both sides, of about ``max_docs`` documents chosen by a hash of their text."""
    total = docs.count()
    if not total:
        return []
    hashed = F.xxhash64(F.col(text_col))
    chosen = docs.where(F.pmod(hashed, F.lit(1 << 30)) < int(min(1.0, max_docs / total) * (1 << 30))).select(hashed.alias("h"), F.col(text_col).cast("string").alias("text"))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h, text in zip(b["h"], b["text"]):
                found = base_spans(text)
                for i, (x, y, kind) in enumerate(found):
                    near = [s for s in found[max(0, i - 3) : i] + found[i + 1 : i + 4] if s[1] > x - 100 and s[0] < y + 100]
                    low, high = max([x - 100, 0, *(s[1] for s in near if s[1] <= x)]), min([y + 100, *(s[0] for s in near if s[0] >= y)])
                    if y - x <= 80 and not any(s[0] < y and s[1] > x for s in near):
                        rows.append((h, i, text[low:x], text[x:y], text[y:high], kind))
            out = pd.DataFrame(rows, columns=["h", "i", "before", "value", "after", "kind"])
            yield out.astype({c: object for c in ("before", "value", "after")})

    rows = chosen.mapInPandas(spans, "h long, i int, before string, value string, after string, kind int")
    picked = rows.orderBy(F.xxhash64("h", "i"), "h", "i").limit(max_windows).collect()  # at most max_windows short rows
    return [(r["before"], r["value"], r["after"], r["kind"]) for r in picked]


def fit(docs: DataFrame, text_col: str = "text", max_docs: int = 20_000, max_windows: int = 2_000, hidden: int = 12, steps: int = 900) -> Network | None:
    """Train on a bounded sample; None if it holds no labelled span."""
    sample = sample_spans(docs, text_col, max_docs, max_windows)
    return train(labelled(sample), hidden, steps) if sample else None


# -- spans of texts -------------------------------------------------------------------------------------------------
_AT = re.compile(r"@|\bat\b", re.IGNORECASE)
_DOT = re.compile(r"\.|\bdot\b", re.IGNORECASE)


def reads_as(kind: int, value: str) -> bool:
    """Whether a span of the network keeps its kind's rule."""
    if kind == 0:
        halves = _AT.split(value)
        parts = [re.sub(r"^[\s()\[\]]+|[\s()\[\]]+$", "", p) for p in _DOT.split(halves[-1])]
        user = re.sub(r"^[\s()\[\]]+|[\s()\[\]]+$", "", halves[0])
        return len(halves) == 2 and len(parts) >= 2 and bool(re.fullmatch(r"[\w.%+-]+", user)) and all(re.fullmatch(r"[\w-]+", p) for p in parts) and len(parts[-1]) >= 2 and parts[-1].isalpha()
    digits = re.sub(r"[^0-9]", "", value)
    if kind == 1:
        parts = re.findall(r"[0-9]+", value)
        return bool(re.fullmatch(r"[0-9\s.()\[\]]+", value)) and len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9]([0-9 ./-]*[0-9])", value)) and 12 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"[+(]?[0-9][0-9 ()./-]*[0-9]", value)) and 9 <= len(digits) <= 15 and len(value) > len(digits) and (value[0] in "+(0" or len(re.findall(r"[ ()./-]+", value)) >= 2)


def named(span: Span, text: str) -> Span | None:
    """The span under the kind whose rule it keeps: the network's own, or for numbers another one; None if there is none."""
    start, end, kind = span
    kinds = (kind,) if kind == 0 else (kind, *(k for k in (1, 2, 3) if k != kind))
    return next(((start, end, k) for k in kinds if reads_as(k, text[start:end])), None)


_FIGURES = re.compile(r"[0-9](?:[\s.()\[\]/+-]*+[0-9])*+")
_BETWEEN = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + ".()[]/+-"  # what may stand between and around figures
_BESIDE = re.compile(r"[\s.()\[\]/+-]*")
_USER = re.compile(r"[\s()\[\]]*[\w.%+-]*[\s()\[\]]*")
_TO_DOT = re.compile(r"[\s()\[\]]*[\w-]+[\s()\[\]]*(?:\.|\bdot\b)", re.IGNORECASE)
_HOSTS = re.compile(r"[\w\s().\[\]-]*")


def places(text: str) -> list[tuple[int, int]]:
    """Stretches such that every span that ``reads_as`` some kind lies inside one of them.

    Numbers: figures with nothing but separators between them, at least nine or in at least four groups. Addresses: a name before and words
    after each "@" or "at", if a dot follows the first word and no other "at" comes before it. Linear in the text.
    """
    found, before = [], 0
    for m in _FIGURES.finditer(text):
        start, end = m.span()
        if end - start >= 7 and (sum(map(len, parts := re.findall("[0-9]+", m[0]))) >= 9 or len(parts) >= 4):
            found.append((before + len(text[before:start].rstrip(_BETWEEN)), _BESIDE.match(text, end).end()))
        before = end
    signs = [m.span() for m in _AT.finditer(text)]
    for i, (start, end) in enumerate(signs):
        low, high = signs[i - 1][1] - 1 if i else 0, signs[i + 1][0] + 1 if i + 1 < len(signs) else len(text)
        if _TO_DOT.match(text, end, high):
            reach = _USER.match(text[low:start][::-1]).end()
            found.append((start - reach, _HOSTS.match(text, end, high).end()))
    return found


Candidate = tuple[int, int, int, float, bool, bool]  # start, end, kind, weight, cut off at the left, at the right


def reconcile(found: list[Candidate]) -> list[Span]:
    """Spans of one text from those of its windows: cut parts joined, then the set of disjoint spans with the greatest weight."""
    joined: list[Candidate] = []
    for s in sorted(found):
        last = joined[-1] if joined else None
        if last and last[2] == s[2] and s[0] <= last[1] and (last[5] or s[4]):
            joined[-1] = (last[0], max(last[1], s[1]), s[2], max(last[3], s[3]), last[4], s[5] if s[1] >= last[1] else last[5])
        else:
            joined.append(s)
    spans = sorted({(s[1], s[0], s[2]): s[3] for s in sorted(joined, key=lambda s: s[3])}.items())
    ends = [k[0] for k, _ in spans]
    best: list[tuple[float, int]] = [(0.0, 0)]
    for i, ((_, start, _), w) in enumerate(spans):
        j = int(np.searchsorted(ends[:i], start, side="right"))
        best.append(max((best[i][0], -1), (best[j][0] + w, j), key=lambda b: b[0]))
    out, i = [], len(spans)
    while i > 0:
        if best[i][1] < 0:
            i -= 1
        else:
            (end, start, kind), _ = spans[i - 1]
            out.append((start, end, kind))
            i = best[i][1]
    return out[::-1]


class Finder:
    """Spans of texts: windows of many texts go through the network together."""

    def __init__(self, net: Network | None, block: int = 1024) -> None:
        self.net, self.block = net, block

    def windows(self, size: int) -> int:
        """How many windows a text has; each starts ``STRIDE`` after the one before."""
        return 1 + max(0, -(-(size - WINDOW) // STRIDE))

    def asked(self, text: str, size: int) -> set[int]:
        """Windows with a place where a span could read as its kind."""
        last = self.windows(size) - 1
        return {k for a, b in places(text) for k in range(max(0, (a - WINDOW) // STRIDE + 1), min((b - 1) // STRIDE, last) + 1)}

    def candidates(self, waiting: list[tuple[int, int, np.ndarray, int]], length: int, into: dict[int, list[Candidate]]) -> None:
        """Decode windows (text, start, symbols, size of the text) of one length."""
        batch = np.full((len(waiting), length), _PAD, np.uint8)
        for j, (_, _, part, _) in enumerate(waiting):
            batch[j, : len(part)] = part
        score = self.net.emissions(batch)
        tags, step = self.net.decode(score), self.net.trans - self.net.trans[0, 0]
        for j in np.flatnonzero(tags.any(axis=0)):
            doc, at, part, size = waiting[j]
            row = tags[: len(part), j]
            edge = np.flatnonzero(np.diff(row > 0, prepend=False, append=False))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # tags that follow each other without a gap are one span of the kind with most weight
                worth = (score[a:b, 1:, j] - score[a:b, :1, j]).sum(axis=0)
                kind = int(worth.argmax()) if len(set(row[a:b].tolist())) > 1 else int(row[a]) - 1
                path = np.concatenate([[0] * (a > 0), row[a:b], [0] * (b < len(row))]).astype(np.intp)
                gain = float((score[np.arange(a, b), row[a:b], j] - score[a:b, 0, j]).sum() + (step[path[:-1], path[1:]]).sum())  # over leaving it outside
                into.setdefault(doc, []).append((at + a, at + b, kind, max(gain, 1e-6), a == 0 and at > 0, b == len(part) and at + b < size))

    @staticmethod
    def touched(found: dict[int, list[Candidate]], docs: set[int]) -> dict[int, set[int]]:
        """Windows that hold or touch a candidate found in a neighbour, by text."""
        return {i: {k for a, b, *_ in found[i] for k in range(max(0, -((WINDOW - a) // STRIDE)), b // STRIDE + 1)} for i in docs if i in found}

    def added(self, texts: list[str | None]) -> list[list[Span]]:
        """What the network finds in each text."""
        found: dict[int, list[Candidate]] = {}
        if self.net is not None:
            symbols: dict[int, np.ndarray] = {}
            read: dict[int, set[int]] = {}
            wanted = [(i, k) for i, text in enumerate(texts) if text for k in sorted(self.asked(text, len(text)))]
            while wanted:
                waiting: dict[int, list] = {}
                for i, k in wanted:
                    if i not in symbols:
                        symbols[i] = codes(texts[i])
                    read.setdefault(i, set()).add(k)
                    at, size = k * STRIDE, len(symbols[i])
                    length = min(WINDOW, -(-(size - at) // STEP) * STEP)
                    rows = waiting.setdefault(length, [])
                    rows.append((i, at, symbols[i][at : at + WINDOW], size))
                    if len(rows) == self.block:
                        self.candidates(rows, length, found)
                        rows.clear()
                for length, rows in waiting.items():
                    if rows:
                        self.candidates(rows, length, found)
                wanted = sorted((i, k) for i, more in self.touched(found, {i for i, _ in wanted}).items() for k in more if k not in read[i] and k < self.windows(len(symbols[i])))
        return [[s for f in reconcile(found[i]) if (s := named(f, texts[i]))] if i in found else [] for i in range(len(texts))]

    def find(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """Base spans and all spans of each text; those of the network give way to base spans they touch."""
        out = []
        for text, more in zip(texts, self.added(texts)):
            base = base_spans(text)
            more = [s for s in more if not any(s[0] < b[1] and b[0] < s[1] for b in base)]
            out.append((base, sorted(base + more, key=lambda s: (s[0], s[2]))))
        return out


def find(docs: DataFrame, net: Network | None, text_col: str = "text", out: tuple[str, str] = ("base_spans", "all_spans")) -> DataFrame:
    """``docs`` with base and all spans as arrays of (kind, start, end) under the names ``out``. The network's few thousand weights are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = "array<struct<kind:string,start:int,end:int>>"

    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Finder(shared.value)
        shown = lambda found: [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in found]
        for texts in batches:
            rows = finder.find(texts.tolist())
            yield pd.DataFrame({"b": pd.Series([shown(b) for b, _ in rows], dtype=object), "a": pd.Series([shown(a) for _, a in rows], dtype=object)})

    udf = F.pandas_udf(spans, f"b {kind}, a {kind}")
    free = "_spans"
    while free in docs.columns:
        free += "_"
    return docs.withColumn(free, udf(F.col(text_col).cast("string"))).withColumns({out[0]: F.col(free)["b"], out[1]: F.col(free)["a"]}).drop(free)
