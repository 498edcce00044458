"""Document fingerprints of closed syncmers.

A k-mer of characters is a closed syncmer when the smallest of its s-mers is its first or its last one. Whether it is chosen
depends on nothing around it, so an edit changes only the anchors it touches, and anchors of a kept part stay, at their distance
from each other. A fingerprint holds every anchor whose own hash falls into a fixed share of all hashes, each with its position, in
order of position: it grows with the text, and no other anchor has a say in it. Two fingerprints are as alike as the longest run of
common anchors in the same order is long, against all anchors of both.

Defined cases: a null text is the empty one; the empty text has the empty fingerprint, alike 1 to itself and 0 to any
other; a text shorter than k has one anchor of all its characters, a text none of whose anchors falls into the share keeps the one of smallest hash; rows with equal ids follow each other in order of text,
a missing id comes first; a single row is its own successor; repeated rows are rows of their own; an empty table gives an
empty result; extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.hashing import mix, rolling

K, S = 16, 6
#: One of so many anchors is kept, by its own hash.
SHARE = 8


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def syncmers(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of the closed syncmers."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    small = rolling(codes, s)
    w = k - s + 1
    edge = np.minimum(small[:n], small[w - 1 : w - 1 + n])
    least = edge.copy()
    for i in range(1, w - 1):
        np.minimum(least, small[i : i + n], out=least)
    at = np.flatnonzero(edge == least)
    with np.errstate(over="ignore"):
        whole = small[at].copy()
        for i in [*range(s, k - s, s), k - s]:
            whole = whole * np.uint64(0x9E3779B97F4A7C15) + small[at + i]
        return mix(whole) >> np.uint64(32), at


def choose(hashes: np.ndarray, at: np.ndarray, codes: np.ndarray, share: int = SHARE) -> dict[int, int]:
    """hash -> first position of the anchors kept."""
    if not len(hashes):
        if not len(codes):
            return {}
        return {int(rolling(codes, len(codes))[0] >> np.uint64(32)): 0}
    kept = np.flatnonzero(hashes < np.uint64((1 << 32) // share))
    if not len(kept):
        kept = np.flatnonzero(hashes == hashes.min())
    h, p = hashes[kept], at[kept]
    return dict(zip(h[::-1].tolist(), p[::-1].tolist()))  # positions rise: of equal hashes the first one stays


def write(chosen: dict[int, int]) -> str:
    return " ".join(f"{h:08x}@{p}" for h, p in sorted(chosen.items(), key=lambda x: (x[1], x[0])))


def read(fingerprint: str) -> dict[int, int]:
    return {int(x[:8], 16): int(x[9:]) for x in fingerprint.split()}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Length of the longest common run of anchors in order, against all anchors of both."""
    if not a or not b:
        return float(a == b)
    shared = sorted((a[h], b[h]) for h in a.keys() & b.keys())
    tails: list[int] = []
    for _, p in shared:
        i = bisect_left(tails, p)
        tails[i : i + 1] = [p]
    return len(tails) / (len(a) + len(b) - len(shared))


def fingerprint(text: str | None, k: int = K, s: int = S, share: int = SHARE) -> str:
    codes = codes_of(text or "")
    return write(choose(*syncmers(codes, k, s), codes, share))


class Print:
    """A text with its syncmers and its fingerprint."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.codes = codes_of(self.text)
        self.hashes, self.at = syncmers(self.codes)
        self.chosen = choose(self.hashes, self.at, self.codes)

    def edited(self, head: str) -> tuple[str, dict[int, int]]:
        """The text with its last quarter replaced by ``head`` cut to that length. Syncmers of the kept part stay as they are."""
        n = len(self.text)
        q = n // 4
        text = self.text[: n - q] + head[:q]
        keep = self.at + K <= n - q
        begin = max(0, n - q - K + 1)
        tail = codes_of(text[begin:])
        h, p = syncmers(tail)
        codes = np.concatenate([self.codes[:begin], tail])
        return text, choose(np.concatenate([self.hashes[keep], h]), np.concatenate([self.at[keep], p + begin]), codes)


LOWEST = -(2**63)


def with_successors(docs: DataFrame, ranges: int) -> DataFrame:
    """(span, doc_id, text, extra): ranges of neighbouring ids, each closed by an extra row, the first one of the next range.

    The ids alone are looked at first; quantiles of them and one first id per range reach the driver, as many as ``ranges``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("nid", F.coalesce("doc_id", F.lit(LOWEST)))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("nid"))
    cuts = np.unique(np.array(ids.approxQuantile("nid", [i / ranges for i in range(1, ranges)], 0.1 / ranges), dtype=np.float64).astype(np.int64)) if ranges > 1 else np.array([], dtype=np.int64)

    @F.pandas_udf("int")
    def span_of(nid: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, nid.to_numpy(dtype=np.int64), side="right").astype("int32"))

    firsts = ids.withColumn("span", span_of("nid")).groupBy("span").agg(F.min("nid").alias("nid")).orderBy("span").collect()
    before = {b["nid"]: a["span"] for a, b in zip([firsts[-1], *firsts[:-1]], firsts)} if firsts else {}
    wanted = F.coalesce(F.element_at(F.create_map(*[x for k, v in before.items() for x in (F.lit(k), F.lit(v))]), F.col("nid")), F.lit(0)) if before else F.lit(0)
    heads = rows.where(F.col("nid").isin(list(before)) if LOWEST not in before else F.col("nid").isin([k for k in before if k != LOWEST]) | F.col("doc_id").isNull())
    heads = heads.groupBy("nid").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text")).select(wanted.alias("span"), "doc_id", "text", "nid", F.lit(True).alias("extra"))
    return rows.select(span_of("nid").alias("span"), "doc_id", "text", "nid", F.lit(False).alias("extra")).unionByName(heads).repartition(ranges, "span").sortWithinPartitions("span", "extra", "nid", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``SCHEMA``: each document, its edited text (last quarter replaced by the head of the next document) and the likeness to both."""
    if ranges is None:
        ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row before: span, id, print
        for b in batches:
            out = []
            for span, doc_id, text, extra in zip(b["span"], b["doc_id"], b["text"], b["extra"]):
                now = Print(text)
                if held is not None and held[0] == span:
                    p = held[2]
                    edited, chosen = p.edited(now.text)
                    out.append((held[1], len(p.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), write(p.chosen), write(chosen), likeness(p.chosen, chosen), likeness(p.chosen, now.chosen)))
                held = None if extra else (span, None if pd.isna(doc_id) else int(doc_id), now)
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    return with_successors(docs, ranges).drop("nid").mapInPandas(run, SCHEMA)
