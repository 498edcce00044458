"""Vectorised 64-bit hashes of word windows, and a small bitmap that filters rows before a join."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)


#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return, space.
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.array([xxhash.xxh3_64_intdigest(bytes([i])) for i in range(256)], dtype=np.uint64)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest text needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 4096)
            steps = np.full(size, _BASE, dtype=np.uint64), np.full(size, _UNBASE, dtype=np.uint64)
            for step in steps:
                step[0] = 1
            self.up, self.down = (np.multiply.accumulate(step) for step in steps)


def word_hashes(raw: bytes, powers: Powers) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space: the word's part of a running polynomial, shifted to its start.

    They are mixed with the word's length, since ``rolling`` combines them by powers of the same base: characters of neighbouring words must not be exchangeable."""
    codes = np.frombuffer(raw, dtype=np.uint8)
    gap = np.concatenate([[True], _GAP[codes], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    powers.grow(len(codes) + 1)
    run = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[codes] * powers.up[: len(codes)], out=run[1:])
    return mix((run[ends] - run[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64) * _LENGTH)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` neighbours, in order; none when there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = hashes[:n].copy()
    for i in range(1, width):
        acc *= _BASE
        acc += hashes[i : i + n]
    acc += np.uint64(width)
    return mix(acc)


def bitmap(df: DataFrame, col: str, bits: int = 20) -> np.ndarray:
    """A bitmap of 2^bits places with the low bits of the 64-bit values of ``col``: one 64-bit word per 64 places reaches the driver.

    It only thins out rows before an exact join. However many values there are, its size stays the same; a full one thins out nothing.
    """
    place = F.col(col).bitwiseAND((1 << bits) - 1)
    words = df.select(F.shiftright(place, 6).cast("int").alias("w"), place.bitwiseAND(63).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("set")).toArrow()
    held = np.zeros(1 << (bits - 6), dtype=np.uint64)
    held[words["w"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return held


def in_bitmap(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values & np.uint64(64 * len(held) - 1)
    return (held[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
