"""Words of many texts as 64-bit hashes, vectorised over their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Texts are taken together up to this many bytes (a longer text alone).
BLOCK = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.Generator(np.random.PCG64(20_240_229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_BIT = np.left_shift(1, np.arange(8)).astype(np.uint8)


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, 1), base, np.uint64)
        out[0] = 1
        _powers.clear() if n > 4 * BLOCK else None
        _powers[base] = np.cumprod(out, dtype=np.uint64)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    texts: range  # of the texts given
    hashes: np.ndarray  # uint64, of each word
    edges: np.ndarray  # text i has words edges[i] : edges[i + 1]
    data: np.ndarray  # the lower-case bytes
    starts: np.ndarray  # of each word in data
    ends: np.ndarray


def words(texts: list[bytes], block: int = BLOCK) -> Iterator[Words]:
    """Lower-case (A-Z) words of the texts, in blocks of so many bytes (about 50 times as many are held meanwhile)."""
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) < block):
            size += len(texts[high]) + 1
            high += 1
        yield _block(texts[low:high], range(low, high))
        low = high


def _block(texts: list[bytes], at: range) -> Words:
    data = _LOWER[np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)]  # a gap before, between and after
    space = _SPACE[data]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = turn[0::2], turn[1::2]
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * _power(_BASE, len(data)), out=total[1:])
        hashes = mixed((total[ends] - total[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    firsts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return Words(at, hashes, np.searchsorted(starts, firsts), data, starts, ends)


class KeySet:
    """Membership of hashes; of more than ``most``, a Bloom filter (never a false no) of about 16 bits a key, at most ``bits`` in all.

    Either way what is broadcast has a fixed bound.
    """

    MOST, BITS, LEAST_BITS = 100_000, 1 << 27, 1 << 20

    def __init__(self, keys: DataFrame, most: int = MOST, bits: int = BITS) -> None:
        n = keys.count()
        self.exact, self.bits, self.empty = None, None, n == 0
        if n <= most:
            self.exact = np.sort(keys.toPandas().iloc[:, 0].to_numpy("int64"))
            return
        size = min(bits, max(self.LEAST_BITS, 1 << (16 * n - 1).bit_length()))

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Of one task's keys the bytes of the filter that have a bit, by stretches of 64 kB."""
            own = np.zeros(size // 8, np.uint8)
            for b in batches:
                for h in self._places(b.iloc[:, 0].to_numpy("int64"), size):
                    np.bitwise_or.at(own, h >> 3, _BIT[h & 7])
            for k in range(0, len(own), 1 << 16):
                part = own[k : k + (1 << 16)]
                if part.any():
                    yield pd.DataFrame({"at": [k], "bits": [part.tobytes()]})

        def merge(g: pd.DataFrame) -> pd.DataFrame:
            own = np.frombuffer(g["bits"].iloc[0], np.uint8).copy()
            for x in g["bits"].iloc[1:]:
                own |= np.frombuffer(x, np.uint8)
            return pd.DataFrame({"at": [g["at"].iloc[0]], "bits": [own.tobytes()]})

        self.bits = np.zeros(size // 8, np.uint8)
        folded = keys.mapInPandas(fill, "at long, bits binary").groupBy("at").applyInPandas(merge, "at long, bits binary")
        for at, part in folded.toPandas().itertuples(index=False):
            self.bits[at : at + len(part)] = np.frombuffer(part, np.uint8)

    @staticmethod
    def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
        x = h.view(np.uint64)
        return [(mixed(x + np.uint64(i + 1)) % np.uint64(bits)).astype(np.int64) for i in range(4)]

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.exact is not None:
            if not len(self.exact):
                return np.zeros(len(h), bool)
            at = np.minimum(np.searchsorted(self.exact, h), len(self.exact) - 1)
            return self.exact[at] == h
        return np.logical_and.reduce([(self.bits[p >> 3] & _BIT[p & 7]) != 0 for p in self._places(h, 8 * len(self.bits))])
