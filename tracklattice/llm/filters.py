"""Sets of 64-bit keys of bounded size, which thin out one side of a hash join before it is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: bits of a filter at most (16 MB); beyond so many a larger key set lets more rows through, and none is lost
MOST_BITS = 1 << 27
PARTS = 4
#: bytes of a filter that travel in one row
SLICE = 1 << 16


class Bits:
    """Set of 64-bit keys that lets a few others through as well; of bounded size."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(len(bits) * 8 - 1)

    @classmethod
    def empty(cls, keys: int) -> Bits:
        return cls(np.zeros(min(MOST_BITS, max(1 << 16, 1 << (48 * keys).bit_length())) // 8, np.uint8))

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return keys & self.mask, (keys >> np.uint64(33)) & self.mask

    def add(self, keys: np.ndarray) -> None:
        for h in self._at(keys):
            np.bitwise_or.at(self.bits, (h >> np.uint64(3)).astype(np.int64), (1 << (h & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        a, b = self._at(keys)
        ok = (self.bits[(a >> np.uint64(3)).astype(np.int64)] >> (a & np.uint64(7)).astype(np.uint8)) & 1 == 1
        at = np.flatnonzero(ok)
        ok[at] = (self.bits[(b[at] >> np.uint64(3)).astype(np.int64)] >> (b[at] & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def filter_of(keys: DataFrame) -> Bits:
    """The filter of the column key. PARTS tasks make one set of its size each, which are joined slice by slice before one set comes to the driver, a few slices
    at a time; so many keys that the filter would hold back little make one that lets all through."""
    n = keys.count()
    if n > MOST_BITS // 4:
        return Bits(np.full(1 << 13, 255, np.uint8))
    size = len(Bits.empty(n).bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = Bits(np.zeros(size, np.uint8))
        for pdf in batches:
            bits.add(pdf["key"].to_numpy().view(np.uint64))
        for at in range(0, size, SLICE):
            part = bits.bits[at : at + SLICE]
            if part.any():
                yield pd.DataFrame({"at": [at], "bits": [part.tobytes()]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "bits": [part.tobytes()]})

    out = Bits(np.zeros(size, np.uint8))
    slices = keys.select("key").coalesce(PARTS).mapInPandas(run, "at long, bits binary").groupBy("at").applyInPandas(joined, "at long, bits binary")
    for r in slices.toLocalIterator():
        out.bits[r["at"] : r["at"] + SLICE] = np.frombuffer(r["bits"], np.uint8)
    return out
