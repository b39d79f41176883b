"""Encoding of a text column with a byte-level BPE vocabulary by forced boundaries.

A merge can only join bytes that end up inside one vocabulary token. A pair of adjacent bytes that occurs inside no token is
therefore a certain cut: no token of the result spans it, whatever stands on either side. The text is cut there first; each
fragment is encoded on its own (and only once for all its occurrences in a task) and the ids are concatenated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracklattice.session import env_path

VOCABULARY = env_path("TRACKLATTICE_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# fixed value: the published split pattern of the rank files
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: distinct fragments remembered by a task; the table is emptied when full, which changes speed only
FRAGMENT_CACHE = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def joinable_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256 truth table: may these two bytes stand next to each other inside one token?"""
    seen = np.zeros((256, 256), dtype=bool)
    blob = np.frombuffer(b"".join(ranks), dtype=np.uint8)
    last = np.zeros(len(blob), dtype=bool)
    last[np.cumsum([len(t) for t in ranks]) - 1] = True
    inner = ~last[:-1]
    seen[blob[:-1][inner], blob[1:][inner]] = True
    return seen


class ForcedBoundaryEncoder:
    """Encodes texts by fragments between certain cuts; equal to encoding the whole text.

    A cut between code points x and y is taken only where the split pattern cannot look across it either: x is not white space
    (a run of it is read with look-ahead) and y is not an apostrophe (which may open a contraction).
    """

    def __init__(self, path: str = VOCABULARY, pattern: str = SPLIT_PATTERN):
        import tiktoken

        ranks = read_ranks(path)
        self.pairs = joinable_pairs(ranks)
        # a cut after ASCII white space or any byte that may end wider white space is not used
        self.pairs[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
        self.pairs[:, 0x27] = True
        self.pairs[:, 0x80:0xC0] = True  # never inside a code point
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, list[int]] = {}

    def cuts(self, raw: bytes) -> np.ndarray:
        """Byte offsets of the certain cuts of a UTF-8 text."""
        b = np.frombuffer(raw, dtype=np.uint8)
        if len(b) < 2:
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(~self.pairs[b[:-1], b[1:]]) + 1
        wide = at[b[at - 1] >= 0x80]
        if len(wide):  # white space outside ASCII before the cut: U+0085, U+00A0, U+1680, U+2000-200A, 2028, 2029, 202F, 205F, 3000
            tail = np.stack([b[np.maximum(wide - k, 0)] for k in (3, 2, 1)], axis=1)
            two = (tail[:, 1] == 0xC2) & np.isin(tail[:, 2], (0x85, 0xA0))
            three = np.isin(tail[:, 0], (0xE1, 0xE2, 0xE3)) & np.isin(tail[:, 1], (0x9A, 0x80, 0x81))
            at = np.setdiff1d(at, wide[two | three], assume_unique=True)
        return at

    def encode(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "replace")
        ids: list[int] = []
        known, begin = self.known, 0
        for end in [*self.cuts(raw).tolist(), len(raw)]:
            part = raw[begin:end]
            begin = end
            got = known.get(part)
            if got is None:
                got = self.encoding.encode_ordinary(part.decode("utf-8", "replace"))
                if len(known) >= FRAGMENT_CACHE:
                    known.clear()
                if len(part) <= 64:
                    known[part] = got
            ids += got
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row (id_col, ids ARRAY<INT>) per input row, without special tokens.

    Null and empty texts give an empty list, white space its own ids; repeated rows stay repeated; other columns are not read.
    A narrow map: no shuffle, and only the two columns reach the scan. Code points that are no valid UTF-8 become "?".
    """
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                lists = [enc.encode(t) if t else [] for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = pa.array([i for x in lists for i in x], type=pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, out)
