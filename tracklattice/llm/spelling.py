"""Misspelt words set right by the frequent words of the corpus, and near-equal strings found by shared segments."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklattice.llm.filters import filter_of
from tracklattice.llm.text import typo_distance

#: a word is taken for a misspelling of one that is so many times as frequent
RATIO = 8
MOST_EDITS = 2
#: corrections up to which they are sent to the tasks
SMALL_FIXES = 200_000


def _deletions(word: str) -> list[str]:
    """The word and what is left of it after one deletion, or two from six letters on."""
    deep = 0 if len(word) < 4 else 1 if len(word) < 6 else 2
    out = {word}
    for n in range(1, deep + 1):
        for at in combinations(range(len(word)), n):
            out.add("".join(c for i, c in enumerate(word) if i not in at))
    return list(out)


def corrections(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Rows (word, right) for the words of counts (word, n) that are misspellings of a much more frequent word.

    Words of under four letters and words with digits are left alone. Pairs meet in the inverted index of their deletions; the
    nearest word counts, then the most frequent. Nothing is sent to the driver or broadcast by hand.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, w, n) for w, n in zip(pdf["word"], pdf["n"]) for d in _deletions(w)]
            yield pd.DataFrame(out, columns=["part", "word", "n"])

    words = counts.where((F.length("word") >= 4) & (F.length("word") <= 30) & ~F.col("word").rlike("[0-9]"))
    parts = words.select("word", "n").mapInPandas(run, "part string, word string, n long")
    often = parts.where(F.col("n") >= ratio).select("part", F.col("word").alias("right"), F.col("n").alias("m"))
    pairs = parts.join(often, "part").where((F.col("m") >= F.col("n") * ratio) & (F.col("word") != F.col("right"))).select("word", "right", "m").distinct()
    near = pairs.withColumn("edits", F.levenshtein("word", "right", 3)).where(F.col("edits").between(1, 3))
    near = near.mapInPandas(_exact_edits, "word string, right string, m long, edits int").where(F.col("edits") <= F.when(F.length("word") < 6, 1).otherwise(MOST_EDITS))
    w = Window.partitionBy("word").orderBy("edits", F.desc("m"), "right")
    return near.withColumn("place", F.row_number().over(w)).where("place = 1").select("word", "right")


def _exact_edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["edits"] = [typo_distance(a, b, MOST_EDITS) for a, b in zip(pdf["word"], pdf["right"])]
        yield pdf


def corrected(rows: DataFrame, fields: list[str], fixes: DataFrame, key: str) -> DataFrame:
    """rows with the words of the array columns `fields` (not null) set right, in place; other columns stay.

    Up to SMALL_FIXES corrections go to the tasks as they are, and nothing is shuffled; beyond that words meet them in a join and return by `key`, which
    must be unique.
    """
    if fixes.count() <= SMALL_FIXES:
        known = fixes.toPandas()
        sent = rows.sparkSession.sparkContext.broadcast((known["word"].tolist(), known["right"].tolist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, rights = (pa.array(x, pa.string()) for x in sent.value)
            for batch in batches:
                columns = []
                for name, column in zip(batch.schema.names, batch.columns):
                    if name in fields:
                        flat = column.flatten()
                        at = pc.index_in(flat, words)
                        offsets = np.zeros(len(column) + 1, np.int32)
                        np.cumsum(np.asarray(column.value_lengths().fill_null(0)), out=offsets[1:])
                        column = pa.ListArray.from_arrays(pa.array(offsets), pc.if_else(pc.is_valid(at), rights.take(at), flat))
                    columns.append(column)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return rows.mapInArrow(run, rows.schema)
    out = rows
    for f in fields:
        each = rows.select(key, F.posexplode(f).alias("pos", "word")).join(fixes, "word", "left").select(key, F.struct("pos", F.coalesce("right", "word").alias("w")).alias("x"))
        fixed = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]).alias("__right"))
        out = out.join(fixed, key, "left").withColumn(f, F.coalesce("__right", f)).drop("__right")
    return out


def _segments(length: int, parts: int) -> list[tuple[int, int]]:
    base, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (i >= parts - more)
        out.append((at, size))
        at += size
    return out


_BASE = 0x5851F42D4C957F2D


@lru_cache(maxsize=4096)
def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def shifted(parts: int, chosen: tuple[int, ...], edits: int, longer: int | None = None) -> list[tuple[int, ...]]:
    """Shifts that the chosen segments of a string may show in one at most `edits` errors away: each step between them costs an error, and so do those
    on to the shift of the end where it is known by how much the other string is longer."""
    out: list[tuple[int, ...]] = [(s,) for s in range(-edits, edits + 1)]
    for _ in chosen[1:]:
        out = [(*o, t) for o in out for t in range(-edits, edits + 1) if abs(o[0]) + sum(abs(b - a) for a, b in zip(o, o[1:])) + abs(t - o[-1]) <= edits]
    return out if longer is None else [o for o in out if abs(o[0]) + sum(abs(b - a) for a, b in zip(o, o[1:])) + abs(longer - o[-1]) <= edits]


def near_equal(strings: DataFrame, edits: int = MOST_EDITS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct strings of column s that differ by 1 to `edits` typing errors.

    strings: (s STRING) or (s STRING, probe BOOLEAN); with probe, pairs without a marked string are not looked for. Without it all strings are looked up, each
    among those that are no longer. Of 2 * edits + 1 segments of a string, edits + 1 stay
    whole in any string that near, shifted by no more than the errors before them (two letters swapped across the border of segments break both). Pairs meet in an inverted index of all choices of
    edits + 1 segments, which cover more than half of a string: a beginning that a third of all strings share brings no pairs
    together. Strings of up to 3 * edits + 2 letters are left out. Two strings whose digits differ are no pair.
    """
    parts, whole = 2 * edits + 1, edits + 1
    choices = list(combinations(range(parts), whole))
    marked = "probe" in strings.columns
    cuts: dict[int, list[tuple[int, int]]] = {}
    moves = {(c, more): shifted(parts, c, edits, more) for c in choices for more in range(-edits, edits + 1)}

    def codes(texts: list[str], length: int, c: tuple[int, ...], shifts: tuple[int, ...], prefix: np.ndarray) -> np.ndarray | None:
        """Codes of the chosen segments of a string of `length`, shifted; None where a segment would not lie in the texts."""
        cut = cuts[length] if length in cuts else cuts.setdefault(length, _segments(length, parts))
        h = np.full(len(texts), (length * 131 + sum(1 << i for i in c)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
        for i, d in zip(c, shifts):
            begin, end = cut[i][0] + d, cut[i][0] + d + cut[i][1]
            if begin < 0 or end >= prefix.shape[1]:
                return None
            part = prefix[:, end] - prefix[:, begin] * _power(end - begin)
            h = (h ^ part ^ (part >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return h

    def by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, list[str], np.ndarray]]:
        """(length, ids, strings, hashes of all beginnings) of the strings of each length."""
        sizes = pdf["s"].str.len().to_numpy()
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            texts = pdf["s"].iloc[at].tolist()
            signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(texts), n).astype(np.uint64)
            prefix = np.zeros((len(texts), n + 1), dtype=np.uint64)
            for i in range(n):
                prefix[:, i + 1] = prefix[:, i] * np.uint64(_BASE) + signs[:, i] + np.uint64(1)
            yield n, pdf["id"].to_numpy()[at], texts, prefix

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, ids, texts, prefix in by_length(pdf):
                with np.errstate(over="ignore"):
                    out = [codes(texts, n, c, (0,) * whole, prefix) for c in choices]
                yield pd.DataFrame({"code": np.concatenate(out).view(np.int64), "b": np.tile(ids, len(out))})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, ids, texts, prefix in by_length(pdf):
                out = []
                with np.errstate(over="ignore"):
                    for length in range(n - edits, n + (edits if marked else 0) + 1):
                        out += [h for c in choices for m in moves[c, n - length] if (h := codes(texts, length, c, m, prefix)) is not None]
                code, owner = np.concatenate(out), np.tile(ids, len(out))
                may = bits.value.holds(code)
                yield pd.DataFrame({"code": code[may].view(np.int64), "a": owner[may]})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [1 <= typo_distance(a, b, edits) <= edits for a, b in zip(pdf["a"], pdf["b"])]
            yield pdf[ok]

    long = strings.where((F.length("s") > 3 * edits + 2)).withColumn("id", F.xxhash64("s"))
    long = long.repartition(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but many codes to make
    right = long.select("id", "s").mapInPandas(index, "code long, b long")
    bits = strings.sparkSession.sparkContext.broadcast(filter_of(right.select(F.col("code").alias("key"))))  # codes that no string has are not shuffled
    left = (long.where("probe") if marked else long).select("id", "s").mapInPandas(probe, "code long, a long")
    met = left.join(right, "code").where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    met = met.join(long.select(F.col("id").alias("x"), F.col("s").alias("a")), "x").join(long.select(F.col("id").alias("y"), F.col("s").alias("b")), "y")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = met.where(F.regexp_replace("a", "[^0-9]", "") == F.regexp_replace("b", "[^0-9]", "")).where(F.levenshtein("a", "b", 2 * edits) >= 0)
    return met.mapInPandas(verify, "a string, b string")
