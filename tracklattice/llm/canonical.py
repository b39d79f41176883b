"""Mapping of freely entered values to a reference list.

Distinct values are folded and looked up in an inverted index of character pairs of the reference names and their aliases: the pairs that any name must share
with the value to reach the threshold give the candidates, exactly. Candidates are scored by cosine weighted with inverse document frequency; the best is
accepted above a threshold and a margin to the next. Accepted names are held against the letters in the end, which also tells names within the margin apart.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from math import ceil, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklattice.llm.text import fold, typo_distance, unleet
from tracklattice.session import materialise

#: weighted cosine from which on an entry may be meant
THRESHOLD = 0.38
#: cosine by which the next entry must stay behind; nearer ones are told apart by the share of letters changed
MARGIN = 0.03
#: cosine that a reading of some of the words needs
PART_COSINE = 0.88
#: share of the letters of a name that may be changed
MAX_CHANGED = 0.4
#: weights of pairs in order, pairs around a letter, pairs in either order and single letters; the latter two stand letters that changed places
PAIR, AROUND, EITHER, LETTER = 1.0, 1.0, 2.0, 2.0
#: values that one task maps
TASK_VALUES = 2_000
#: reference entries in one broadcast index; a longer list is gone through in blocks of so many
REFERENCE_BLOCK = 5_000
#: mapped values up to which the way back to the rows is a broadcast join
SMALL_MAPPING = 100_000
_SEPARATORS = re.compile(r"[^\w&]+|_")


def squash(text: str) -> list[str]:
    """Folded words with digits read as letters; "&" counts as nothing."""
    return [unleet(w) for w in _SEPARATORS.sub(" ", fold(text)).replace("&", " ").split()]


def readings(value: str) -> list[str]:
    """Strings that a value may stand for: all its words, and those without decorations at either end."""
    w = squash(value)
    out = ["".join(w)]
    for a, b in ((1, None), (None, -1), (1, -1), (None, -2), (2, None)):
        part = w[a:b]
        if len(part) >= 1 and len("".join(part)) >= 5:
            out.append("".join(part))
    return list(dict.fromkeys(out))


def spellings(name: str) -> list[str]:
    """Ways a reference name is written: in either order, with a word cut short or without its vowels."""
    w = squash(name)
    out = {"".join(w), "".join(reversed(w))}
    if len(w) > 1:
        for i, x in enumerate(w):
            bare = x[0] + re.sub("[aeiou]", "", x[1:])
            for short in (bare, x[:4], x[:5]):
                v = w[:i] + [short] + w[i + 1 :]
                out |= {"".join(v), "".join(v[-1:] + v[:-1])}
        out.add("".join(x[0] + re.sub("[aeiou]", "", x[1:]) for x in w))
    return sorted(out)


def grams(s: str) -> dict[str, float]:
    out: dict[str, float] = defaultdict(float)
    t = f"^{s}$"
    for x, y in zip(t, t[1:]):
        out[x + y] += PAIR
        out["~" + min(x, y) + max(x, y)] += EITHER
    for x, y in zip(t, t[2:]):
        out[x + "_" + y] += AROUND
    for x in s:
        out[x] += LETTER
    return out


class NameIndex:
    """Inverted index of character pairs over all spellings of the entries."""

    def __init__(self, entries: list[tuple[int, str, list[str]]]):
        owner: list[int] = []
        self.written: list[str] = []
        holders = defaultdict(set)
        rows = []
        for key, name, aliases in entries:
            for s in sorted({x for n in [name, *aliases] if n and n.strip() for x in spellings(n)} - {""}):
                g = grams(s)
                rows.append(g)
                owner.append(key)
                self.written.append(s)
                for x in g:
                    holders[x].add(key)
        self.plain = {key: ["".join(squash(n)) for n in [name, *aliases] if n and squash(n)] for key, name, aliases in entries}
        total = max(1, len(entries))
        self.weight = {x: log(1 + total / len(k)) for x, k in holders.items()}
        self.new = log(1 + total)
        self.owners = np.array(owner, dtype=np.int64)
        postings = defaultdict(list)
        for i, g in enumerate(rows):
            length = sqrt(sum((c * self.weight[x]) ** 2 for x, c in g.items()))
            for x, c in g.items():
                postings[x].append((i, c * self.weight[x] / length))
        self.postings = {x: (np.array([i for i, _ in p]), np.array([v for _, v in p])) for x, p in postings.items()}
        self.slot = np.full(len(owner), -1, dtype=np.int64)  # place among the candidates, while a string is scored
        self.most = {x: float(v.max()) for x, (_, v) in self.postings.items()}

    def scores(self, s: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(spellings, cosine) of all spellings with a cosine of at least `least` to s.

        Pairs are taken from the least that any spelling can gain by them on; those whose gains together stay under `least` bring no candidates,
        they only add to the score of those that the others bring.
        """
        g = grams(s)
        length = sqrt(sum((c * self.weight.get(x, self.new)) ** 2 for x, c in g.items()))
        said = sorted((self.most[x] * c * self.weight[x] / length, x, c * self.weight[x] / length) for x, c in g.items() if x in self.postings)
        gain = np.cumsum([m for m, _, _ in said])
        first = int(np.searchsorted(gain, least - 1e-9))
        if first >= len(said):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.unique(np.concatenate([self.postings[x][0] for _, x, _ in said[first:]]))
        self.slot[at] = np.arange(len(at))
        slot = self.slot[np.concatenate([self.postings[x][0] for _, x, _ in said])]
        gains = np.concatenate([self.postings[x][1] * q for _, x, q in said])
        score = np.bincount(slot[slot >= 0], weights=gains[slot >= 0], minlength=len(at))
        self.slot[at] = -1
        keep = score >= least
        return at[keep], score[keep]

    def best(self, value: str, threshold: float = THRESHOLD, margin: float = MARGIN) -> list[tuple[int, float, float]]:
        """(entry, score, share of letters changed) of the best entries, best first: all within the margin of the best score, and the next one."""
        found: dict[int, tuple[float, int, str]] = {}
        for n, s in enumerate(readings(value)):
            if not s:
                continue
            at, score = self.scores(s, PART_COSINE if n else threshold - margin)
            if n:  # some of the words count only where they are nearly all of a name
                score = 0.97 * score
            for i, x in zip(at.tolist(), score.tolist()):
                k = int(self.owners[i])
                if k not in found or x > found[k][0]:
                    found[k] = (x, i, s)
        order = sorted(found, key=lambda k: (-found[k][0], k))
        near = [k for k in order if found[k][0] >= found[order[0]][0] - margin]
        out = []
        for k in order[: max(2, len(near))]:
            score, i, s = found[k]
            changed = 1.0
            for w in dict.fromkeys([self.written[i], *self.plain[k]]):
                most = min(int(MAX_CHANGED * len(w)) + 1, int(changed * len(w)))
                changed = min(changed, typo_distance(s, w, most) / max(1, len(w)))
                if not changed:
                    break
            out.append((k, score, changed))
        return out


def map_values(values: DataFrame, reference: DataFrame, key_col: str, name_col: str, alias_col: str, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """Rows (value, entry, score) for the distinct values of the one string column; entry is -1 for values that match none.

    A value equal to a name or alias after folding maps to that entry with score 1 (the smallest key if several). Nulls are left
    out; an empty value maps to -1, as does everything against an empty reference. The reference is read in blocks of
    REFERENCE_BLOCK entries, each a broadcast index of bounded size.
    """
    spark = values.sparkSession
    distinct = materialise(values.toDF("value").where(F.col("value").isNotNull()).distinct(), "values")
    spread = distinct.repartition(max(1, ceil(distinct.count() / TASK_VALUES)))  # little to read, much to compute
    rows = reference.select(F.col(key_col).cast("long"), name_col, F.coalesce(F.col(alias_col), F.array().cast("array<string>"))).orderBy(key_col).toLocalIterator()
    scored = None
    shape = "value string, entry long, score double, changed double"
    while block := [(r[0], r[1] or "", [a for a in r[2] if a]) for r in islice(rows, REFERENCE_BLOCK)]:
        index = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            names = NameIndex(index.value)
            for pdf in batches:
                out = [(v, *b) for v in pdf["value"] for b in names.best(v, threshold, margin)]
                yield pd.DataFrame(out, columns=["value", "entry", "score", "changed"])

        part = spread.mapInPandas(run, shape)
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        return distinct.select("value", F.lit(-1).cast("long").alias("entry"), F.lit(0.0).alias("score"))
    top = scored.groupBy("value").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "changed", "entry"))).alias("all"))
    first = -F.col("all")[0]["s"]
    near = F.filter("all", lambda x: -x["s"] > first - margin)
    # those within the margin of the best cosine: the one with the fewest letters changed, by the same margin
    kept = F.array_sort(F.transform(near, lambda x: F.struct(x["changed"].alias("changed"), x["s"].alias("s"), x["entry"].alias("entry"))))
    best = top.select("value", kept[0].alias("x"), F.when(F.size(kept) > 1, kept[1]["changed"]).otherwise(F.lit(9.0)).alias("next"))
    good = (-F.col("x.s") >= threshold) & (F.col("x.changed") <= MAX_CHANGED) & ((F.col("next") - F.col("x.changed") >= margin) | (F.col("x.changed") == 0))
    mapped = best.select("value", F.when(good, F.col("x.entry")).otherwise(F.lit(-1)).cast("long").alias("entry"), (-F.col("x.s")).alias("score"))
    return distinct.join(mapped, "value", "left").select("value", F.coalesce("entry", F.lit(-1).cast("long")).alias("entry"), F.coalesce("score", F.lit(0.0)).alias("score"))


def apply_mapping(rows: DataFrame, mapping: DataFrame, salts: int = 16) -> DataFrame:
    """rows (with a column value) joined to the mapping; values that hold a large share of the rows are spread over salts."""
    if mapping.count() <= SMALL_MAPPING:
        return rows.join(F.broadcast(mapping), "value")
    spread = mapping.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("row_id", "pos"), F.lit(salts))).join(spread, ["value", "salt"]).drop("salt")
