"""Probabilistic linkage of playlist rows and files of one recording, without a shared key.

Both sides become sets of words, set right against the words of both tables. Candidates of one kind of version meet in three
blocking passes: by all words of title and version and the duration, by three words of title and credits, all but one of the title's or three of them,
and by a title word with two words of the artist and the duration. No pass brings all rows of an artist, or all of a title, together. Agreement levels of title, artist, version, further words and
duration are counted as patterns; expectation maximisation estimates how likely matches and non-matches show each level, and
the posterior of a pair's pattern is its confidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklattice.llm import spelling
from tracklattice.llm.filters import filter_of
from tracklattice.llm.text import fold, words
from tracklattice.session import materialise

# fixed values: words that do not make another recording, and marks of versions that do
NEUTRAL = {"original", "mix", "remastered", "remaster", "version", "album", "feat", "ft", "featuring", "the", "at", "in", "from", "and"}
REMIX = {"remix", "rework", "bootleg", "rmx", "vip"}
LIVE = {"live"}
#: seconds that known durations of one recording differ by at most
TOLERANCE = 3.0
#: a duration above is taken for milliseconds
LONGEST_SECONDS = 10_000.0
#: share of the files from which on a word that no playlist holds says nothing
NOISE_SHARE = 0.01
#: share of all occurrences that the rarest words, which may be misspelt, make up at most
ODD_SHARE = 0.025
LEVELS = ("title", "artist", "version", "rest", "duration")
_BRACKET = re.compile(r"[(\[{]([^()\[\]{}]*)[)\]}]?")
_CREDIT = re.compile(r"\b(?:feat|ft|featuring)\b\.?.*$")


def title_parts(name: str | None) -> tuple[list[str], list[str], list[str]]:
    """(title words, version words, credited words) of a track name; version words begin with "remix" or "live"."""
    text = fold(name or "").replace("_", " ")
    parts = [m[1] for m in _BRACKET.finditer(text)]
    text = _BRACKET.sub(" ", text)
    head, *tail = re.split(r"\s[-–—]\s", text)
    version: list[str] = []
    credits: list[str] = []
    for part in [*parts, *tail]:
        w = list(words(part))
        if REMIX & set(w):
            version = ["remix", *[x for x in w if x not in REMIX | NEUTRAL]]
        elif LIVE & set(w):
            version = ["live", *[x for x in w if x not in LIVE | NEUTRAL]]
        elif _CREDIT.search(part):
            credits += [x for x in words(_CREDIT.search(part)[0]) if x not in NEUTRAL]
        elif set(w) - NEUTRAL and part in tail:
            head += " " + part
    m = _CREDIT.search(head)
    if m:
        credits += [x for x in words(m[0]) if x not in NEUTRAL]
        head = head[: m.start()]
    title = [x for x in words(head) if x not in ("original",)]
    return title, version, credits


def artist_parts(artists: list[str] | None) -> tuple[list[str], list[str], list[str]]:
    """(words of the main artist, words of all artists, names written as one word); the main one is named first, "Last, First" is one name."""
    said = [fold(a) for a in artists if a and a.strip()] if artists is not None else []
    each = [x for a in said for x in re.split(r"\s*(?:&|;|/|\bfeat\b\.?|\bft\b\.?|\bx\b)\s*", a) if x]
    every = [w for x in each for w in words(x) if w != "the"]
    joined = []
    for x in each:
        w = [v for v in words(x) if v != "the"]
        joined += ["".join(w), "".join(reversed(w))][: 2 if "," in x else 1] if len(w) > 1 else []  # "Last, First"
    main = [w for w in words(each[0]) if w != "the"] if each else []
    return main, every, sorted(set(joined))


def _lower_share(k: Column, n: int, z: float = 2.6) -> Column:
    """Lower end of the Wilson interval of the share k of n."""
    p = k / F.lit(float(n))
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)


def _seconds(c: Column) -> Column:
    known = F.when(F.col("d").isNotNull() & ~F.isnan("d") & (F.col("d") > 0), F.col("d"))
    return F.round(F.when(known > LONGEST_SECONDS, known / 1000).otherwise(known), 1)


def _playlist(df: DataFrame, id_col: str, name: str, artists: str, duration: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, a in zip(pdf["n"], pdf["a"]):
                t, v, c = title_parts(n)
                main, every, joined = artist_parts(a)
                out.append((t, v[:1], v[1:], main, sorted({*every, *c}), joined))
            new = pd.DataFrame(out, columns=["t", "kind", "v", "m", "g", "j"])
            yield pd.concat([pdf[["id", "d"]].reset_index(drop=True), new], axis=1)

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(name).alias("n"), F.col(artists).alias("a"), F.col(duration).cast("double").alias("d"))
    words_of = "array<string>"
    return src.mapInPandas(run, f"id long, d double, t {words_of}, kind {words_of}, v {words_of}, m {words_of}, g {words_of}, j {words_of}").withColumn("d", _seconds(F.col("d")))


def _files(df: DataFrame, id_col: str, title_tokens: str, all_tokens: str, duration: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            clean = lambda said: sorted({w for x in (said if said is not None else []) if x for w in words(x) if not w.isdigit() or len(w) > 3})
            title = [clean(a) for a in pdf["x"]]
            every = [sorted({*a, *clean(b)}) for a, b in zip(title, pdf["y"])]
            yield pd.DataFrame({"id": pdf["id"], "d": pdf["d"], "w": every, "wt": title})

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(title_tokens).alias("x"), F.col(all_tokens).alias("y"), F.col(duration).cast("double").alias("d"))
    return src.mapInPandas(run, "id long, d double, w array<string>, wt array<string>").withColumn("d", _seconds(F.col("d")))


def _right(rows: DataFrame, fields: list[str], fixes: DataFrame) -> DataFrame:
    """rows with the words of the array columns set right and sorted, each word once."""
    fixed = spelling.corrected(rows, fields, fixes, "id")
    for f in fields:
        fixed = fixed.withColumn(f, F.array_sort(F.array_distinct(f)))
    return fixed


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, start: float = 0.2) -> tuple[np.ndarray, dict]:
    """Posterior of each pattern (rows of agreement levels, higher is better) under two classes with independent levels."""
    n, k = patterns.shape
    top = patterns.max(axis=0)
    closeness = (patterns / np.maximum(top, 1)).mean(axis=1)
    post = np.clip(closeness**6, 0.001, 0.999) * start * 4
    post = np.clip(post, 0.001, 0.999)
    for _ in range(rounds):
        w = np.stack([counts * post, counts * (1 - post)])
        prior = w[0].sum() / counts.sum()
        log = np.zeros((2, n))
        tables = []
        for j in range(k):
            table = np.stack([np.bincount(patterns[:, j], weights=w[c], minlength=top[j] + 1) + 0.5 for c in (0, 1)])
            table /= table.sum(axis=1, keepdims=True)
            tables.append(table)
            log += np.log(table[:, patterns[:, j]])
        log[0] += np.log(max(prior, 1e-9))
        log[1] += np.log(max(1 - prior, 1e-9))
        fresh = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        if np.abs(fresh - post).max() < 1e-9:
            post = fresh
            break
        post = fresh
    return post, {"prior": prior, "tables": tables}


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - 2**63


def _stretch(d: float | None) -> int | None:
    return None if d is None or d != d else int(d // (TOLERANCE + 1))


def playlist_keys(t: list[str], v: list[str], m: list[str], credited: list[str], d: float | None) -> set[int]:
    """Blocking keys of a playlist class: all words with a stretch of the duration, triples, and a title word with two of the artist's.

    A triple has as many of the title's words as a match may hold: all but one, three at most; of titles of two words, both, or one with two words of the main
    artist. -1 and -2 stand for a file and a playlist row of unknown duration.
    """
    b = _stretch(d)
    near = [] if b is None else [b - 1, b, b + 1]
    title, main = set(t), set(m)
    out = {_hash("whole", *words, x) for words in (sorted({*t, *v}), sorted({*t, *v, *m})) for x in ([*near, -1] if near else [-2, -1])}
    if len(title) <= 2:  # one of the title's words may be misspelt, whatever the duration
        for w in title:
            out |= {_hash("three", *sorted((w, *x))) for x in combinations(sorted(main - {w}), 2)}
            if len(main) == 1:
                out.add(_hash("two", *sorted((w, *main))))
    need = min(3, max(len(title) - 1, min(len(title), 2)))
    others = sorted(set(credited) - title)
    for of_title in range(need, min(3, len(title)) + 1):
        for x in combinations(sorted(title), of_title):
            for y in combinations(others, 3 - of_title):
                out.add(_hash("three", *sorted((*x, *y))))
    for x in combinations(sorted(set(m)), 2):
        out |= {_hash("timed", *x, w, n) for w in title for n in near}
    return out


def file_keys(w: list[str], wt: list[str], d: float | None) -> set[int]:
    """Blocking keys of a file class that meet those of playlist_keys."""
    b = _stretch(d)
    out = {_hash("three", *x) for x in combinations(sorted(set(w)), 3)}
    if len(w) <= 3:
        out |= {_hash("two", *x) for x in combinations(sorted(set(w)), 2)}
    if len(w):
        out |= {_hash("whole", *sorted(w), x) for x in ([b, -2] if b is not None else [-1])}
    if b is not None:
        out.add(_hash("whole", *sorted(wt), b))
        for x in combinations(sorted(set(w) - set(wt)), 2):
            out |= {_hash("timed", *x, t, b) for t in wt}
    return out


def _spread(pdf: pd.DataFrame, name: str, keys: list[set[int]]) -> pd.DataFrame:
    n = [len(k) for k in keys]
    return pd.DataFrame({name: np.repeat(pdf[name].to_numpy(), n), "kind": np.repeat(pdf["kind"].to_numpy(), n), "key": np.fromiter((x for k in keys for x in k), np.int64, sum(n))})


def _playlist_keys(bits):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = _spread(pdf, "p", [playlist_keys(t, v, m, [*m, *g, *j], d) for t, v, m, g, j, d in zip(pdf["t"], pdf["v"], pdf["m"], pdf["g"], pdf["j"], pdf["d"])])
            yield out[bits.value.holds(out["key"].to_numpy().view(np.uint64))]

    return run


def _file_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield _spread(pdf, "f", [file_keys(w, wt, d) for w, wt, d in zip(pdf["w"], pdf["wt"], pdf["d"])])


def _candidates(pc: DataFrame, fc: DataFrame) -> DataFrame:
    """Pairs (p, f) of classes that meet in a blocking pass."""
    right = materialise(fc.select("f", "kind", "w", "wt", "d").mapInPandas(_file_keys, "f long, kind string, key long"), "file-keys")
    bits = pc.sparkSession.sparkContext.broadcast(filter_of(right))  # keys that no file has are not shuffled
    left = pc.select("p", "kind", "t", "v", "m", "g", "j", "d").mapInPandas(_playlist_keys(bits), "p long, kind string, key long")
    return left.join(right, ["key", "kind"]).select("p", "f").distinct()


def linked_pairs(
    playlist: DataFrame, files: DataFrame, row_id: str = "row_id", name: str = "name", artists: str = "artists", duration: str = "duration_sec",
    file_id: str = "file_no", title_tokens: str = "title_tokens", all_tokens: str = "all_tokens", file_duration: str = "audio_duration_sec",
) -> DataFrame:
    """Rows (row_id, file_no, confidence, exact) for the pairs that met in a blocking pass and may be one recording.

    exact tells whether title, version and main artist agree word for word (up to misspelt or, beside an agreeing artist and
    duration, one missing word) and known durations agree. Rows without a title or without words match nothing. Null, zero and NaN
    durations are unknown. Repeated rows are one class until the end and each come out; ids should be unique.
    Rows of one class meet once, so a recording that fills a third of either table costs as much as any other before its pairs
    are written out. Empty tables give no rows.
    """
    p0 = materialise(_playlist(playlist, row_id, name, artists, duration), "playlist")
    f0 = materialise(_files(files, file_id, title_tokens, all_tokens, file_duration), "files")
    fields = ["t", "v", "m", "g"]
    said_p = p0.select(F.explode(F.flatten(F.array(*fields))).alias("word")).groupBy("word").agg(F.count("*").alias("n_p"))
    said_f = f0.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n_f"))
    counts = materialise(said_p.join(said_f, "word", "full").na.fill(0).withColumn("n", F.col("n_p") + F.col("n_f")), "words")
    fixes = materialise(spelling.corrections(counts.select("word", "n")), "fixes")
    n_files = max(1, f0.count())
    # words that each fill NOISE_SHARE of the files, by the lower end of the share's confidence interval: fewer than (words of a file) / NOISE_SHARE
    noise = counts.where((F.col("n_p") == 0) & (_lower_share(F.col("n_f"), n_files) >= NOISE_SHARE)).select("word").collect()
    skip = F.array(*[F.lit(w) for w in sorted(NEUTRAL | {r["word"] for r in noise})])
    marks = F.array(*[F.lit(w) for w in sorted(REMIX | LIVE)])
    # words of their own: all but the rarest, and names of artists written as one word; the rest may be misspelt
    octaves = counts.groupBy(F.floor(F.log2("n")).alias("octave")).agg(F.sum("n").alias("n")).orderBy("octave").collect()  # at most 64 rows
    mass, least = 0, 0
    for r in octaves:
        mass += r["n"]
        if mass > ODD_SHARE * sum(x["n"] for x in octaves):
            break
        least = 2 ** (r["octave"] + 1)
    joined = p0.select(F.explode("j").alias("word"))
    known = counts.where(F.col("n") >= least).select("word").unionByName(joined).distinct().withColumn("known", F.lit(1))

    p = _right(p0.withColumn("kind", F.coalesce(F.get("kind", F.lit(0)), F.lit(""))), fields, fixes).where(F.size("t") > 0)
    p = p.withColumn("p", F.xxhash64("t", "v", "kind", "m", "g", "j", F.coalesce("d", F.lit(-1.0))))
    f = _right(f0, ["w", "wt"], fixes)
    raw = F.array_except("w", skip)
    f = f.select(
        "id", "d", F.array_except(raw, marks).alias("w"), F.array_except(F.array_except("wt", skip), marks).alias("wt"), F.arrays_overlap("w", F.array(*[F.lit(w) for w in sorted(REMIX)])).alias("remix"),
        F.array_contains("w", "live").alias("live"), F.arrays_overlap("w", F.array(F.lit("feat"), F.lit("ft"), F.lit("featuring"))).alias("feat"),
    )
    f = f.withColumn("kind", F.when(F.col("remix"), "remix").when(F.col("live"), "live").otherwise("")).withColumn("f", F.xxhash64("w", "wt", "kind", "feat", F.coalesce("d", F.lit(-1.0))))
    p, f = materialise(p, "p"), materialise(f.drop("remix", "live"), "f")
    pc = p.groupBy("p").agg(*[F.first(c).alias(c) for c in ("t", "v", "kind", "m", "g", "j", "d")])
    fc = f.groupBy("f").agg(*[F.first(c).alias(c) for c in ("w", "wt", "kind", "feat", "d")])

    both = _candidates(pc, fc).join(pc, "p").join(fc.select("f", "w", "feat", F.col("d").alias("f_d")), "f")

    main_joined = F.array(F.array_join("m", ""), F.array_join(F.reverse("m"), ""))
    has_joined = F.arrays_overlap("w", main_joined) & (F.size("m") > 0)
    rest = F.array_except(F.array_except(F.array_except(F.array_except("w", "t"), "v"), "m"), main_joined)
    unexplained = F.array_except(F.array_except(rest, "g"), "j")
    both = both.select(
        "p", "f", "feat", "kind",
        F.size("t").alias("n_t"), F.size(F.array_except("t", "w")).alias("t_miss"), F.size(F.array_except("v", "w")).alias("v_miss"),
        F.when(has_joined | (F.size(F.array_except("m", "w")) == 0) & (F.size("m") > 0), 3).when(F.size(F.array_intersect("m", "w")) > 0, 2).otherwise(0).alias("a"),
        unexplained.alias("rest"),
        F.when(F.col("d").isNull() | F.col("f_d").isNull(), 1).when(F.abs(F.col("d") - F.col("f_d")) <= TOLERANCE + 0.11, 2).otherwise(0).alias("duration"),
    )
    both = materialise(both, "candidates")
    odd = both.select("p", "f", F.explode("rest").alias("word")).join(known, "word", "left").groupBy("p", "f").agg(F.sum(F.coalesce("known", F.lit(0))).alias("r_known"), F.count("*").alias("r_all"))
    both = both.join(odd, ["p", "f"], "left").na.fill(0, ["r_known", "r_all"])
    guests = F.when(F.col("feat"), 2).otherwise(0)
    r_known = F.greatest(F.lit(0), F.col("r_known") - guests)
    r_odd = F.col("r_all") - F.col("r_known")
    title = F.when(F.col("t_miss") == 0, 3).when((F.col("t_miss") == 1) & (r_odd >= 1), 2).when((F.col("t_miss") == 1) & (F.col("n_t") >= 3), 1).otherwise(0)
    artist = F.when(F.col("a") == 3, 3).when((F.col("a") == 2) & ((r_odd >= 1) | (r_known == 0)), 2).when((F.col("a") == 0) & (r_known == 0), 1).otherwise(0)
    version = F.when(F.col("v_miss") == 0, 2).when((F.col("v_miss") == 1) & (r_odd >= 1), 1).otherwise(0)
    levels = both.select("p", "f", title.alias("title"), artist.alias("artist"), version.alias("version"), F.when(r_known > 0, 0).when(r_odd > 0, 1).otherwise(2).alias("rest"), "duration")
    levels = materialise(levels, "levels")
    table = levels.groupBy(*LEVELS).agg(F.count("*").alias("n")).toPandas()  # at most 4 * 4 * 3 * 3 * 3 rows
    if not len(table):
        return playlist.sparkSession.createDataFrame([], f"{row_id} long, {file_id} long, confidence double, exact boolean")
    post, _ = expectation_maximisation(table[list(LEVELS)].to_numpy(), table["n"].to_numpy().astype(float))
    table["confidence"] = post
    table["exact"] = (table["title"] + (table["artist"] == 3) * (table["duration"] == 2) >= 2) & (table["title"] >= 1) & (table["artist"] >= 1) & (table["version"] >= 1) & (table["rest"] >= 1) & (table["duration"] >= 1)
    scored = playlist.sparkSession.createDataFrame(table.drop(columns="n"))
    good = levels.join(F.broadcast(scored), list(LEVELS)).where((F.col("confidence") >= 0.01) | F.col("exact")).select("p", "f", "confidence", "exact")
    return good.join(p.select("p", F.col("id").alias(row_id)), "p").join(f.select("f", F.col("id").alias(file_id)), "f").select(row_id, file_id, "confidence", "exact")
