"""Groups of records of one recording and the best representative of each.

Records meet over a shared track id or over file names that differ in spelling and decoration only. In a group, fields that
depend on each other form a bundle that is taken over whole. For each bundle the distinct values are candidates with a trust made of
how many records hold them, their confidence and their date; the choice over all bundles maximises the total trust by
branch and bound, under functional dependencies between bundles.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklattice.functions.music import camelot, tempo
from tracklattice.llm import spelling
from tracklattice.llm.text import fold
from tracklattice.operators.graph import connected_components
from tracklattice.session import materialise

#: text that stands for a missing id
NO_ID = ["", "-", "?", "??", "n/a", "na", "none", "null", "nan", "unknown", "0"]


def name_words(file_name: str | None) -> list[str]:
    """Words of a file name without folder, extension, leading track number and copy marks; [] where it describes nothing."""
    if not file_name:
        return []
    name = re.split(r"[\\/]", unquote(file_name))[-1]
    name = re.sub(r"\.[A-Za-z][A-Za-z0-9]{1,4}$", "", name)
    name = fold(name).replace("_", " ").strip()
    name = re.sub(r"^\d{1,3}\s*[-.)]\s+", "", name)
    name = re.sub(r"(\s*\(\d{1,2}\)|\s*-\s*(copy|kopie)(\s*\(?\d+\)?)?)+$", "", name)
    words = re.findall(r"[^\W_]+", name)
    return words if sum(len(w) >= 3 and w.isalpha() for w in words) >= 3 else []


def _named(df: DataFrame, id_col: str, track_col: str, name_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "track": pdf["track"], "words": [name_words(n) for n in pdf["name"]]})

    track = F.trim(F.col(track_col))
    src = df.select(F.col(id_col).cast("long").alias("id"), F.when(~F.lower(track).isin(NO_ID), track).alias("track"), F.col(name_col).alias("name"))
    return src.mapInPandas(run, "id long, track string, words array<string>")


def record_groups(df: DataFrame, id_col: str = "row_id", track_col: str = "track_id", name_col: str = "file_name") -> DataFrame:
    """Rows (id, grp): records of one group share grp. Records without an id and a describing name are groups of their own.

    Names are compared after words misspelt against the corpus are set right, then up to two typing errors in the whole name
    without spaces, whatever their words. Names that differ in one word for another stay apart where the two are words of their own, see _without_own_words.
    """
    named = materialise(_named(df, id_col, track_col, name_col), "names")
    counts = materialise(named.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    fixes = materialise(spelling.corrections(counts), "fixes")
    rows = spelling.corrected(named, ["words"], fixes, "id").withColumn("s", F.when(F.size("words") > 0, F.array_join("words", "")))
    rows = materialise(rows, "right")
    strings = materialise(rows.where("s is not null").groupBy("s").agg(F.min("words").alias("w")), "strings")
    close = _without_own_words(materialise(spelling.near_equal(strings.select("s")), "close"), strings)
    node_name = lambda c: F.concat(F.lit("n|"), c)
    node_track = lambda c: F.concat(F.lit("t|"), c)
    held = rows.where("track is not null and s is not null").select(node_track(F.col("track")).alias("a"), node_name(F.col("s")).alias("b")).distinct()
    labels = connected_components(held.unionByName(close.select(node_name(F.col("a")).alias("a"), node_name(F.col("b")).alias("b"))))
    # nodes without an edge keep their own name as group, records without a node are alone
    keyed = rows.select("id", F.coalesce(node_track(F.col("track")), node_name(F.col("s")), F.concat(F.lit("r|"), F.col("id").cast("string"))).alias("node"))
    return keyed.join(labels, "node", "left").select("id", F.coalesce("component", "node").alias("grp"))


def _without_own_words(close: DataFrame, names: DataFrame) -> DataFrame:
    """close (a, b) without pairs that put one word for another, both words of their own.

    Two words are that if neither is spelling.RATIO times as frequent among the names as the other, and less than half of the names of either
    have a near name with the other: a misspelling stands beside the right form nearly always. Both are shares, so the size of the table doesn't count.
    """
    both = close.join(names.select(F.col("s").alias("a"), F.col("w").alias("w_a")), "a").join(names.select(F.col("s").alias("b"), F.col("w").alias("w_b")), "b")
    both = both.select("a", "b", F.array_except("w_a", "w_b").alias("x"), F.array_except("w_b", "w_a").alias("y"))
    swaps = both.where((F.size("x") == 1) & (F.size("y") == 1)).select("a", "b", F.get("x", F.lit(0)).alias("x"), F.get("y", F.lit(0)).alias("y"))
    sides = swaps.select(F.col("a").alias("s"), "x", "y").unionByName(swaps.select(F.col("b").alias("s"), F.col("y").alias("x"), F.col("x").alias("y")))
    counts = names.select(F.explode(F.array_distinct("w")).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    share = sides.groupBy("x", "y").agg(F.countDistinct("s").alias("m")).join(counts, "x")
    other = share.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("m").alias("m_y"), F.col("n").alias("n_y"))
    alike = F.greatest("n", "n_y") < F.least("n", "n_y") * spelling.RATIO
    own = share.join(other, ["x", "y"]).where(alike & (2 * F.col("m") < F.col("n")) & (2 * F.col("m_y") < F.col("n_y"))).select("x", "y")
    return close.join(swaps.join(own, ["x", "y"]).select("a", "b"), ["a", "b"], "left_anti")


def choose(candidates: list[list[tuple]], admissible, linked: set[tuple[int, int]] | None = None) -> list[int]:
    """Index of the candidate chosen in each bundle: branch and bound over (trust, value) lists, best total trust first.

    admissible(i, a, j, b) tells whether candidate a of bundle i may stand beside b of bundle j. A bundle may stay empty (-1). linked: the pairs of bundles
    that depend on each other (all, if left out); bundles that no dependency joins are solved apart, so the search is as deep as the longest chain
    of dependencies, not as the number of bundles.
    """
    n = len(candidates)
    part = list(range(n))
    for i, j in linked if linked is not None else {(i, i + 1) for i in range(n - 1)}:
        part = [part[i] if x == part[j] else x for x in part]
    best = [-1] * n
    for p in set(part):
        own = [i for i in range(n) if part[i] == p]
        for i, k in zip(own, _search([candidates[i] for i in own], lambda i, a, j, b, own=own: admissible(own[i], a, own[j], b))):
            best[i] = k
    return best


def _search(candidates: list[list[tuple]], admissible) -> list[int]:
    order = [sorted(range(len(c)), key=lambda k, c=c: (-c[k][0], str(c[k][1]))) for c in candidates]
    bound = [0.0] * (len(candidates) + 1)
    for i in range(len(candidates) - 1, -1, -1):
        bound[i] = bound[i + 1] + (candidates[i][order[i][0]][0] if order[i] else 0.0)
    best, best_sum = [-1] * len(candidates), -1.0

    def visit(i: int, taken: list[int], total: float) -> None:
        nonlocal best, best_sum
        if total + bound[i] <= best_sum:
            return
        if i == len(candidates):
            best, best_sum = taken[:], total
            return
        for k in order[i]:
            if total + candidates[i][k][0] + bound[i + 1] <= best_sum:
                break  # those that follow are trusted less
            if all(t < 0 or admissible(j, t, i, k) for j, t in enumerate(taken)):
                visit(i + 1, [*taken, k], total + candidates[i][k][0])
        visit(i + 1, [*taken, -1], total)

    visit(0, [], 0.0)
    return best


def trusts(held: list[tuple[int, float | None, object]]) -> list[float]:
    """Trust of each candidate (records, confidence, date): more records first, then the higher confidence, then the later date.

    Where a confidence is unknown on either side the date decides alone. A candidate's trust is its records and the share of those with as many records
    that it goes before; sorted, so a group of many values costs no more than sorting them.
    """
    out = [float(n) for n, _, _ in held]
    by_n: dict[int, list[int]] = {}
    for i, (n, _, _) in enumerate(held):
        by_n.setdefault(n, []).append(i)
    for same in by_n.values():
        if len(same) == 1:
            continue
        known = sorted(held[i][1] for i in same if held[i][1] is not None)
        dates: dict[float | None, list] = {}  # confidence -> dates of those that hold it
        for i in same:
            dates.setdefault(held[i][1], []).append(held[i][2])
        undated = {c: sum(u is None for u in us) for c, us in dates.items()}
        dated = {c: sorted(u for u in us if u is not None) for c, us in dates.items()}
        every = sorted(u for c, us in dated.items() if c is not None for u in us)
        blank = None in dates
        for i in same:
            _, c, u = held[i]
            wins = 0
            if c is not None:
                wins += bisect_left(known, c)
                wins += bisect_left(dated[c], u) + undated[c] if u is not None else 0
                if blank:  # the date decides, and where it can't, a known confidence is better
                    later = len(dated[None]) - bisect_right(dated[None], u) if u is not None else 0
                    wins += len(dates[None]) - later
            else:
                wins += bisect_left(dated[None], u) + undated[None] + bisect_left(every, u) if u is not None else 0
            out[i] += wins / (len(held) + 1)
    return out


def best_records(
    df: DataFrame, groups: DataFrame, bundles: dict[str, list[Column]], id_col: str = "row_id", confidence: str = "confidence", updated: str = "updated_at",
    dependencies: tuple[tuple[str, str], ...] = (), least: int = 2,
) -> DataFrame:
    """One row for each group of at least `least` records: id (the smallest), records, and a column for each bundle: the chosen
    values as an array of strings, null where no record holds a complete valid value.

    bundles maps a name to expressions over df; a value counts where none of them is null. dependencies (x, y): in one group a
    value of bundle x stands with one value of y only, that of a record which holds both. Records that agree in everything but
    their id count once. Null confidences and dates take part, see trusts. Empty tables give no rows; columns of df that are
    called like result columns do no harm. Candidates are counted before groups meet, so a group of any size reaches a task as
    its distinct values.
    """
    names = list(bundles)
    value = {b: F.when(F.greatest(*[c.isNull().cast("int") for c in [*cols, F.lit(1)]]) == 0, F.array(*[c.cast("string") for c in cols])) for b, cols in bundles.items()}
    others = [c for c in df.columns if c != id_col and "map<" not in df.schema[c].dataType.simpleString()]
    rows = df.select(F.xxhash64(*others).alias("whole"), F.col(id_col).cast("long").alias("id"), F.col(confidence).cast("double").alias("c"), F.col(updated).cast("timestamp").alias("u"), *[value[b].alias(f"v_{i}") for i, b in enumerate(names)])
    rows = materialise(rows.join(groups, "id"), "records")
    sizes = rows.groupBy("grp").agg(F.min("id").alias("id"), F.count("*").alias("records")).where(F.col("records") >= least)
    once = rows.groupBy("grp", "whole", "c", "u", *[f"v_{i}" for i in range(len(names))]).agg(F.lit(1).alias("one"))
    stacked = once.select("grp", "c", "u", F.array(*[f"v_{i}" for i in range(len(names))]).alias("vs"))
    cells = stacked.select("grp", "c", "u", "vs", F.posexplode("vs").alias("bundle", "v")).where("v is not null")
    counted = cells.groupBy("grp", "bundle", "v").agg(F.count("*").alias("n"), F.max("c").alias("c"), F.max("u").alias("u"))
    packed = counted.groupBy("grp").agg(F.collect_list(F.struct("bundle", "v", "n", "c", F.col("u").cast("double").alias("u"))).alias("cands"))
    pairs = [(names.index(x), names.index(y)) for x, y in dependencies]
    if pairs:
        both = [stacked.where(f"vs[{x}] is not null and vs[{y}] is not null").select("grp", F.lit(x).alias("x"), F.lit(y).alias("y"), F.col("vs")[x].alias("vx"), F.col("vs")[y].alias("vy")).distinct() for x, y in pairs]
        seen = both[0]
        for b in both[1:]:
            seen = seen.unionByName(b)
        packed = packed.join(seen.groupBy("grp").agg(F.collect_list(F.struct("x", "y", "vx", "vy")).alias("seen")), "grp", "left")
    else:
        packed = packed.withColumn("seen", F.lit(None).cast("array<struct<x:int,y:int,vx:array<string>,vy:array<string>>>"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for grp, cands, seen in zip(pdf["grp"], pdf["cands"], pdf["seen"]):
                lists: list[list[tuple]] = [[] for _ in names]
                for i in range(len(names)):
                    mine = [c for c in cands if c["bundle"] == i]
                    t = trusts([(c["n"], None if pd.isna(c["c"]) else c["c"], None if pd.isna(c["u"]) else c["u"]) for c in mine])
                    lists[i] = [(s, tuple(c["v"])) for s, c in zip(t, mine)]
                together = {(s["x"], tuple(s["vx"]), s["y"], tuple(s["vy"])) for s in (seen if seen is not None else [])}
                bound_x = {(x, vx, y) for x, vx, y, _ in together}

                def admissible(i, a, j, b, lists=lists, together=together, bound_x=bound_x):
                    for x, y, vx, vy in ((i, j, lists[i][a][1], lists[j][b][1]), (j, i, lists[j][b][1], lists[i][a][1])):
                        if (x, vx, y) in bound_x and (x, vx, y, vy) not in together:
                            return False
                    return True

                pick = choose(lists, admissible, set(pairs))
                out.append((grp, *[list(lists[i][k][1]) if k >= 0 else None for i, k in enumerate(pick)]))
            yield pd.DataFrame(out, columns=["grp", *names])

    chosen = packed.mapInPandas(solve, "grp string, " + ", ".join(f"`{b}` array<string>" for b in names))
    return sizes.join(chosen, "grp", "left").select("id", "records", *names)


def key_value() -> Column:
    return camelot(F.col("canonical_key"))


def tempo_value() -> Column:
    return F.round(tempo(F.col("canonical_bpm"))).cast("long")
