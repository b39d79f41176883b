"""Groups of vectors: centres, medoids, assignment, merging, constraints, small exact clusterings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklattice.functions import vectors
from tracklattice.functions.music import is_wheel_code, wheel_distance
from tracklattice.session import materialise

#: groups up to which centres are broadcast
MAX_GROUPS = 20_000
#: groups whose distances to each other fit one matrix
MAX_MERGED = 8_000


def centres(rows: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """Rows (group, n, total): sum of the unit vectors of each group, added up before the shuffle."""
    u = rows.where(F.size(vector) == dim).select(group, vectors.unit(F.col(vector)).alias("u"))
    return u.groupBy(group).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("u")[i]) for i in range(dim)]).alias("total"))


def medoids(rows: DataFrame, group: str, id_col: str, vector: str, dim: int, rounding: int = 6) -> DataFrame:
    """Rows (group, medoid, distance_sum): the member with the least sum of cosine distances to its group, the smaller id on ties.

    The sum over a group is n minus the inner product with the group's total, so no pair of members is looked at.
    """
    c = centres(rows, group, vector, dim)
    if c.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS:
        c = F.broadcast(c)
    each = rows.where(F.size(vector) == dim).select(group, id_col, vectors.unit(F.col(vector)).alias("u")).join(c, group)
    summed = each.select(group, id_col, F.round(F.col("n") - vectors.dot(F.col("u"), F.col("total")), rounding).alias("d"))
    best = summed.groupBy(group).agg(F.min(F.struct("d", F.col(id_col).alias("i"))).alias("x"))
    return best.select(group, F.col("x.i").alias("medoid"), F.col("x.d").alias("distance_sum"))


def assign_nearest(rows: DataFrame, id_col: str, vector: str, medoid_rows: DataFrame, group: str, limit: float = 0.8) -> DataFrame:
    """Rows (id, group, distance): the group of the nearest medoid by cosine distance, null beyond the limit.

    medoid_rows holds (group, vector), at most MAX_GROUPS rows, which is checked; the smaller group wins ties.
    """
    if medoid_rows.limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
        raise ValueError("more medoids than MAX_GROUPS")
    packed = medoid_rows.select(group, vectors.unit(F.col(vector)).alias("u")).orderBy(group).toPandas()
    names, m = packed[group].tolist(), np.array(packed["u"].tolist(), dtype=float)
    sent = rows.sparkSession.sparkContext.broadcast((names, m))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, mat = sent.value
        for pdf in batches:
            v = np.array(pdf["u"].tolist(), dtype=float).reshape(len(pdf), -1)
            d = np.round(1 - v @ mat.T, 9)
            at = d.argmin(axis=1)
            dist = d[np.arange(len(d)), at]
            yield pd.DataFrame({id_col: pdf[id_col], group: [labels[i] if x <= limit else None for i, x in zip(at, dist)], "distance": np.round(dist, 6)})

    dim = m.shape[1]
    src = rows.where(F.size(vector) == dim).select(id_col, vectors.unit(F.col(vector)).alias("u"))
    return src.mapInPandas(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {group} {medoid_rows.schema[group].dataType.simpleString()}, distance double")


def first_seen_mode(rows: DataFrame, group: str, value: str, order: Column) -> DataFrame:
    """Rows (group, value): the most frequent value, the one seen first on ties; nulls and blanks do not count."""
    counts = rows.where(F.trim(F.col(value).cast("string")) != "").groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("a"), F.col("first").alias("b"), F.col(value).alias("v"))).alias("x")).select(group, F.col("x.v").alias(value))


def group_distances(c: DataFrame, group: str) -> DataFrame:
    """Rows (a, b, distance), a < b: mean cosine distance over all cross pairs of two groups, from their sums.

    c comes from centres and is one row a group: the pairs are of groups, of which MAX_GROUPS are allowed.
    """
    a = c.select(F.col(group).alias("a"), F.col("n").alias("n_a"), F.col("total").alias("t_a"))
    b = c.select(F.col(group).alias("b"), F.col("n").alias("n_b"), F.col("total").alias("t_b"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))
    return pairs.select("a", "b", (1 - vectors.dot(F.col("t_a"), F.col("t_b")) / (F.col("n_a") * F.col("n_b"))).alias("distance"))


def _merge(d: np.ndarray, names: list, keep: int) -> dict:
    """Old name -> merged name; d is the upper triangle of the distances, infinite elsewhere."""
    label, alive = np.arange(len(names)), len(names)
    nearest = d.min(axis=1, initial=np.inf)
    while alive > max(1, keep) and np.isfinite(nearest).any():
        a = int(nearest.argmin())
        b = int(d[a].argmin())
        label[label == b] = a
        d[b], d[:, b] = np.inf, np.inf
        nearest[b] = np.inf
        nearest[:b] = d[:b].min(axis=1, initial=np.inf)
        alive -= 1
    return {g: names[i] for g, i in zip(names, label)}


def coarse_merge(distances: pd.DataFrame, groups: list, keep: int) -> dict:
    """Old group -> merged group: the two nearest groups are joined until `keep` remain; a joined group keeps the first one's distances."""
    names = sorted(groups)
    at = {g: i for i, g in enumerate(names)}
    d = np.full((len(names), len(names)), np.inf)
    for a, b, x in distances[["a", "b", "distance"]].itertuples(index=False):
        d[min(at[a], at[b]), max(at[a], at[b])] = x
    return _merge(d, names, keep)


def merged_groups(c: DataFrame, group: str, keep: int | None = None) -> dict:
    """coarse_merge over the mean cosine distances of all groups of c, which comes from centres, down to half of them by default.

    Of its rows, one a group, MAX_MERGED are allowed, which is checked: their sums meet the driver, and their distances are one matrix.
    """
    if c.limit(MAX_MERGED + 1).count() > MAX_MERGED:
        raise ValueError("more groups than MAX_MERGED")
    rows = c.orderBy(group).toPandas()
    n = rows["n"].to_numpy(dtype=float)
    total = np.array(rows["total"].tolist(), dtype=float).reshape(len(rows), -1)
    d = np.round(1 - total @ total.T / np.outer(n, n), 9)
    d[np.tril_indices(len(d))] = np.inf
    return _merge(d, rows[group].tolist(), len(rows) // 2 if keep is None else keep)


def silhouettes(rows: DataFrame, group: str, id_col: str, vector: str, dim: int) -> DataFrame:
    """Rows (id, group, silhouette) by cosine distance, from the sums of the groups; a member of a group of one has 0.

    The sums, at most MAX_GROUPS rows, which is checked, go to every task; rows are held against them in batches.
    """
    c = centres(rows, group, vector, dim)
    if c.limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
        raise ValueError("more groups than MAX_GROUPS")
    packed = c.toPandas()
    sent = rows.sparkSession.sparkContext.broadcast((packed[group].tolist(), packed["n"].to_numpy(), np.array(packed["total"].tolist(), dtype=float).reshape(-1, dim)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, n, total = sent.value
        place = {g: i for i, g in enumerate(names)}
        for pdf in batches:
            u = np.array(pdf["u"].tolist(), dtype=float).reshape(len(pdf), dim)
            own = np.array([place[g] for g in pdf[group]], dtype=int)
            sums = n[None, :] - u @ total.T
            at = np.arange(len(u))
            inner = np.divide(sums[at, own], n[own] - 1, out=np.full(len(u), np.nan), where=n[own] > 1)
            mean = sums / n[None, :]
            mean[at, own] = np.inf
            other = mean.min(axis=1) if mean.shape[1] > 1 else np.full(len(u), np.nan)
            s = (other - inner) / np.maximum(np.maximum(inner, other), 1e-12)
            yield pd.DataFrame({id_col: pdf[id_col], group: pdf[group], "silhouette": np.where(np.isfinite(s), s, 0.0)})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (id_col, group)}
    src = rows.where(F.size(vector) == dim).select(id_col, group, vectors.unit(F.col(vector)).alias("u"))
    return src.mapInPandas(run, f"{id_col} {kinds[id_col]}, {group} {kinds[group]}, silhouette double")


def constraint_counts(tracks: DataFrame, id_col: str, key: str, bpm: str, spread: float = 0.07) -> DataFrame:
    """Rows (id, hard, relaxed): with how many other tracks a track must not, or should not, share a group.

    hard: more than two steps round the key wheel, else tempos further apart than `spread` of their mean; relaxed: exactly two steps.
    Unknown keys bring no key constraint, unknown tempos no tempo constraint. Tracks are counted by (key, whole tempo) cell, a bounded
    number; cells meet over the fixed table of key pairs, and no pair of tracks is looked at.
    """
    cell = tracks.select(id_col, F.when(is_wheel_code(F.col(key)), F.col(key)).otherwise("").alias("k"), F.coalesce(F.bround(F.col(bpm)).cast("int"), F.lit(-1)).alias("t"))
    counts = cell.groupBy("k", "t").agg(F.count("*").alias("n"))
    codes = ["", *[f"{n}{s}" for n in range(1, 13) for s in "AB"]]
    wheel = tracks.sparkSession.createDataFrame([(a, b) for a in codes for b in codes], "ka string, kb string")
    wheel = wheel.withColumn("steps", F.coalesce(wheel_distance(F.col("ka"), F.col("kb")), F.lit(0)))
    a = counts.select(F.col("k").alias("ka"), F.col("t").alias("ta")).join(F.broadcast(wheel), "ka")
    pairs = a.join(F.broadcast(counts.select(F.col("k").alias("kb"), F.col("t").alias("tb"), "n")), "kb")  # cells: 25 keys times the whole tempos
    far = (F.col("ta") >= 0) & (F.col("tb") >= 0) & (F.abs(F.col("ta") - F.col("tb")) / ((F.col("ta") + F.col("tb")) / 2) > spread)
    hard = (F.col("steps") > 2) | F.coalesce(far, F.lit(False))
    per_cell = pairs.groupBy("ka", "ta").agg(F.sum(F.when(hard, F.col("n")).otherwise(0)).alias("hard"), F.sum(F.when(F.col("steps") == 2, F.col("n")).otherwise(0)).alias("relaxed"))
    return cell.join(F.broadcast(per_cell), (F.col("k") == F.col("ka")) & (F.col("t") == F.col("ta"))).select(id_col, "hard", "relaxed")


class _Partition:
    """Clusters that grow under constraints: for every row, which clusters hold a partner that it must not, or should not, meet."""

    def __init__(self, hard: np.ndarray, relaxed: np.ndarray, room: int):
        self.hard, self.relaxed = hard, relaxed
        self.label = np.full(len(hard), -1)
        self.banned, self.shunned = np.zeros((room, len(hard)), bool), np.zeros((room, len(hard)), bool)
        self.count = 0

    def add(self, i: int, c: int) -> None:
        self.label[i] = c
        self.count = max(self.count, c + 1)
        self.banned[c] |= self.hard[i]
        self.shunned[c] |= self.relaxed[i]

    def place(self, i: int, near: np.ndarray) -> int | None:
        """Nearest cluster without any conflict, then without a hard one; None where there is neither."""
        for banned in (self.banned[: self.count, i] | self.shunned[: self.count, i], self.banned[: self.count, i]):
            if not banned.all():
                return int(np.where(banned, np.inf, near).argmin())
        return None


def _medoid_rounds(d: np.ndarray, hard: np.ndarray, relaxed: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> np.ndarray:
    """Labels of k-medoids under constraints: seeds by distance squared, rows nearest to a medoid first, clusters of their own where no other is allowed."""
    n = len(d)
    seeds = [int(rng.integers(n))]
    while len(seeds) < k:
        far = d[:, seeds].min(axis=1) ** 2
        far[seeds] = 0
        seeds.append(int(rng.choice(n, p=far / far.sum())) if far.sum() > 1e-12 else int(np.setdiff1d(np.arange(n), seeds)[0]))
    last = None
    for _ in range(rounds):
        part, medoids = _Partition(hard, relaxed, n), list(dict.fromkeys(seeds))
        for c, i in enumerate(medoids):
            part.add(i, c)
        for i in np.argsort(d[:, medoids].min(axis=1), kind="stable").tolist():
            if part.label[i] < 0:
                c = part.place(i, d[i, medoids])
                if c is None:
                    c = len(medoids)
                    medoids.append(i)
                part.add(i, c)
        if last is not None and np.array_equal(last, part.label):
            break
        last = part.label
        groups = [np.flatnonzero(last == c) for c in range(part.count)]
        seeds = [int(g[d[np.ix_(g, g)].sum(axis=1).argmin()]) for g in groups]
    return last


def silhouette_of(d: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette of labels 0..k-1 on a distance matrix; rows alone count 0."""
    k = int(label.max()) + 1
    member = np.zeros((len(d), k))
    member[np.arange(len(d)), label] = 1
    size, sums = member.sum(axis=0), d @ member
    own = size[label]
    inner = np.divide(sums[np.arange(len(d)), label], own - 1, out=np.zeros(len(d)), where=own > 1)
    other = sums / np.maximum(size, 1)
    other[np.arange(len(d)), label] = np.inf
    outer = other.min(axis=1)
    return float(np.where(own > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-12), 0.0).mean())


def constrained_medoids(block: pd.DataFrame, id_col: str, vector: str, hard: np.ndarray, relaxed: np.ndarray | None = None, target: float = 8.0, least: int = 3, most: int = 20, seed: int = 42) -> pd.DataFrame:
    """(id, cluster, medoid) of one block of rows by k-medoids under pairs that must not (hard) and should not (relaxed) share a cluster; for use in
    applyInPandas on bounded blocks.

    Three tiers: the nearest cluster without a conflict, the nearest without a hard one, a cluster of its own. k is tried from three under to three over
    rows / target and chosen by silhouette less a tenth for every cluster of fewer than `least` or more than `most` rows; then clusters above `most` are
    split in two and clusters under `least` join the nearest one, by mean distance, that no hard pair forbids.
    """
    v = np.array(block[vector].tolist(), dtype=float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    d = 1 - v @ v.T
    np.fill_diagonal(d, 0.0)
    n = len(v)
    relaxed = np.zeros((n, n), bool) if relaxed is None else relaxed
    middle = max(2, -(-n // int(target)))
    best, top = np.zeros(n, int), -np.inf
    for k in range(max(2, middle - 3), middle + 4):
        if k < n:
            label = _medoid_rounds(d, hard, relaxed, k, np.random.default_rng(seed))
            size = np.bincount(label)
            score = silhouette_of(d, label) if 1 < len(size) < n else -1.0
            score -= 0.1 * ((size < least) | (size > most)).sum()
            if score > top:
                best, top = label, score
    if n > 1 and top == -np.inf:
        best = _medoid_rounds(d, hard, relaxed, 1, np.random.default_rng(seed))
    label = best.copy()
    for c in range(label.max() + 1):
        g = np.flatnonzero(label == c)
        if len(g) > most:
            halves = _medoid_rounds(d[np.ix_(g, g)], hard[np.ix_(g, g)], relaxed[np.ix_(g, g)], 2, np.random.default_rng(seed))
            for h in range(1, halves.max() + 1):
                label[g[halves == h]] = label.max() + 1
    for c in range(label.max() + 1):
        g = np.flatnonzero(label == c)
        if not 0 < len(g) < least:
            continue
        names, size = np.unique(label, return_counts=True)
        open_ = [x for x in names[size >= least] if x != c and not hard[np.ix_(g, label == x)].any()]
        if open_:
            label[g] = min(open_, key=lambda x: (d[np.ix_(g, label == x)].mean(), x))
    label = np.unique(label, return_inverse=True)[1]
    ids = block[id_col].to_numpy()
    groups = [np.flatnonzero(label == c) for c in range(label.max() + 1)]
    medoid = np.array([ids[g[int(d[np.ix_(g, g)].sum(axis=1).argmin())]] for g in groups])
    return pd.DataFrame({id_col: ids, "cluster": label, "medoid": medoid[label]})


def average_linkage(distance: np.ndarray, threshold: float, sizes: np.ndarray | None = None) -> np.ndarray:
    """Labels of average-linkage clustering cut at a threshold, for bounded matrices; sizes: rows that each starting group stands for."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if sizes is None else sizes.astype(float).copy()
    label = np.arange(n)
    for _ in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        if d[i, j] > threshold:
            break
        i, j = min(i, j), max(i, j)
        mixed = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = mixed, mixed
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1] if n else label


def linked_groups(rows: DataFrame, group: str, id_col: str, vector: str, threshold: float, most: int = 512) -> DataFrame:
    """Rows (id, group, cluster): average-linkage clusters of each group by cosine distance; cluster is the smallest id.

    Up to `most` rows of a group are one exact clustering. Larger groups are clustered in blocks, and the clusters of all blocks then go on as sums of
    directions, whose inner products give the exact mean distances between clusters, block by block in other cuts until a round joins nothing more.
    """
    out = f"{group} {rows.schema[group].dataType.simpleString()}, node {rows.schema[id_col].dataType.simpleString()}, parent {rows.schema[id_col].dataType.simpleString()}, n double, total array<double>"

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        total, n, ids = np.array(pdf["total"].tolist(), dtype=float).reshape(len(pdf), -1), pdf["n"].to_numpy(), pdf["node"].to_numpy()
        label = average_linkage(1 - total @ total.T / np.outer(n, n), threshold, n)
        first = pd.Series(ids).groupby(label).min().to_numpy()
        sums = np.zeros((len(first), total.shape[1]))
        np.add.at(sums, label, total)
        return pd.DataFrame({group: pdf[group].to_numpy(), "node": ids, "parent": first[label], "n": np.bincount(label, weights=n)[label], "total": [sums[k].tolist() for k in label]})

    nodes = rows.select(group, F.col(id_col).alias("node"), F.lit(1.0).alias("n"), vectors.unit(F.col(vector)).alias("total"))
    names, seed, quiet = rows.select(group, F.col(id_col).alias("start"), F.col(id_col).alias("node")), 0, 0
    while True:
        cut = in_blocks(nodes, group, "node", most, seed)
        done = materialise(cut.groupBy(group, "block").applyInPandas(link, out), "linked")
        names = materialise(names.join(done.select(group, "node", "parent"), [group, "node"]).select(group, "start", F.col("parent").alias("node")), "names")
        fresh = done.where("node = parent").select(group, "node", "n", "total")
        sizes = done.groupBy(group).agg(F.count("*").alias("rows"), F.sum((F.col("node") == F.col("parent")).cast("int")).alias("left"))
        open_ = sizes.where(F.col("rows") > most).agg(F.sum("rows").alias("rows"), F.sum("left").alias("left")).collect()[0]
        if open_["rows"] is None:
            break
        quiet = quiet + 1 if open_["rows"] == open_["left"] else 0
        if quiet == 2:
            break
        nodes, seed = fresh, seed + 1
    return names.select(F.col("start").alias(id_col), group, F.col("node").alias("cluster"))


def in_blocks(rows: DataFrame, group: str, id_col: str, most: int = 512, seed: int = 0) -> DataFrame:
    """rows with a block number inside their group, so that every (group, block) holds about `most` rows at most."""
    n = rows.groupBy(group).agg(F.count("*").alias("__n"))
    parts = F.ceil(F.col("__n") / most)
    return rows.join(n, group).withColumn("block", F.pmod(F.xxhash64(id_col, F.lit(seed)), parts).cast("int")).drop("__n")


def ranked_within(rows: DataFrame, group: str, *order: Column, name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
