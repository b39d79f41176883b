"""Clusters of mutually similar vectors: neighbour descent, modularity communities, exact membership.

A bounded codebook brings similar rows into common blocks. In a block the nearest-neighbour graph is built by neighbour descent
and split into communities by modularity. A community is handed on as its size and the sum of its directions: the sum of all
cosines between two communities is the inner product of their sums, so the aggregated graph of the next round of modularity needs
no rows. Rounds repeat until they join nothing more. Rows keep the community that the graph gave them; then the communities are held to the
definition of a cluster, exactly, until nothing moves. Copies of a direction are one class from the map side on.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklattice.llm import vectors as V
from tracklattice.session import materialise

#: rows that a block is meant to hold; a cell of more is split along random hyperplanes, so near rows stay together
BLOCK = 2_048
#: neighbours of a row in the graph
NEIGHBOURS = 12
#: clusters that one broadcast may hold (64 elements: 26 MB); more raise an error, none are dropped
MAX_CENTRES = 50_000


def neighbour_descent(u: np.ndarray, k: int = NEIGHBOURS, rounds: int = 10, pool: int = 40, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Approximate k nearest neighbours within u: lists start at random and take in neighbours of neighbours, both ways."""
    n = len(u)
    u = u.astype(np.float32)
    if n <= 4 * k:
        s = u @ u.T
        np.fill_diagonal(s, -2)
        k = min(k, n - 1)
        near = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return near, np.take_along_axis(s, near, 1)
    rng = np.random.default_rng(seed)
    near = (np.arange(n)[:, None] + rng.integers(1, n, size=(n, k))) % n
    sims = np.einsum("nkd,nd->nk", u[near], u)
    for _ in range(rounds):
        back = np.full((n, k), -1)
        flat, owner = near.ravel(), np.repeat(np.arange(n), k)
        mix = rng.permutation(len(flat))
        order = mix[np.argsort(flat[mix], kind="stable")]
        target = flat[order]
        place = np.arange(len(order)) - np.searchsorted(target, target)
        fits = place < k
        back[target[fits], place[fits]] = owner[order][fits]
        both = np.concatenate([near, np.where(back < 0, near, back)], axis=1)
        first = rng.integers(0, 2 * k, size=(n, pool))
        second = rng.integers(0, 2 * k, size=(n, pool))
        cand = np.concatenate([both[np.take_along_axis(both, first, 1), second], both[:, k:]], axis=1)
        changed = 0
        for i in range(0, n, 512):
            rows = slice(i, i + 512)
            c = cand[rows]
            cs = np.matmul(u[c], u[rows][:, :, None])[:, :, 0]
            ids = np.concatenate([near[rows], c], axis=1)
            ss = np.concatenate([sims[rows], cs], axis=1)
            ss[ids == np.arange(i, i + len(ids))[:, None]] = -2
            o = np.argsort(ids, axis=1, kind="stable")
            ids, ss = np.take_along_axis(ids, o, 1), np.take_along_axis(ss, o, 1)
            ss[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2
            top = np.argpartition(-ss, k - 1, axis=1)[:, :k]
            fresh = np.take_along_axis(ss, top, 1)
            changed += int((fresh.min(axis=1) > sims[rows].min(axis=1) + 1e-7).sum())
            near[rows], sims[rows] = np.take_along_axis(ids, top, 1), fresh
        if changed < 0.01 * n:
            break
    return near, sims


def communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, sweeps: int = 12) -> np.ndarray:
    """Modularity communities of a weighted graph: moves of single nodes, then of whole communities, while modularity rises."""
    label = np.arange(n)
    loops = np.zeros(n)
    while True:
        size = len(loops)
        links: list[dict[int, float]] = [defaultdict(float) for _ in range(size)]
        for i, j, x in zip(a.tolist(), b.tolist(), w.tolist()):
            if i != j:
                links[i][j] += x
                links[j][i] += x
        degree = [2 * loops[i] + sum(links[i].values()) for i in range(size)]
        total = sum(degree)
        if total <= 0:
            return label
        own = list(range(size))
        weight = degree[:]
        moved_ever = False
        for _ in range(sweeps):
            moved = 0
            for i in range(size):
                if not links[i]:
                    continue
                to: dict[int, float] = defaultdict(float)
                for j, x in links[i].items():
                    to[own[j]] += x
                here = own[i]
                weight[here] -= degree[i]
                best, gain = here, to.get(here, 0.0) - weight[here] * degree[i] / total
                for c, x in to.items():
                    g = x - weight[c] * degree[i] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                weight[best] += degree[i]
                if best != here:
                    own[i] = best
                    moved += 1
            moved_ever |= moved > 0
            if moved <= size // 200:
                break
        if not moved_ever:
            return label
        names, own_at = np.unique(np.array(own), return_inverse=True)
        label = own_at[label]
        fresh = np.zeros(len(names))
        np.add.at(fresh, own_at, loops)
        ca, cb = own_at[a], own_at[b]
        inside = ca == cb
        np.add.at(fresh, ca[inside], np.where(a[inside] == b[inside], 0.0, w[inside]))
        lo, hi = np.minimum(ca, cb)[~inside], np.maximum(ca, cb)[~inside]
        pair, at = np.unique(lo.astype(np.int64) * len(names) + hi, return_inverse=True)
        a, b = (pair // len(names)).astype(int), (pair % len(names)).astype(int)
        w = np.bincount(at, weights=w[~inside], minlength=len(pair)) if len(pair) else np.zeros(0)
        loops = fresh


def join_close(sums: np.ndarray, close: float) -> np.ndarray:
    """Labels after joining sums whose directions are nearer than close, largest first; repeated until none are."""
    label = np.arange(len(sums))
    while len(sums) > 1:
        length = np.linalg.norm(sums, axis=1)
        u = sums / np.maximum(length, 1e-12)[:, None]
        to = np.full(len(sums), -1)
        leaders: list[int] = []
        for i in np.argsort(-length, kind="stable"):
            if leaders:
                s = u[leaders] @ u[i]
                j = int(s.argmax())
                if s[j] >= close:
                    to[i] = j
                    continue
            to[i] = len(leaders)
            leaders.append(int(i))
        if len(leaders) == len(sums):
            break
        fresh = np.zeros((len(leaders), sums.shape[1]))
        np.add.at(fresh, to, sums)
        label, sums = to[label], fresh
    return label


def summarise(u: np.ndarray, sums: np.ndarray, edge: float, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Community label of each node and the nodes' degree inside it. Nodes without a neighbour of cosine edge stay alone."""
    if len(u) < 2:
        return np.zeros(len(u), int), np.zeros(len(u))
    near, sims = neighbour_descent(u)
    a, b = np.repeat(np.arange(len(u)), near.shape[1]), near.ravel()
    keep = sims.ravel() >= edge
    a, b = a[keep], b[keep]
    key = np.unique(np.minimum(a, b).astype(np.int64) * len(u) + np.maximum(a, b))
    a, b = (key // len(u)).astype(int), (key % len(u)).astype(int)
    w = np.einsum("ij,ij->i", sums[a], sums[b]) if weighted else np.einsum("ij,ij->i", u[a], u[b])
    label = communities(len(u), a, b, np.maximum(w, 0))
    inner = label[a] == label[b]
    degree = np.bincount(a[inner], weights=w[inner], minlength=len(u)) + np.bincount(b[inner], weights=w[inner], minlength=len(u))
    return label, degree


def _nodes(keys: list[bytes], vectors: np.ndarray, sums: np.ndarray, counts: np.ndarray, edge: float, weighted: bool) -> tuple[np.ndarray, pd.DataFrame]:
    """(node of each row, table (node, n, total) of the communities); a node is named after the smallest key of its community. Rows alone are nodes as well."""
    label, _ = summarise(vectors, sums, edge, weighted)
    names = np.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], dtype=np.int64)
    size = int(label.max()) + 1 if len(label) else 0
    total = np.zeros((size, sums.shape[1]))
    np.add.at(total, label, sums)
    first = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(first, label, names)
    n = np.bincount(label, weights=counts, minlength=size).astype(np.int64)
    return first[label], pd.DataFrame({"node": first, "n": n, "total": [t.tobytes() for t in total]})


def _directions(sums: np.ndarray) -> np.ndarray:
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)


def _slices(n: int, most: int) -> list[slice]:
    """Cuts n rows into equal slices of at most `most`."""
    parts = max(1, ceil(n / most))
    at = np.linspace(0, n, parts + 1).astype(int)
    return [slice(a, b) for a, b in zip(at, at[1:])]


class Blocks:
    """Where a direction goes: the cell of a codebook, halved along random hyperplanes as often as its rows ask for, then pieces of parts that stay large."""

    def __init__(self, centres: np.ndarray, dim: int, depth: np.ndarray | None = None, pieces: dict[tuple[int, int], int] | None = None):
        self.centres = centres
        self.depth = np.zeros(len(centres), np.int64) if depth is None else depth
        self.pieces = pieces or {}
        self.planes = np.random.default_rng(9).standard_normal((dim, max(1, int(self.depth.max(initial=0)))))

    def cells(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = V.nearest_cells(u, self.centres, 1)[:, 0]
        deep = self.depth[cell]
        part = np.zeros(len(u), dtype=np.int64)
        if deep.any():
            signs = ((u - self.centres[cell]) @ self.planes > 0).astype(np.int64)
            for d in range(self.planes.shape[1]):
                part = np.where(deep > d, part * 2 + signs[:, d], part)
        return cell, part

    def piece(self, cell: np.ndarray, part: np.ndarray, keys: list[bytes]) -> np.ndarray:
        if not self.pieces:
            return np.zeros(len(cell), np.int64)
        return np.array([int.from_bytes(k[8:], "little") % self.pieces.get((c, p), 1) for c, p, k in zip(cell.tolist(), part.tolist(), keys)], dtype=np.int64)


def _once(u: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(first row, key, rows, smallest id) of each direction of a batch: copies leave the map side as one row."""
    keys = V.direction_key(u)
    at, back = {}, np.empty(len(keys), np.int64)
    for i, k in enumerate(keys):
        back[i] = at.setdefault(k, len(at))
    first = np.unique(back, return_index=True)[1]
    smallest = np.full(len(at), np.iinfo(np.int64).max)
    np.minimum.at(smallest, back, ids)
    return first, list(at), np.bincount(back, minlength=len(at)), smallest


def _part_counts(src: DataFrame, blocks, dim: int) -> DataFrame:
    """Rows (cell, part, n): directions of each part, copies within a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            _, rows = V.matrix(batch.column(1), dim)
            if len(rows):
                u = V.unit(rows)
                first = _once(u, rows, np.zeros(len(u), np.int64))[0]
                for pair in zip(*map(np.ndarray.tolist, blocks.value.cells(u[first]))):
                    total[pair] += 1
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in total], pa.int32()), pa.array([p for _, p in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cell", "part", "n"])

    return src.mapInArrow(run, "cell int, part long, n long").groupBy("cell", "part").agg(F.sum("n").alias("n"))


def communities_of(src: DataFrame, dim: int, n: int, threshold: float, close: float) -> tuple[DataFrame, DataFrame]:
    """(classes, nodes): classes (key, raw, n, first, node) holds every direction with the community of its block's graph, nodes (node, n, total) all communities."""
    spark = src.sparkSession
    cells = min(V.MAX_CELLS, ceil(n / (BLOCK // 2)))
    centres = V.fit_codebook(V.sample_matrix(src, "v", dim, n, cells), cells)
    if not len(centres):  # no clean vector at all
        return spark.createDataFrame([], "key binary, raw binary, n long, first long, node long"), spark.createDataFrame([], "node long, n long, total binary")
    flat = spark.sparkContext.broadcast(Blocks(centres, dim))  # at most MAX_CELLS rows
    depth = np.zeros(len(centres), dtype=np.int64)
    for r in _part_counts(src, flat, dim).collect():  # at most MAX_CELLS rows
        depth[r["cell"]] = max(0, ceil(np.log2(max(1, r["n"] / (1.5 * BLOCK)))))
    blocks = Blocks(centres, dim, depth)
    if depth.any():
        # parts that stay large, as near-copies fall on one side of every plane: fewer than rows / (2 * BLOCK)
        large = _part_counts(src, spark.sparkContext.broadcast(blocks), dim).where(F.col("n") > 2 * BLOCK).collect()
        blocks.pieces = {(r["cell"], r["part"]): ceil(r["n"] / (2 * BLOCK)) for r in large}
    sent = spark.sparkContext.broadcast(blocks)
    edge = threshold * threshold  # two rows at the rim of one cluster

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = V.matrix(batch.column(1), dim)
            if not len(rows):
                continue
            u = V.unit(rows)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64)
            first, keys, count, smallest = _once(u, rows, ids)
            cell, part = sent.value.cells(u[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(part), pa.array(sent.value.piece(cell, part, keys)), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in rows[first]], pa.binary()), pa.array(count), pa.array(smallest)],
                names=["cell", "part", "piece", "key", "raw", "n", "first"],
            )

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.groupby("key", sort=True).agg(raw=("raw", "first"), n=("n", "sum"), first=("first", "min")).reset_index()
        outs = []
        for rows in _slices(len(pdf), 2 * BLOCK):
            part = pdf.iloc[rows]
            u = V.unit(np.frombuffer(b"".join(part["raw"]), dtype=np.float32).reshape(-1, dim))
            count = part["n"].to_numpy()
            node, table = _nodes(part["key"].tolist(), u, u * count[:, None], count, edge, False)
            outs += [part.assign(node=node), table]
        return pd.concat(outs)[["key", "raw", "n", "first", "node", "total"]].astype({"first": "Int64"})

    shape = "key binary, raw binary, n long, first long, node long, total binary"
    found = src.mapInArrow(spread, "cell int, part long, piece long, key binary, raw binary, n long, first long").groupBy("cell", "part", "piece").applyInPandas(link, shape)
    found = materialise(found, "communities")
    return found.where("total is null").select("key", "raw", "n", "first", "node"), found.where("total is not null").select("node", "n", "total")


def _merged(nodes: DataFrame, centres: np.ndarray, dim: int, close: float) -> DataFrame:
    """Rows (node, parent) for the nodes, and (parent as node, n, total) for the communities of communities, after one round in the cells of a codebook."""
    book = nodes.sparkSession.sparkContext.broadcast(centres)  # at most MAX_CELLS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = _directions(np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.float64).reshape(-1, dim))
                yield pa.RecordBatch.from_arrays([pa.array(V.nearest_cells(u, book.value, 1)[:, 0]), *batch.columns], names=["cell", "node", "n", "total"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        outs = []
        for rows in _slices(len(pdf), 4 * BLOCK):
            part = pdf.iloc[rows]
            sums = np.frombuffer(b"".join(part["total"]), dtype=np.float64).reshape(-1, dim)
            keys = [int(x).to_bytes(8, "little", signed=True) for x in part["node"]]
            parent, table = _nodes(keys, _directions(sums), sums, part["n"].to_numpy(), close, True)
            outs += [pd.DataFrame({"node": part["node"].to_numpy(), "parent": parent}), table]
        return pd.concat(outs)[["node", "parent", "n", "total"]].astype({"parent": "Int64", "n": "Int64"})

    return nodes.mapInArrow(run, "cell int, node long, n long, total binary").groupBy("cell").applyInPandas(link, "node long, parent long, n long, total binary")


def community_labels(src: DataFrame, dim: int, n: int, threshold: float, close: float, least: int) -> tuple[DataFrame, np.ndarray]:
    """(classes with their community as c, or null for communities that are no cluster; sums of the communities' directions).

    The communities of the blocks meet in rounds of modularity over codebooks of their own, each round cut in other cells, until a round joins next to
    nothing. Communities of one row take part in all of them. What then holds at least `least` rows is joined where directions are nearer than `close`.
    """
    spark = src.sparkSession
    classes, nodes = communities_of(src, dim, n, threshold, close)
    names = nodes.select(F.col("node").alias("start"), "node")
    count, quiet, seed = nodes.count(), 0, 0
    while count > 1 and quiet < 2:
        cells = min(V.MAX_CELLS, ceil(count / (2 * BLOCK)))
        limit = min(V.CODEBOOK_SAMPLE, max(V.LEAST_SAMPLE, V.SAMPLE_CELL * cells))
        picked = nodes.where(F.rand(seed) < min(1.0, 1.2 * limit / count)).limit(limit).toPandas()
        sample = _directions(np.frombuffer(b"".join(picked["total"]), dtype=np.float64).reshape(-1, dim)).astype(np.float32)
        centres = V.fit_codebook(sample, cells, seed=seed) if len(sample) else np.eye(1, dim, dtype=np.float32)
        round_ = materialise(_merged(nodes, centres, dim, close), "round")
        moves = round_.where("total is null").select("node", "parent")
        names = materialise(names.join(moves, "node").select("start", F.col("parent").alias("node")), "names")
        nodes = round_.where("total is not null").select("node", "n", "total")
        fewer = nodes.count()
        quiet = quiet + 1 if fewer > 0.98 * count else 0
        if len(centres) == 1 and fewer == count:
            break
        count, seed = fewer, seed + 1
    # communities under `least` rows are no clusters; their rows may still lie near one, which the exact check sees
    big = nodes.where(F.col("n") >= least)
    if big.count() > 2 * MAX_CENTRES:
        raise ValueError("more communities than MAX_CENTRES; raise the threshold or run on parts of the table")
    last = big.orderBy("node").toPandas()
    if not len(last):
        return classes.withColumn("c", F.lit(None).cast("long")), np.zeros((0, dim))
    sums = np.frombuffer(b"".join(last["total"]), dtype=np.float64).reshape(-1, dim)
    label = join_close(sums, close)
    total = np.zeros((label.max() + 1, dim))
    np.add.at(total, label, sums)
    ids = spark.createDataFrame(pd.DataFrame({"node": last["node"], "c": label.astype(np.int64)}))  # at most 2 * MAX_CENTRES rows
    of_node = names.join(F.broadcast(ids), "node").select(F.col("start").alias("node"), "c")
    return classes.join(of_node, "node", "left").drop("node"), total


def _nearest(u: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    s = u @ centres.T
    own = s.argmax(axis=1)
    return own, s[np.arange(len(u)), own] >= threshold


def _sum_pass(classes: DataFrame, dim: int, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the rows nearest to each centre; partitions send one row a centre."""
    book = classes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
        for batch in V.batches_of(batches):
            u, count = _class_rows(batch, dim)
            if len(u):
                own, ok = _nearest(u, book.value, threshold)
                np.add.at(n, own[ok], count[ok])
                np.add.at(total, own[ok], u[ok] * count[ok, None])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array([t.tobytes() for t in total[at]], pa.binary())], names=["c", "n", "total"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": [pdf["c"].iloc[0]], "n": [pdf["n"].sum()], "total": [np.frombuffer(b"".join(pdf["total"])).reshape(-1, dim).sum(axis=0).tobytes()]})

    shape = "c long, n long, total binary"
    got = classes.select("raw", "n").mapInArrow(run, shape).groupBy("c").applyInPandas(fold, shape).toPandas()
    counts, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
    for c, n, total in got.itertuples(index=False):
        counts[c], sums[c] = n, np.frombuffer(total)
    book.unpersist()
    return counts, sums


def _class_rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    if not batch.num_rows:
        return np.zeros((0, dim)), np.zeros(0, np.int64)
    rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.float32).reshape(-1, dim)
    return V.unit(rows), batch.column(1).to_numpy()


def similarity_clusters(
    df: DataFrame, id_col: str, column: str, dim: int | None = None, threshold: float = 0.7, least: int = 10, close: float = 0.8, rounds: int = 60
) -> DataFrame:
    """Rows (medoid_index, member_index, degree, size), one for each member of each cluster; degree is the sum of its cosines to
    the other members, its weighted degree inside the community, and the medoid is the member of the highest degree, the smaller id on ties.

    A cluster is a community of the neighbour graph, held to the definition: at least `least` rows with a cosine of at least `threshold` to its mean
    direction and less to any other. Rows of a community that miss it move to the community whose mean is nearest, or to none, until nothing
    moves; directions nearer than `close` are one cluster. More than `rounds` rounds raise an error. Vectors that are null, all zero, not finite or
    of another number of elements than dim (by default the most frequent one) belong to none, as do rows far from all clusters. Copies are members like any
    row and travel as one class from the map side on. An empty table gives no rows; a repeated id counts as often as it stands there. Other columns are not read.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v"))
    nothing = spark.createDataFrame([], "medoid_index long, member_index long, degree double, size long")
    n = src.count()
    dim = V.common_dim(src, "v") if dim is None else dim
    if not n or not dim:
        return nothing
    classes, sums = community_labels(src, dim, n, threshold, close, least)
    if not len(sums):
        return nothing
    classes = materialise(classes, "classes")
    settled, place = False, np.arange(len(sums))  # place: where a community's sum is now, -1 for none
    for _ in range(rounds):
        counts, fresh = _sum_pass(classes, dim, _directions(sums), threshold)
        big = counts >= least
        label = join_close(fresh[big], close)
        kept = np.zeros((label.max() + 1 if len(label) else 0, dim))
        np.add.at(kept, label, fresh[big])
        settled = kept.shape == sums.shape and bool(np.allclose(_directions(kept), _directions(sums), atol=1e-9))
        move = np.full(len(sums), -1)
        move[big] = label
        place = np.where(place >= 0, move[place], -1)
        sums = kept
        if settled or not len(sums):
            break
    if not len(sums):
        return nothing
    if not settled:
        raise RuntimeError("clusters did not settle; raise rounds")
    centres = _directions(sums)
    counts, sums = _sum_pass(classes, dim, centres, threshold)
    book = spark.sparkContext.broadcast((centres, sums, counts))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, total, size = book.value
        for batch in V.batches_of(batches):
            u, _ = _class_rows(batch, dim)
            if len(u):
                best, ok = _nearest(u, c, threshold)
                said = batch.column(4).fill_null(-1).to_numpy()
                own = np.where(said >= 0, place[said], -1)
                # a row stays in its community while no other mean is nearer
                own = np.where((own >= 0) & (np.einsum("ij,ij->i", u, c[own]) >= np.einsum("ij,ij->i", u, c[best])), own, best)
                ok &= size[own] >= least
                degree = np.round(np.einsum("ij,ij->i", u, total[own]) - 1.0, 9)
                kept = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([batch.column(2).take(kept), batch.column(1).take(kept), batch.column(3).take(kept), pa.array(own[ok]), pa.array(degree[ok]), pa.array(size[own[ok]])], names=["key", "n", "first", "c", "degree", "size"])

    held = classes.select("raw", "n", "key", "first", "c").mapInArrow(check, "key binary, n long, first long, c long, degree double, size long")
    held = materialise(held, "members")
    medoids = held.groupBy("c").agg(F.min_by("first", F.struct((-F.col("degree")).alias("d"), "first")).alias("medoid_index"))
    named = held.join(F.broadcast(medoids), "c").select("key", "n", "medoid_index", "degree", "size")  # medoids: at most MAX_CENTRES rows
    rows = src.mapInArrow(_keyed(dim), "key binary, id long")
    # a direction that holds a thousandth of the rows is joined by broadcast: at most 1,000 of them
    hot = F.broadcast(named.where(F.col("n") >= max(2.0, n / 1000)).drop("n"))
    joined = rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(named.where(F.col("n") < max(2.0, n / 1000)).drop("n"), "key"))
    return joined.select("medoid_index", F.col("id").alias("member_index"), "degree", "size")


def _keyed(dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.batches_of(batches):
            at, rows = V.matrix(batch.column(1), dim)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(V.direction_key(V.unit(rows)), pa.binary()), batch.column(0).take(pa.array(at))], names=["key", "id"])

    return run


def typical_members(members: DataFrame, top: int = 5) -> DataFrame:
    """Rows (medoid_index, size, typical ARRAY): the `top` members of the highest degree of each cluster, the medoid first.

    Each of 32 slices of a cluster is cut to its best `top` before slices meet, so no task holds a whole cluster.
    """
    pick = lambda c: F.slice(F.array_sort(c), 1, top)
    sliced = members.withColumn("slice", F.pmod(F.xxhash64("member_index"), F.lit(32)))
    w = Window.partitionBy("medoid_index", "slice").orderBy(F.desc("degree"), "member_index")
    best = sliced.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    packed = best.groupBy("medoid_index").agg(F.max("size").alias("size"), pick(F.collect_list(F.struct((-F.col("degree")).alias("d"), F.col("member_index").alias("m")))).alias("t"))
    return packed.select("medoid_index", "size", F.col("t.m").alias("typical"))
