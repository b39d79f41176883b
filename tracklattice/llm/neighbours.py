"""Most similar vectors for every vector, by randomly rotated one-bit codes.

Rows are spread over the cells of a codebook: each goes to its nearest cell as an indexed row and to a few near cells as a
query. Inside a block of a cell the residual of every indexed row, rotated at random, is kept as one bit an element with two
correction scalars; the residual of a query as four bit planes. Bit counts give an unbiased estimate of the inner product with a
known error bound; only pairs whose upper bound reaches the threshold and the k-th best lower bound are computed exactly.
Copies of one direction are one class from the map side on and come back as rows at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklattice.llm import vectors as V

#: near cells that a row is sent to as a query, beside its own
PROBES = 2
#: rows of a cell in one block
BLOCK = 4_096
#: width of the confidence bound of an estimate, in standard errors
EPSILON = 2.6
PLANES = 4


def one_bit_codes(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (n x words of 64) and the cosine of each row to its own code."""
    n, dim = rotated.shape
    words = -(-dim // 64)
    bits = np.zeros((n, words * 64), dtype=np.uint8)
    bits[:, :dim] = rotated > 0
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return packed, np.abs(rotated).sum(axis=1) / sqrt(dim)


def bit_planes(rotated: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query side: PLANES packed bit planes of values rounded at random to 2^PLANES levels, their lower end and step."""
    n, dim = rotated.shape
    low = rotated.min(axis=1, keepdims=True)
    step = np.maximum((rotated.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-12)
    level = np.floor((rotated - low) / step + np.random.default_rng(seed).random(rotated.shape)).astype(np.uint8)
    level = np.minimum(level, 2**PLANES - 1)
    words = -(-dim // 64)
    planes = np.zeros((PLANES, n, words), dtype=np.uint64)
    for j in range(PLANES):
        bits = np.zeros((n, words * 64), dtype=np.uint8)
        bits[:, :dim] = (level >> j) & 1
        planes[j] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return planes, low[:, 0], step[:, 0]


def estimate(codes: np.ndarray, own: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, dim: int) -> np.ndarray:
    """Estimated inner products (queries x indexed rows) of unit residuals from packed bits and correction scalars."""
    n_query, n_rows = planes.shape[1], len(codes)
    common = np.zeros((n_query, n_rows), dtype=np.uint16 if codes.shape[1] <= 64 else np.uint32)
    both, bits = np.empty((n_query, n_rows), np.uint64), np.empty((n_query, n_rows), np.uint8)
    for w in range(codes.shape[1]):
        part = np.zeros((n_query, n_rows), np.uint16)
        for j in range(PLANES - 1, -1, -1):  # the highest plane first: each step doubles what is there
            np.bitwise_and(planes[j][:, w][:, None], codes[:, w][None, :], out=both)
            np.bitwise_count(both, out=bits)
            part += part
            part += bits
        common += part
    ones = np.bitwise_count(codes).sum(axis=1).astype(np.float32)
    total = np.zeros(n_query)
    for j in range(PLANES):
        total += (1 << j) * np.bitwise_count(planes[j]).sum(axis=1)
    # sum of sign * value = 2 * (sum of values at one bits) - (sum of values)
    guess = common.astype(np.float32)
    guess *= (2 * step).astype(np.float32)[:, None]
    guess += (2 * low).astype(np.float32)[:, None] * ones[None, :]
    guess -= (step * total + low * dim).astype(np.float32)[:, None]
    guess /= (sqrt(dim) * own).astype(np.float32)[None, :]
    return guess


def block_pairs(q: np.ndarray, x: np.ndarray, centre: np.ndarray, k: int, least: float, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query row, indexed row, cosine) of one block that may be among the k best of either side.

    same[i] is the place of query i among the indexed rows, or -1: a class is no neighbour of itself.
    """
    dim = x.shape[1]
    turn = V.rotation(dim)
    rx, rq = (x - centre) @ turn, (q - centre) @ turn
    lx, lq = np.linalg.norm(rx, axis=1), np.linalg.norm(rq, axis=1)
    rx /= np.maximum(lx, 1e-9)[:, None]
    rq /= np.maximum(lq, 1e-9)[:, None]
    codes, own = one_bit_codes(rx)
    own = np.maximum(own, 1e-3)
    wrong = EPSILON * np.sqrt(np.maximum(1 - own**2, 0)) / own / sqrt(max(1, dim - 1))
    found_q, found_x, found_s = [], [], []
    for begin in range(0, len(q), 512):
        rows = slice(begin, begin + 512)
        planes, low, step = bit_planes(rq[rows])
        guess = estimate(codes, own, planes, low, step, dim)
        slack = wrong[None, :] + EPSILON * step[:, None] / 2
        scale = lq[rows][:, None] * lx[None, :]
        # cosine of unit vectors from the residuals: 1 - |q - x|^2 / 2
        base = 1 - (lq[rows][:, None] ** 2 + lx[None, :] ** 2) / 2
        upper = base + scale * np.minimum(guess + slack, 1)
        lower = base + scale * np.maximum(guess - slack, -1)
        me = same[rows]
        mine = np.flatnonzero(me >= 0)
        upper[mine, me[mine]] = lower[mine, me[mine]] = -2
        need_q = np.full(len(upper), least)
        if lower.shape[1] > k:
            need_q = np.maximum(need_q, -np.partition(-lower, k - 1, axis=1)[:, k - 1])
        keep = upper >= need_q[:, None]
        if least > -1:  # an indexed row may have the query among its best, too
            keep |= upper >= np.maximum(least, _kth(lower.T, k, least))[None, :]
        a, b = np.nonzero(keep)
        for i in range(0, len(a), 65_536):
            aa, bb = a[i : i + 65_536], b[i : i + 65_536]
            s = np.einsum("ij,ij->i", q[rows][aa], x[bb])
            ok = s >= least
            found_q.append(aa[ok] + begin), found_x.append(bb[ok]), found_s.append(s[ok])
    if not found_q:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(found_q), np.concatenate(found_x), np.concatenate(found_s)


def _kth(lower: np.ndarray, k: int, least: float) -> np.ndarray:
    if lower.shape[1] <= k:
        return np.full(len(lower), least)
    return -np.partition(-lower, k - 1, axis=1)[:, k - 1]


def best_of(side: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Mask of the pairs that are among the k best of their side; ties at the k-th place are all kept."""
    if not len(side):
        return np.zeros(0, bool)
    order = np.lexsort((-score, side))
    s, v = side[order], score[order]
    first = np.r_[True, s[1:] != s[:-1]]
    starts = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    kth = np.minimum(starts + k - 1, np.r_[starts[1:], len(s)] - 1)
    mask = np.zeros(len(s), bool)
    mask[order] = v >= v[kth][group] - 1e-12
    return mask


def nearest_pairs(
    df: DataFrame, id_col: str, column: str, k: int, least: float = -1.0, dim: int | None = None, probes: int = PROBES, label: str = ""
) -> DataFrame:
    """Rows (kind, a, b, similarity): b is among the k rows most similar to a by cosine, ties going to the smaller id.

    Vectors that are null, all zero, of another number of elements (dim, by default the most frequent one) or not finite take no
    part. Rows of the same direction have similarity 1. id_col should be unique; a repeated id is one row. Only pairs of a
    similarity of at least `least` come out. An empty table gives no rows. Other columns are not read.

    Every row is indexed; the codebook alone is fitted on a bounded sample. Per row one vector goes to its own cell and `probes`
    to near ones, the copies of a direction within an input partition go once. A cell is split into blocks of BLOCK classes.
    """
    spark = df.sparkSession
    kind = label or column
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v"))
    n = src.count()
    dim = V.common_dim(src, "v") if dim is None else dim
    empty = spark.createDataFrame([], "kind string, a long, b long, similarity double")
    if not n or not dim:
        return empty
    cells = max(1, min(V.MAX_CELLS, round(1.2 * sqrt(n))))
    centres = V.fit_codebook(V.sample_matrix(src, "v", dim, n, cells), cells)
    if not len(centres):
        return empty
    book = spark.sparkContext.broadcast(centres)  # at most MAX_CELLS rows

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in V.batches_of(batches):
            _, rows = V.matrix(batch.column(1), dim)
            if not len(rows):
                continue
            u = V.unit(rows)
            keys = V.direction_key(u)
            fresh = []
            for i, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            if not fresh:
                continue
            rows, u = rows[fresh], u[fresh]
            near = V.nearest_cells(u, book.value, probes + 1)
            m = near.shape[1]
            raw = [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.T.ravel()), pa.array(np.repeat(np.arange(m) == 0, len(rows))), pa.array([keys[i] for i in fresh] * m, pa.binary()), pa.array(raw * m, pa.binary())],
                names=["cell", "home", "key", "raw"],
            )

    sent = src.select("id", "v").mapInArrow(spread, "cell int, home boolean, key binary, raw binary")

    # Home rows of a cell are cut in blocks by their key; queries go to every block of the cell. Most cells have one block.
    counted = src.select("id", "v").mapInArrow(_cell_counter(book, dim), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    blocks = {r["cell"]: ceil(r["n"] / BLOCK) for r in counted.where(F.col("n") > BLOCK).collect()}  # at most MAX_CELLS rows
    if blocks:
        many = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
        parts = F.coalesce(many[F.col("cell")], F.lit(1))
        sent = sent.withColumn(
            "block", F.explode(F.when(F.col("home"), F.array(F.pmod(F.xxhash64("key"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), (parts - 1).cast("int"))))
        )
        # an indexed row is a query of its own cell's other blocks as well
        again = sent.where(F.col("home") & (parts > 1)).select("cell", F.lit(False).alias("home"), "key", "raw", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("block"))
        sent = sent.unionByName(again)
    else:
        sent = sent.withColumn("block", F.lit(0))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("home", ascending=False, kind="stable").drop_duplicates("key")
        home = pdf["home"].to_numpy()
        keys = pdf["key"].to_numpy()
        u = V.unit(np.frombuffer(b"".join(pdf["raw"]), dtype=np.float32).reshape(-1, dim)) if len(pdf) else np.zeros((0, dim))
        x = u[home]
        if not len(x):
            return pd.DataFrame({"ka": [], "kb": [], "similarity": []})
        same = np.r_[np.arange(len(x)), np.full(len(u) - len(x), -1)]
        centre = book.value[int(pdf["cell"].iloc[0])].astype(np.float64)
        qi, xi, s = block_pairs(u, x, centre, k, least, same)
        fwd, back = best_of(qi, s, k), best_of(xi, s, k)
        names = keys[home]
        out = pd.DataFrame({"ka": np.r_[keys[qi[fwd]], names[xi[back]]], "kb": np.r_[names[xi[fwd]], keys[qi[back]]], "similarity": np.r_[s[fwd], s[back]]})
        return out

    found = sent.groupBy("cell", "block").applyInPandas(within, "ka binary, kb binary, similarity double").dropDuplicates(["ka", "kb"])

    # the first k + 1 ids and the number of rows of each class; partitions send at most k + 1 ids a class
    members = (
        src.mapInArrow(_first_ids(dim, k + 1), "key binary, ids array<long>")
        .groupBy("key")
        .agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    )
    by_class = found.join(members.select(F.col("key").alias("kb"), F.col("ids").alias("b_ids")), "kb").withColumn("first_b", F.col("b_ids")[0])
    ranked = by_class.withColumn("place", F.row_number().over(Window.partitionBy("ka").orderBy(F.desc("similarity"), "first_b"))).where(F.col("place") <= k)
    others = ranked.groupBy(F.col("ka").alias("key")).agg(F.collect_list(F.struct("similarity", "b_ids")).alias("near"))
    # all rows of a class see the same neighbours outside it, so only rows of the class come in again
    rows = src.mapInArrow(_all_keys(dim), "id long, key binary").dropDuplicates(["id"])
    lists = members.where(F.size("ids") > 1).join(others, "key", "full_outer").select("key", "ids", "near")
    own = F.transform(F.coalesce("ids", F.array().cast("array<long>")), lambda b: F.struct((-F.lit(1.0)).alias("s"), b.alias("b")))
    far = F.flatten(F.transform(F.coalesce("near", F.array().cast("array<struct<similarity:double,b_ids:array<long>>>")), lambda x: F.transform(x["b_ids"], lambda b: F.struct((-x["similarity"]).alias("s"), b.alias("b")))))
    ready = lists.select("key", F.array_sort(F.array_union(own, far)).alias("all"))
    joined = rows.join(ready, "key").select(F.col("id").alias("a"), F.explode(F.slice(F.filter("all", lambda x: x["b"] != F.col("id")), 1, k)).alias("x"))
    return joined.select(F.lit(kind).alias("kind"), "a", F.col("x.b").alias("b"), (-F.col("x.s")).alias("similarity")).where(F.col("similarity") >= least)


def nearest_to_queries(df: DataFrame, id_col: str, column: str, queries: DataFrame, k: int, dim: int | None = None, label: str = "", block: int = 2_048) -> DataFrame:
    """Rows (kind, a, b, similarity, place): the k rows of df most similar to each row of queries, itself left out.

    All rows are scanned for a query set, block of queries by block: bit counts rule out the pairs whose upper bound stays under
    the k-th best so far, the rest is computed exactly. Dirty vectors on either side take no part; ties go to the smaller id; a
    repeated id is one row. Every partition hands on k rows a query.
    """
    spark = df.sparkSession
    kind = label or column
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v"))
    dim = V.common_dim(src, "v") if dim is None else dim
    shape = "a long, b long, similarity double"
    out = None
    for ids, u in _query_blocks(queries.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v")), dim, block):
        sent = spark.sparkContext.broadcast((ids, u))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            turn = V.rotation(dim)
            planes = bit_planes(q @ turn)
            best: pd.DataFrame | None = None
            floor = np.full(len(q), -1.0)
            for batch in V.batches_of(batches):
                at, rows = V.matrix(batch.column(1), dim)
                if not len(rows):
                    continue
                x_ids = np.asarray(batch.column(0).take(pa.array(at))).astype(np.int64)
                a, b, s = _scan_block(q, planes, V.unit(rows), turn, k, floor)
                other = q_ids[a] != x_ids[b]
                got = pd.DataFrame({"a": q_ids[a][other], "b": x_ids[b][other], "s": s[other]})
                best = _keep_best(got if best is None else pd.concat([best, got]), k)
                # every query is in order of q_ids; one place is spare for the query itself
                full = best.groupby("a")["s"].agg(["size", "min"])
                floor = np.where((full["size"].reindex(q_ids).fillna(0) >= k).to_numpy(), full["min"].reindex(q_ids).fillna(-1.0).to_numpy(), -1.0)
            if best is not None:
                yield pa.RecordBatch.from_pandas(best.rename(columns={"s": "similarity"}), preserve_index=False)

        part = src.mapInArrow(run, shape)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "kind string, a long, b long, similarity double, place int")
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return out.dropDuplicates(["a", "b"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(F.lit(kind).alias("kind"), "a", "b", "similarity", "place")


def _query_blocks(queries: DataFrame, dim: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids: list[int] = []
    rows: list[list[float]] = []
    for r in queries.where(F.size("v") == dim).toLocalIterator(prefetchPartitions=True):
        ids.append(r["id"])
        rows.append(r["v"])
        if len(ids) == block:
            yield from _clean_block(ids, rows, dim)
            ids, rows = [], []
    if ids:
        yield from _clean_block(ids, rows, dim)


def _clean_block(ids: list[int], rows: list[list[float]], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    keep, m = V.matrix(pa.array(rows, pa.list_(pa.float32())), dim)
    if len(keep):
        first = np.unique(np.array(ids)[keep], return_index=True)[1]
        yield np.array(ids)[keep][first], V.unit(m[first])


def _scan_block(q: np.ndarray, planes: tuple, x: np.ndarray, turn: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, own = one_bit_codes(x @ turn)
    dim = x.shape[1]
    wrong = EPSILON * np.sqrt(np.maximum(1 - own**2, 0)) / own / sqrt(max(1, dim - 1))
    bits, low, step = planes
    aa, bb, ss = [], [], []
    wrong = wrong.astype(np.float32)
    q32, x32 = q.astype(np.float32), x.astype(np.float32)
    for begin in range(0, len(q), 64):
        rows = slice(begin, begin + 64)
        upper = estimate(codes, own, bits[:, rows], low[rows], step[rows], dim)
        slack = (EPSILON * step[rows] / 2).astype(np.float32)
        need = floor[rows].astype(np.float32)
        if (need <= -1).any() and upper.shape[1] > k:  # no k rows yet: the k-th best lower bound, and one more for the query itself
            lower = upper - wrong[None, :] - slack[:, None]
            need = np.maximum(need, -np.partition(-lower, k, axis=1)[:, k])
        upper += wrong[None, :]
        a, b = np.nonzero(upper >= (need - slack)[:, None])
        if len(a) > upper.size // 64:  # many pairs to rerank: single precision first, one product for the block
            close = (q32[rows] @ x32.T)[a, b] >= floor[rows][a] - 1e-5
            a, b = a[close], b[close]
        s = np.round(np.einsum("ij,ij->i", q[rows][a], x[b]), 12)
        ok = s >= floor[rows][a]
        aa.append(a[ok] + begin), bb.append(b[ok]), ss.append(s[ok])
    return np.concatenate(aa), np.concatenate(bb), np.concatenate(ss)


def _keep_best(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    return pairs.drop_duplicates(["a", "b"]).sort_values(["s", "b"], ascending=[False, True], kind="stable").groupby("a", sort=False).head(k)


def _cell_counter(book, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(book.value), dtype=np.int64)
        for batch in V.batches_of(batches):
            _, rows = V.matrix(batch.column(1), dim)
            if len(rows):
                total += np.bincount(V.nearest_cells(V.unit(rows), book.value, 1)[:, 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    return run


def _first_ids(dim: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, list[int]] = {}
        for batch in V.batches_of(batches):
            at, rows = V.matrix(batch.column(1), dim)
            if not len(rows):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
            for key, i in zip(V.direction_key(V.unit(rows)), ids.tolist()):
                have = kept.setdefault(key, [])
                if len(have) < most:
                    have.append(i)
                elif i < max(have) and i not in have:
                    have[have.index(max(have))] = i
        items = list(kept.items())
        for i in range(0, len(items), 8192):
            part = items[i : i + 8192]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([v for _, v in part], pa.list_(pa.int64()))], names=["key", "ids"])

    return run


def _all_keys(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.batches_of(batches):
            at, rows = V.matrix(batch.column(1), dim)
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(V.direction_key(V.unit(rows)), pa.binary())], names=["id", "key"])

    return run
