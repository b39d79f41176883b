"""Exact top-k of a query set against all rows, block by block.

Queries are taken in blocks of bounded size; each block is broadcast and every partition of the rows keeps its own best k for each
query, so what is shuffled is k rows a query and partition, not the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: queries in one broadcast
QUERY_BLOCK = 2_048


def block_topk(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, k: int, score: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], rounding: int = 6) -> DataFrame:
    """Rows (query_id, row_id, score, place): the k rows of the highest score of each query; a row is not its own neighbour.

    score(queries, rows) gives a matrix, NaN where a pair is ruled out. Scores are rounded before they are compared and ties go to
    the smaller id. All of rows is read once for each block of queries.
    """
    spark = rows.sparkSession
    shape = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {row_id} {rows.schema[row_id].dataType.simpleString()}, score double"
    local = queries.toPandas() if queries.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK else None
    blocks: Iterator[pd.DataFrame] = iter([local]) if local is not None else _blocks(queries)
    out = None
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            q = sent.value
            ids_q = q[query_id].to_numpy()
            best: pd.DataFrame | None = None
            for pdf in batches:
                for begin in range(0, len(pdf), 4096):
                    part = pdf.iloc[begin : begin + 4096]
                    s = np.round(np.asarray(score(q, part), dtype=float), rounding)
                    ids = part[row_id].to_numpy()
                    s[ids_q[:, None] == ids[None, :]] = np.nan
                    keep = min(k, s.shape[1])
                    filled = np.where(np.isnan(s), -np.inf, s)
                    # everything at or above the k-th score stays, so ties are decided by id at the end
                    edge = -np.partition(-filled, keep - 1, axis=1)[:, keep - 1] if keep else np.full(len(q), -np.inf)
                    a, b = np.nonzero((filled >= edge[:, None]) & np.isfinite(filled))
                    got = pd.DataFrame({query_id: ids_q[a], row_id: ids[b], "score": filled[a, b]})
                    best = got if best is None else pd.concat([best, got])
                    if len(best) > 8 * k * len(q):
                        best = _cut(best, query_id, row_id, k)
            if best is not None:
                yield _cut(best, query_id, row_id, k)

        part = rows.mapInPandas(run, shape)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], shape + ", place int")
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), row_id)
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _cut(best: pd.DataFrame, query_id: str, row_id: str, k: int) -> pd.DataFrame:
    return best.sort_values(["score", row_id], ascending=[False, True], kind="stable").groupby(query_id, sort=False).head(k)


def _blocks(queries: DataFrame) -> Iterator[pd.DataFrame]:
    it = queries.toLocalIterator(prefetchPartitions=True)
    while block := [r.asDict() for r in islice(it, QUERY_BLOCK)]:
        yield pd.DataFrame(block)


def cosine_scores(column: str) -> Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]:
    """Scorer of block_topk: cosine of a vector column; rows without a proper vector are ruled out."""

    def score(q: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
        dim = max((len(v) for v in q[column] if v is not None), default=0)

        def units(vs) -> np.ndarray:
            m = np.array([np.asarray(v, dtype=float) if v is not None and len(v) == dim else np.full(dim, np.nan) for v in vs]).reshape(-1, dim)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)

        return units(q[column]) @ units(rows[column]).T

    return score
