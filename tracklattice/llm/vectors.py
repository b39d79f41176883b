"""Shared handling of vector columns: cleaning, directions, a bounded codebook, cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows that the codebook is fitted on at most; every row is indexed
CODEBOOK_SAMPLE = 131_072
#: cells of the codebook at most; the sample holds SAMPLE_CELL rows a cell, LEAST_SAMPLE at least
MAX_CELLS = 16_384
SAMPLE_CELL, LEAST_SAMPLE = 8, 16_000


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, float32 matrix) of a list column: only vectors of dim finite elements that are not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    keep = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(keep)).flatten() if len(keep) else pa.array([], type=pa.float32())
    got = np.asarray(flat.cast(pa.float32()).fill_null(float("nan"))).reshape(-1, dim)
    good = np.isfinite(got).all(axis=1) & (np.abs(got).sum(axis=1) > 0)
    return keep[good], got[good]


def unit(rows: np.ndarray) -> np.ndarray:
    """Directions in float64; scaled by the largest element first so that no square overflows."""
    wide = rows.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


_ODD = np.random.default_rng(20240229).integers(1, 2**63, size=(2, 4096), dtype=np.uint64) | np.uint64(1)


def direction_key(units: np.ndarray) -> list[bytes]:
    """16 bytes for each direction, equal for copies and for copies of another length."""
    grid = np.rint(units * 1e6).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        halves = []
        for odd in _ODD[:, : units.shape[1]]:
            h = ((grid ^ (grid >> np.uint64(32))) * odd + (odd >> np.uint64(7))).sum(axis=1, dtype=np.uint64)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            halves.append(h ^ (h >> np.uint64(33)))
    packed = np.ascontiguousarray(np.stack(halves, axis=1))
    return [row.tobytes() for row in packed]


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def common_dim(df: DataFrame, column: str) -> int:
    """The most frequent number of elements; 0 for a table without vectors."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count()
    row = sizes.orderBy(F.desc("count"), "n").limit(1).collect()
    return int(row[0]["n"]) if row else 0


def sample_matrix(df: DataFrame, column: str, dim: int, n_rows: int, cells: int = 0) -> np.ndarray:
    """Directions of a bounded pseudo-random sample of the rows, to fit a codebook of so many cells on."""
    limit = min(CODEBOOK_SAMPLE, max(LEAST_SAMPLE, SAMPLE_CELL * cells))
    share = min(1.0, 1.2 * limit / max(1, n_rows))
    picked = df.select(column) if share >= 1 else df.select(column).where(F.rand(11) < share)
    got = picked.limit(limit).toArrow().column(0)
    _, rows = matrix(got, dim)
    return unit(rows).astype(np.float32) if len(rows) else np.zeros((0, dim), np.float32)


def fit_codebook(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means on the sample; cells that run empty take over random rows."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0) if len(sample) else sample
    cells = max(1, min(cells, len(sample)))
    centres = sample[rng.choice(len(sample), cells, replace=False)].copy() if len(sample) else sample
    for _ in range(rounds if len(sample) else 0):
        own = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(cells))
        counts = np.bincount(own, minlength=cells)
        sums = np.zeros_like(centres)
        full = counts > 0
        sums[full] = np.add.reduceat(sample[order], starts[full], axis=0)
        sums[~full] = sample[rng.choice(len(sample), int((~full).sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def nearest_cells(units: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The probes nearest cells of each row, nearest first."""
    probes = min(probes, len(centres))
    out = np.empty((len(units), probes), dtype=np.int32)
    for i in range(0, len(units), 2048):
        scores = units[i : i + 2048].astype(np.float32) @ centres.T
        if probes == 1:
            out[i : i + 2048, 0] = scores.argmax(axis=1)
        else:
            top = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
            order = np.argsort(-np.take_along_axis(scores, top, 1), axis=1, kind="stable")
            out[i : i + 2048] = np.take_along_axis(top, order, 1)
    return out


def batches_of(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
