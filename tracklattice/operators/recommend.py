"""Directed recommendations: which track to play after which."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tracklattice.operators.search import block_topk

# fixed values: flow transitions (rows from, columns to) and intro terms
FLOWS = "GHDBL"
TRANSITION = np.array([[0.15, 0.10, 0.0, 0.05, 0.10], [0.10, 0.15, -0.10, 0.0, 0.10], [0.0, -0.10, 0.05, 0.0, -0.10], [0.05, 0.0, 0.0, 0.10, 0.0], [0.10, 0.10, -0.10, 0.0, 0.15]])
INTRO_BARS = {16: 0.3, 32: 0.7, 64: 1.0}
INTRO_FLOW = np.array([0.10, 0.15, -0.10, 0.0, 0.15])
FREE, REJECT = 0.04, 0.08


def scores(q: pd.DataFrame, r: pd.DataFrame) -> np.ndarray:
    """Score of playing each of r after each of q; NaN where tempos are too far apart.

    Both need bpm, number and side (0 for A, 1 for B, -1 for no key), energy, bars, flow and breaks (flow is B); a vector column adds
    the likeness of sound.
    """
    col = lambda f, c: f[c].to_numpy()
    b1, b2 = col(q, "bpm").astype(float)[:, None], col(r, "bpm").astype(float)[None, :]
    p = np.abs(b1 - b2) / np.maximum(b1, b2)
    bpm = np.where(p <= FREE, 0.0, 0.15 * ((p - FREE) / FREE) ** 2)
    n1, n2 = col(q, "number")[:, None], col(r, "number")[None, :]
    gap = np.abs(n1 - n2)
    steps = np.minimum(gap, 12 - gap) + (col(q, "side")[:, None] != col(r, "side")[None, :])
    known = (col(q, "side")[:, None] >= 0) & (col(r, "side")[None, :] >= 0)
    key = np.where(known, np.minimum(1.0, steps / 6), 0.5) * 0.15
    f1 = np.array([FLOWS.index(f) for f in q["flow"]])
    f2 = np.array([FLOWS.index(f) for f in r["flow"]])
    w1, w2 = col(q, "bars")[:, None], col(r, "bars")[None, :]
    structure = TRANSITION[np.ix_(f1, f2)] + np.where(w1 == w2, 0.05, np.where(np.abs(w1 - w2) <= 16, 0.0, -0.05))
    intro = np.array([INTRO_BARS.get(int(b), 0.5) for b in r["bars"]]) + INTRO_FLOW[f2]
    jump = np.abs(col(q, "energy")[:, None] - col(r, "energy")[None, :])
    energy = np.where(jump == 0, 0.05, np.where(jump == 1, 0.02, -0.05 * (jump - 1)))
    breakdown = np.where(f2 == FLOWS.index("B"), -0.08, 0.0)
    like = 1.0
    if "vector" in q:
        a, b = (np.array(f["vector"].tolist(), dtype=float) for f in (q, r))
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-8)
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-8)
        like = 1 - (1 - a @ b.T) / 2
    total = like - key - bpm + structure + 0.10 * intro[None, :] + energy + breakdown[None, :]
    return np.where(p > REJECT, np.nan, total)


def recommendations(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, k: int = 10) -> DataFrame:
    """Rows (query_id, row_id, score, place): the k best tracks to follow each query."""
    return block_topk(queries, rows, query_id, row_id, k, scores, rounding=8)
