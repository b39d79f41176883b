import numpy as np

from tracklattice.llm import neighbours as N
from tracklattice.llm import vectors as V


def make(spark, vectors, extra=True):
    rows = [(i, None if v is None else [float(x) for x in v], "k") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, v array<float>, kind string").withColumnRenamed("v", "vec")


def brute(vectors, dim, k, least):
    keep = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim and np.isfinite(v).all() and np.abs(v).sum() > 0]
    m = np.array([vectors[i] for i in keep], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    s[np.abs(s - 1) < 1e-9] = 1.0
    out = set()
    for a in range(len(keep)):
        order = sorted((b for b in range(len(keep)) if b != a), key=lambda b: (-s[a, b], keep[b]))[:k]
        out |= {(keep[a], keep[b]) for b in order if s[a, b] >= least}
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 32))
    vectors = [v + 0.08 * rng.standard_normal(32) for v in base for _ in range(6)]
    vectors = [v * rng.uniform(0.1, 9) for v in vectors]
    got = {(r["a"], r["b"]) for r in N.nearest_pairs(make(spark, vectors), "id", "vec", k=5, least=0.9).collect()}
    want = brute(vectors, 32, 5, 0.9)
    assert len(got & want) >= 0.99 * len(want) and not {p for p in got if p not in want}


def test_dirty_rows_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    one = rng.standard_normal(8)
    vectors = [one, one * 2, one * 3, None, [0.0] * 8, [1.0] * 4, [float("nan")] * 8, *([one] * 20), *rng.standard_normal((10, 8))]
    got = {(r["a"], r["b"], r["similarity"]) for r in N.nearest_pairs(make(spark, vectors), "id", "vec", k=3, least=0.97).collect()}
    copies = [0, 1, 2, *range(7, 27)]
    want = {(a, b) for a in copies for b in [c for c in copies if c != a][:3]}
    assert {(a, b) for a, b, _ in got} == want and all(s == 1.0 for *_, s in got)


def test_empty_and_repeated(spark):
    df = make(spark, [np.ones(4), np.array([1, 1, 1, 0.9])])
    assert N.nearest_pairs(df.limit(0), "id", "vec", k=2).count() == 0
    twice = df.unionByName(df)
    assert sorted((r["a"], r["b"]) for r in N.nearest_pairs(twice, "id", "vec", k=2, dim=4).collect()) == [(0, 1), (1, 0)]


def test_estimates_hold_their_bound():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((400, 64)), rng.standard_normal((50, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    codes, own = N.one_bit_codes(x)
    planes, low, step = N.bit_planes(q)
    guess = N.estimate(codes, own, planes, low, step, 64)
    wrong = N.EPSILON * np.sqrt(1 - own**2) / own / np.sqrt(63)
    inside = np.abs(guess - q @ x.T) <= wrong[None, :] + N.EPSILON * step[:, None] / 2
    assert inside.mean() > 0.985


def test_blocks_of_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    vectors = [centre + 0.05 * rng.standard_normal(16) for _ in range(300)]
    monkeypatch.setattr(V, "MAX_CELLS", 2)
    got = {(r["a"], r["b"]) for r in N.nearest_pairs(make(spark, vectors), "id", "vec", k=4, least=0.5).collect()}
    want = brute(vectors, 16, 4, 0.5)
    assert len(got & want) == len(want) == len(got)


def test_query_set_against_all_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [*rng.standard_normal((400, 48)), None, [0.0] * 48, [1.0], *[np.ones(48)] * 9]
    df = make(spark, vectors)
    q = df.where("id % 5 = 0 or id >= 403")
    got = N.nearest_to_queries(df, "id", "vec", q, k=4, block=50).toPandas()
    want = brute(vectors, 48, 4, -1)
    ids = {r["id"] for r in q.collect()}
    want = {(a, b) for a, b in want if a in ids}
    mine = set(zip(got["a"], got["b"]))
    assert len(mine & want) >= 0.97 * len(want) and len(mine) == len(want)
    assert {(a, b) for a, b in mine if a >= 403} == {(a, b) for a, b in want if a >= 403}
    assert N.nearest_to_queries(df, "id", "vec", q.limit(0), k=4).count() == 0
