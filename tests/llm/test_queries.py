"""Queries over the tables of sf0.01 against brute force."""

import numpy as np
import pytest

from tracklattice.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def features(spark):
    rows = spark.read.parquet(f"{DIR}/track_features.parquet").select("track_index", "embed_vector", "unified_vector").collect()

    def clean(column):
        keep = [(r["track_index"], r[column]) for r in rows if r[column] is not None and len(r[column]) == 64]
        ids, m = np.array([i for i, _ in keep]), np.array([v for _, v in keep], dtype=np.float32).astype(float)
        good = np.isfinite(m).all(axis=1) & (np.abs(m).sum(axis=1) > 0)
        return ids[good], m[good] / np.linalg.norm(m[good], axis=1, keepdims=True)

    return {"embed": clean("embed_vector"), "unified": clean("unified_vector")}


def test_topk_of_the_query_set(spark, features):
    got = queries.p2_topk(spark, DIR).toPandas()
    for kind, (ids, u) in features.items():
        mine = got[got["vector_kind"] == kind]
        s = u @ u.T
        np.fill_diagonal(s, -2)
        at = {int(i): n for n, i in enumerate(ids)}
        asked = [i for i in at if i % 20 == 0]
        assert set(mine["track_index"]) == set(asked) and (mine.groupby("track_index").size() == 5).all()
        kth = {i: np.sort(s[at[i]])[-5] for i in asked}
        hits = sum(s[at[a], at[b]] >= kth[a] - 1e-9 for a, b in zip(mine["track_index"], mine["neighbour"]))
        assert hits >= 0.99 * len(mine)
        assert max(abs(s[at[a], at[b]] - x) for a, b, x in zip(mine["track_index"], mine["neighbour"], mine["similarity"])) < 1e-6


def test_pairs_of_similar_rows(spark, features):
    got = queries.p2_found(spark, DIR).toPandas()
    for kind, (ids, u) in features.items():
        s = u @ u.T
        np.fill_diagonal(s, -2)
        want = set()
        for n, i in enumerate(ids):
            kth = np.sort(s[n])[-5]
            want |= {(min(i, ids[m]), max(i, ids[m])) for m in np.flatnonzero((s[n] >= max(0.97, kth)))}
        mine = set(zip(got.loc[got["vector_kind"] == kind, "track_index_a"], got.loc[got["vector_kind"] == kind, "track_index_b"]))
        assert len(mine & want) >= 0.98 * len(want) and len(mine - want) <= 0.02 * len(mine)


def test_typical_members_and_clusters(spark, features):
    ids, u = features["unified"]
    at = {int(i): n for n, i in enumerate(ids)}
    found = queries.p5_found(spark, DIR).toPandas()
    typical = {r["medoid_index"]: r for r in queries.p5_typical(spark, DIR).collect()}
    means = {m: u[[at[i] for i in g]].mean(axis=0) for m, g in found.groupby("medoid_index")["member_index"]}
    names = list(means)
    directions = np.array([means[m] / np.linalg.norm(means[m]) for m in names])
    assert set(typical) == set(names)
    own = dict(zip(found["member_index"], found["medoid_index"]))
    near = u @ directions.T
    for n, i in enumerate(ids):
        best = int(near[n].argmax())
        if near[n, best] >= 0.7 + 1e-9:
            assert own.get(int(i)) == names[best]
        elif near[n, best] < 0.7 - 1e-9:
            assert int(i) not in own
    for m, g in found.groupby("medoid_index")["member_index"]:
        rows = [at[i] for i in g]
        degree = (u[rows] @ u[rows].T).sum(axis=1)
        order = [int(i) for _, i in sorted(zip(np.round(-degree, 6), g))][:5]
        assert typical[m]["size"] == len(g) >= 10 and typical[m]["typical"][0] == m and set(typical[m]["typical"]) == set(order)


def test_every_sentence_end_lies_behind_a_sign(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = queries.p8_found(spark, DIR).toPandas()
    assert not got.duplicated().any()
    last = got.groupby("doc_id")["end_char"].max()
    for i, t in docs.items():
        assert (i in last.index) == bool(t and t.strip())
        if i in last.index:
            assert last[i] == len(t.rstrip())
    assert all(not docs[d][e - 1].isspace() for d, e in zip(got["doc_id"], got["end_char"]))
