import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklattice.llm import clusters as C


def planted(seed=0, sizes=(40, 25, 12), dim=24, noise=30):
    rng = np.random.default_rng(seed)
    rows, label = [], []
    for c, n in enumerate(sizes):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(n):
            rows.append((centre + 0.08 * rng.standard_normal(dim)) * rng.uniform(0.2, 5))
            label.append(c)
    for _ in range(noise):
        rows.append(rng.standard_normal(dim))
        label.append(-1)
    return np.array(rows), np.array(label)


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1) for i, v in enumerate(vectors)], "track_index long, v array<float>, size int")


def test_finds_planted_clusters_with_their_medoids(spark):
    rows, label = planted()
    dirty = [*rows, None, np.zeros(24), np.ones(5), np.full(24, np.nan)]
    got = C.similarity_clusters(frame(spark, dirty), "track_index", "v").toPandas()
    assert sorted(got.groupby("medoid_index").size()) == [12, 25, 40]
    u = rows.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for medoid, g in got.groupby("medoid_index"):
        m = g["member_index"].to_numpy()
        assert len(set(label[m])) == 1 and label[m[0]] >= 0
        sums = (u[m] @ u[m].T).sum(axis=1)
        assert m[sums.argmax()] == medoid


def test_small_groups_and_empty_tables_give_nothing(spark):
    rows, _ = planted(sizes=(9,), noise=5)
    df = frame(spark, rows)
    assert C.similarity_clusters(df, "track_index", "v").count() == 0
    assert C.similarity_clusters(df.limit(0), "track_index", "v").count() == 0


def test_copies_are_members(spark):
    one = np.arange(1.0, 9.0)
    got = C.similarity_clusters(frame(spark, [one] * 15), "track_index", "v").toPandas()
    assert len(got) == 15 and set(got["medoid_index"]) == {0}


def test_hot_cell_is_split_and_joined_again(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 64)
    rows, label = planted(sizes=(600, 15), noise=20)
    got = C.similarity_clusters(frame(spark, rows), "track_index", "v").toPandas()
    assert sorted(got.groupby("medoid_index").size()) == [15, 600]
    top = C.typical_members(C.similarity_clusters(frame(spark, rows), "track_index", "v"), 3).toPandas()
    assert all(r.typical[0] == r.medoid_index for r in top.itertuples())


def test_a_third_of_the_rows_are_copies(spark):
    rows, label = planted(sizes=(40, 15), noise=20)
    n = 60_000
    hot = [float(x) for x in rows[0]]
    copies = spark.range(1000, 1000 + n).select("id", F.array(*[F.lit(x).cast("float") * (F.col("id") % 7 + 1).cast("float") for x in hot]).alias("v"))
    df = frame(spark, rows).select(F.col("track_index").alias("id"), "v").unionByName(copies).repartition(6)
    sent = C.communities_of(df, 24, n + len(rows), 0.7, 0.8)[0]
    assert sent.count() == len(rows) and sent.agg(F.max("n")).collect()[0][0] == n + 1  # one class a direction
    got = C.similarity_clusters(df, "id", "v").toPandas()
    assert sorted(got.groupby("medoid_index").size()) == [15, n + 40] and got["member_index"].is_unique
    assert got.loc[got["size"] > 100, "medoid_index"].iloc[0] == 0


def test_parts_and_pieces_follow_the_count(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(24)
    rows = [centre + 0.01 * rng.standard_normal(24) for _ in range(900)]
    classes, nodes = C.communities_of(frame(spark, rows).select(F.col("track_index").alias("id"), "v"), 24, 900, 0.7, 0.8)
    assert classes.count() == 900 and classes.select("key").distinct().count() == 900
    assert nodes.agg(F.sum("n")).collect()[0][0] == 900
    got = C.similarity_clusters(frame(spark, rows), "track_index", "v")
    assert got.select("medoid_index").distinct().count() == 1 and got.count() == 900


def test_single_rows_of_many_blocks_meet_again(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4)
    rows, label = planted(sizes=(12, 11), noise=40, seed=3)
    got = C.similarity_clusters(frame(spark, rows), "track_index", "v").toPandas()
    assert sorted(got.groupby("medoid_index").size()) == [11, 12]


def test_unsettled_clusters_are_an_error(spark):
    rows, _ = planted()
    with pytest.raises(RuntimeError, match="settle"):
        C.similarity_clusters(frame(spark, rows), "track_index", "v", rounds=0)


def test_neighbour_descent_recall():
    rng = np.random.default_rng(5)
    u = rng.standard_normal((1500, 12))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near, _ = C.neighbour_descent(u, 10)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near, want)]) > 0.9


def test_communities_of_two_cliques():
    pairs = [(i, j) for b in (0, 5) for i in range(b, b + 5) for j in range(i + 1, b + 5)] + [(0, 5)]
    a, b = np.array(pairs).T
    label = C.communities(10, a, b, np.ones(len(pairs)))
    assert len(set(label[:5])) == 1 and len(set(label[5:])) == 1 and label[0] != label[9]
