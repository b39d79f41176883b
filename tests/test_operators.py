import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklattice.operators import clusters, graph, linkage, metrics, ranks, recommend, resolve, search, sequence, store, taxonomy

OBS = "observation_id string, track_id string, file_id string, source_system string, key_camelot string, key_confidence double, bpm string, observed_at string, ingested_at timestamp_ntz"


def obs(spark, rows):
    return spark.createDataFrame([(f"O{i}", t, None, s, k, c, b, f"2024-01-{i + 1:02d}", None) for i, (t, s, k, c, b) in enumerate(rows)], OBS)


@pytest.mark.parametrize("given_, want", [
    ([("rekordbox", "128")], (128, 1.0)),
    ([("tag", "126"), ("rekordbox", "126"), ("songstats", "126")], (126, 1.0)),
    ([("tag", "126"), ("rekordbox", "128"), ("songstats", "128")], (128, 0.667)),
    ([("tag", "126"), ("rekordbox", "128")], (126, 0.5)),
    ([("rekordbox", "128"), ("songstats", "126")], (128, 0.5)),
    ([("rekordbox", "127.5"), ("songstats", "128.5")], (128, 1.0)),
])
def test_tempo_votes(spark, given_, want):
    got = resolve.majority_tempo(obs(spark, [("T", s, None, None, b) for s, b in given_])).collect()
    assert [(r["bpm"], r["confidence"]) for r in got] == [want]


def test_votes_without_values(spark):
    empty = obs(spark, [("T", "tag", "??", None, "n/a"), (None, "tag", "8A", 1.0, "120")])
    assert resolve.majority_tempo(empty).count() == 0 and resolve.weighted_key(empty).count() == 0


def test_key_votes(spark):
    rows = [("A", "analysis_librosa", "8A", 0.9, None), ("A", "rekordbox", "8A", 0.8, None), ("A", "tag", "9A", 1.0, None), ("B", "songstats", "1A", 0.5, None), ("B", "tag", "2A", 0.4, None)]
    got = {r["track_id"]: r for r in resolve.weighted_key(obs(spark, rows)).collect()}
    assert got["A"]["key"] == "8A" and got["A"]["resolved"] and got["A"]["score"] == pytest.approx(0.72 + 0.6 + 0.15 + 0.1)
    assert not got["B"]["resolved"] and got["B"]["reason"] == "no_analysis"
    queue = resolve.review_queue(obs(spark, rows)).collect()
    assert [(r["track_id"], r["priority"], r["key_1"], r["key_3"]) for r in queue] == [("B", "low", "2A", None)]


def test_deliveries(spark):
    df = spark.createDataFrame([("O1", "T1", "2024", 1), ("O1", "T2", "2024", 2), (None, "T3", "2024", 1), (None, "T3", "2024", 1)], "observation_id string, track_id string, observed_at string, ingested_at int")
    assert sorted((r[0] or "", r[1]) for r in resolve.delivered_once(df).select("observation_id", "track_id").collect()) == [("", "T3"), ("", "T3"), ("O1", "T2")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: find(n) for n in parent}


def test_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(None, 3)], "a int, b int")
    assert {r["component"] for r in graph.connected_components(df).collect()} == {0}


def test_store(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (2, "bb")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, store.upsert(base, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r["k"] for r in store.without(base, new.unionByName(spark.createDataFrame([(None, "x")], "k int, v string")), ["k"]).collect()] == [1]
    assert store.within(base, new, ["k"]).count() == 2 and store.lookup(base, k=1).collect()[0]["v"] == "a" and store.lookup(base, k=9).count() == 0
    ch = {r["k"]: r["change"] for r in store.changes(base.where("v <> 'bb'"), new, ["k"], ["v"]).collect()}
    assert ch == {1: "removed", 2: "changed", 3: "new"}
    a = spark.createDataFrame([(1, "v1", 1), (2, "v0", 9), (3, "v1", 5)], "k int, version string, m int")
    b = spark.createDataFrame([(1, "v1", 2), (2, "v1", 1), (3, "v1", 5), (4, "v0", 1)], "k int, version string, m int")
    assert {r["k"]: r["outcome"] for r in store.merge_caches(a, b, "k", "version", "m", "v1").collect()} == {1: "replaced", 2: "replaced", 3: "kept", 4: "added"}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40))
def test_ranks_and_quantiles(spark, xs):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    got = {r["i"]: r["r"] for r in ranks.percentile_ranks(df, "x", "r").collect()}
    want = (pd.Series(xs).rank(method="average") - 1) / max(1, len(xs) - 1) if len(xs) > 1 else pd.Series([0.0])
    assert [got[i] for i in range(len(xs))] == pytest.approx(want.tolist())
    assert ranks.quantiles(df, "x", [0.02, 0.5, 0.98]) == pytest.approx(np.quantile(xs, [0.02, 0.5, 0.98]).tolist())


def test_ranks_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "i int, x double")
    assert ranks.quantiles(df, "x", [0.5]) == [None] and ranks.percentile_ranks(df, "x", "r").collect()[0]["r"] is None and ranks.contrast_stretched(df, "x", "s").collect()[0]["s"] == 1.0


def test_topk_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(0)
    m = rng.standard_normal((60, 6))
    m[10] = m[11]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(60, None), (61, [1.0])], "id long, v array<double>")
    got = search.block_topk(rows.where("id < 20").withColumnRenamed("id", "q"), rows, "q", "id", 3, search.cosine_scores("v")).toPandas()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    for q in range(20):
        want = sorted(range(60), key=lambda j: (-s[q, j], j))[:3]
        assert got[got.q == q].sort_values("place")["id"].tolist() == want


def test_sequences(spark):
    e = [0.2] * 8 + [0.45] * 24 + [0.9] * 8 + [0.5] * 16 + [0.2] * 8
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(e)] + [("s", 0, 1.0)], "k string, bar int, e double")
    intro = {r["k"]: r for r in sequence.intro(df, "k", "bar", "e").collect()}
    assert intro["t"]["intro_end"] == 8 and intro["t"]["snapped"] == 16 and intro["s"]["snapped"] == 16 and intro["s"]["confidence"] == 0.2
    cue = {r["k"]: r for r in sequence.cue_points(df, "k", "bar", "e").collect()}
    assert cue["t"]["mix_in"] == 8 and cue["t"]["drop_bar"] == 32 and cue["t"]["mix_out"] == 48 and cue["s"]["drop_bar"] is None
    got = [(r["section"], r["start_bar"], r["end_bar"]) for r in sequence.sections(df.where("k = 't'"), "k", "bar", "e").orderBy("start_bar").collect()]
    assert got[0][0] == "breakdown" and got[-1] == ("breakdown", 56, 64) and ("peak", 32, 56) in got
    assert sequence.flow(df.where("k = 's'"), "k", "bar", "e").count() == 0
    t = F.array(F.lit(0.0), F.lit(2.0), F.lit(4.0))
    assert spark.range(1).select(sequence.bar_time(t, F.lit(1), F.lit(2.0)), sequence.bar_time(t, F.lit(5), F.lit(2.0)), F.size(sequence.beat_grid(F.lit(120.0), F.lit(10.0)))).collect()[0][:] == (2.0, 10.0, 20)


def test_linkage(spark):
    l = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, k string")
    r = spark.createDataFrame([(10, "a"), (11, "a"), (12, "c")], "j int, k string")
    got = {x["i"]: (x["j"], x["method"]) for x in linkage.cascade(l, r, "i", "j", [("key", 1.0, [(F.col("l_k"), F.col("r_k"))], None)]).collect()}
    assert got == {1: (10, "key"), 2: (None, "new"), 3: (None, "new")}
    assert {x["i"]: x["j"] for x in linkage.unique_key_match(l, r, ["k"], "j").collect()} == {1: None, 2: None, 3: None}
    v = spark.createDataFrame([(1, "g", 1.0), (2, "g", 1.9), (3, "g", 3.0), (4, "h", 1.0), (5, "g", None), (6, "g", 1.0)], "i int, g string, x double")
    assert sorted((x["id_a"], x["id_b"]) for x in linkage.band_pairs(v, "g", "i", "x", 1.0).collect()) == [(1, 2), (1, 6), (2, 6)]


def test_clusters(spark):
    d = np.abs(np.subtract.outer([0, 1, 10, 11, 30], [0, 1, 10, 11, 30])).astype(float)
    assert clusters.average_linkage(d, 5.0).tolist() == [0, 0, 1, 1, 2]
    pairs = pd.DataFrame({"a": [1, 1, 2], "b": [2, 3, 3], "distance": [0.5, 0.2, 0.1]})
    assert clusters.coarse_merge(pairs, [1, 2, 3], 2) == {1: 1, 2: 2, 3: 2}
    rng = np.random.default_rng(1)
    block = pd.DataFrame({"i": range(40), "v": list(rng.standard_normal((40, 5)))})
    forbidden = np.zeros((40, 40), bool)
    for a in range(0, 40, 2):
        forbidden[a, a + 1] = forbidden[a + 1, a] = True
    got = clusters.constrained_medoids(block, "i", "v", forbidden)
    assert sorted(got["i"]) == list(range(40)) and got.groupby("cluster").size().max() <= 20
    assert all(not forbidden[np.ix_(g.i, g.i)].any() for _, g in got.groupby("cluster")) and all(g.medoid.iloc[0] in set(g.i) for _, g in got.groupby("cluster"))


def test_recommendation_terms():
    row = dict(bpm=120.0, number=8, side=0, energy=3, bars=32, flow="H")
    q = pd.DataFrame([row])
    r = pd.DataFrame([row, row | {"bpm": 140.0}, row | {"bpm": 122.0, "number": 2}])
    s = recommend.scores(q, r)[0]
    assert np.isnan(s[1]) and s[0] > s[2] and s[0] == pytest.approx(1 + 0.15 + 0.05 + 0.1 * 0.85 + 0.05)


def test_metrics_and_aliases(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None)], "t string, p string")
    got = {r["label"]: (r["support"], r["precision"], r["recall"]) for r in metrics.per_class(rows, "t", "p").collect()}
    assert got == {"a": (2, 1.0, 0.5), "b": (1, 0.5, 1.0), "c": (1, 0.0, 0.0)}
    b = metrics.confidence_buckets(spark.createDataFrame([(0.9, True)], "c double, h boolean"), "c", F.col("h")).collect()
    assert len(b) == 4 and sum(r["n"] for r in b) == 1
    al = spark.createDataFrame([("a", "b"), ("b", "c")], "n string, t string")
    assert {r["n"]: r["t"] for r in taxonomy.resolved_aliases(al, "n", "t").collect()} == {"a": "c", "b": "c"}
    with pytest.raises(ValueError):
        taxonomy.resolved_aliases(spark.createDataFrame([("a", "b"), ("b", "a")], "n string, t string"), "n", "t", rounds=4)
