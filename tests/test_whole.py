"""Queries and operators over the whole of their input, against brute force."""

import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tracklattice.operators import clusters, taxonomy
from tracklattice.plans import linking
from tracklattice.plans.catalogue import QUERIES


def brute_pairs(texts):
    out = Counter()
    for text in texts:
        w = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in text.lower()).split()
        out.update(f"{a} {b}" for a, b in zip(w, w[1:]))
    return out


def test_word_pairs_of_all_documents(spark, tmp_path, tiny):
    rows = [("Deep house set.", "en"), ("deep HOUSE", "EN"), ("Deep house", None), ("deep-house", "en-xx"), ("über Köln", "de"), ("Глубокий хаус, да", "und"), ("one", ""), ("", "en"), (None, "en")]
    pd.DataFrame(rows, columns=["text", "lang"]).to_parquet(tmp_path / "documents.parquet")
    got = {r["gram"]: r["n"] for r in QUERIES["text_ngrams_all"](spark, str(tmp_path)).collect()}
    assert got == {"deep house": 4, "house set": 1, "über köln": 1, "глубокий хаус": 1, "хаус да": 1}
    texts = pd.read_parquet(f"{tiny}/documents.parquet")["text"].dropna()
    assert {r["gram"]: r["n"] for r in QUERIES["text_ngrams_all"](spark, tiny).collect()} == brute_pairs(texts)


def test_keys_of_all_records(spark, tmp_path, tiny):
    given = {"8A": "8A", "08a": "8A", "13B": None, "Am": "8A", "A minor": "8A", "F♯": "2B", "8A - Am": "8A", "Ebmin": "2A", "n/a": None, "": None, None: None}
    pd.DataFrame({"row_id": range(len(given)), "canonical_key": list(given)}).to_parquet(tmp_path / "registry_enrichment.parquet")
    got = {r["row_id"]: r["key"] for r in QUERIES["keys_parsed"](spark, str(tmp_path)).collect()}
    assert list(map(got.get, range(len(given)))) == list(given.values())
    assert QUERIES["keys_parsed"](spark, tiny).count() == len(pd.read_parquet(f"{tiny}/registry_enrichment.parquet"))


def words(s):
    return set(re.findall("[a-z0-9]+", s.lower())) - set(linking.STOP)


def brute_cut(name, artists, files, least=0.62):
    title, artist = words(name), set().union(*map(words, artists))
    remixer = set().union(*[words(x) - {"remix"} for x in re.split(r"\s-\s|[()\[\]]", name) if "remix" in words(x)])
    core, best = (title - remixer - artist - {"remix"}) or title, None
    for no, every, in_title in sorted(files, key=lambda f: f[0]) if title else []:
        every, in_title = set(every) - set(linking.STOP), set(in_title) - set(linking.STOP)
        cov, there = len(core & in_title) / len(core), bool(artist & every)
        part = 0.7 * max(cov, 0.85 * len(core & every) / len(core))
        score = (0.95 if there else 0.9 if len(title) >= 3 else 0.45) if cov >= 0.999 else part + 0.2 if there else part / 2
        if remixer and not remixer & in_title or "remix" in in_title and "remix" not in title:
            score = min(score, 0.45)
        if round(score, 6) >= least and (best is None or round(score, 6) > best[1]):
            best = (no, round(score, 6))
    return best


def test_a_remix_is_another_cut(spark, tmp_path):
    tracks = [
        ("Sunrise", ["Nora Vale"]), ("Sunrise - Adam Ten Remix", ["Nora Vale"]), ("Sunrise (Ivan Stone Remix)", ["Nora Vale"]), ("Seven Eleven (Adam Ten Remix)", ["Mia Frost"]), ("Foo", ["Foo"]), ("Baz (feat. Mia Frost)", ["Otto Lane", "Mia Frost"]),
        ("Amber Dovetail", ["Nora Vale"]), ("Amber Dovetail Lagoon Ember", ["Nora Vale"]), ("", ["Nora Vale"]), ("Solo (Remix)", ["Ann Bee"]), ("The Original Mix", []),
    ]
    names = [("nora vale", "sunrise adam ten remix"), ("mia frost", "other thing adam ten remix"), ("", "foo"), ("", "baz extended"), ("nora vale", "amber dovetail ivan stone remix"), ("nora vale", "amber dovetail ember"), ("ann bee", "solo"), ("nora", "lagoon"), ("otto", "baz remix")]
    files = [(i, (a + " " + t).split(), t.split()) for i, (a, t) in enumerate(names)]
    pd.DataFrame([(i, *t) for i, t in enumerate(tracks)], columns=["row_id", "name", "artists"]).to_parquet(tmp_path / "playlist_tracks.parquet")
    pd.DataFrame(files, columns=["file_no", "all_tokens", "title_tokens"]).to_parquet(tmp_path / "file_entries.parquet")
    got = {r["row_id"]: (r["file_no"], r["score"]) for r in QUERIES["fuzzy_best_cut"](spark, str(tmp_path)).collect()}
    assert got == {i: b for i, (n, a) in enumerate(tracks) if (b := brute_cut(n, a, files))}
    assert 0 not in got and got[1] == (0, 0.95) and not {2, 3} & set(got) and got[6][0] == 5
    present = {r["row_id"] for r in QUERIES["present_cut_split"](spark, str(tmp_path)).collect() if r["present"]}
    assert present == set(got)


def test_best_cut_as_by_brute_force(spark, tiny):
    fold = lambda s: s.lower().translate(str.maketrans(linking.text.ACCENTED, linking.text.PLAIN))
    p, f = pd.read_parquet(f"{tiny}/playlist_tracks.parquet"), pd.read_parquet(f"{tiny}/file_entries.parquet")
    files = [(n, a if a is not None else [], t if t is not None else []) for n, a, t in zip(f["file_no"], f["all_tokens"], f["title_tokens"])]
    got = {r["row_id"]: (r["file_no"], r["score"]) for r in QUERIES["fuzzy_best_cut"](spark, tiny).collect()}
    some = p.iloc[:150]
    want = {i: b for i, n, a in zip(some["row_id"], some["name"], some["artists"]) if (b := brute_cut(fold(n or ""), [fold(x) for x in (a if a is not None else []) if x], files))}
    assert {i: b for i, b in got.items() if i in set(some["row_id"])} == want


def test_superseded_by_the_same_cut_only(spark, tmp_path):
    rows = [
        (1, "nora vale amber", "amber", "mp3"), (2, "nora vale amber ivan stone remix", "amber ivan stone remix", "flac"), (3, "mia frost ember", "ember", "mp3"), (4, "mia frost ember original mix", "ember original mix", "wav"),
        (5, "ivan stone nora vale lagoon ivan stone remix", "lagoon ivan stone remix", "mp3"), (6, "nora vale lagoon ivan stone remix", "lagoon ivan stone remix", "flac"), (7, "otto lane ember", "ember", "mp3"), (8, "", "", "mp3"), (9, "", "", "wav"),
    ]
    pd.DataFrame([(i, a.split(), t.split(), e) for i, a, t, e in rows], columns=["file_no", "all_tokens", "title_tokens", "extension"]).to_parquet(tmp_path / "file_entries.parquet")
    assert {r["file_no"] for r in QUERIES["prune_superseded_cut"](spark, str(tmp_path)).collect()} == {3, 5}


def test_linked_groups_do_not_depend_on_the_size_of_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((9, 12))
    rows = [(i, i % 3, [float(x) for x in centres[i % 9] + 0.05 * rng.standard_normal(12)]) for i in range(180)]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    parts = []
    for most in (512, 8):
        got = clusters.linked_groups(df, "label", "vec_id", "v", 0.3, most).toPandas()
        parts.append(sorted(sorted(g) for _, g in got.groupby(["label", "cluster"])["vec_id"]))
        assert got["vec_id"].is_unique and len(got) == 180
    assert parts[0] == parts[1] and len(parts[0]) == 9 and all(len(g) == 20 for g in parts[0])


def test_coarse_merge_down_to_half_and_its_bound(spark, monkeypatch):
    df = spark.createDataFrame([(i, i // 2, [1.0, 0.1 * i, 0.0]) for i in range(12)], "vec_id long, label int, v array<double>")
    c = clusters.centres(df, "label", "v", 3)
    merged = clusters.merged_groups(c, "label")
    assert len(set(merged.values())) == 3 and all(merged[m] == m for m in merged.values())
    monkeypatch.setattr(clusters, "MAX_MERGED", 2)
    with pytest.raises(ValueError):
        clusters.merged_groups(c, "label")


def test_labels_of_any_length_are_matched(spark):
    docs = spark.createDataFrame([(1, "One two three four five six, and seven."), (2, None), (3, "")], "d int, t string")
    labels = spark.createDataFrame([(1, "one two three four five six"), (2, "Seven"), (3, ""), (4, "two four")], "l int, w string")
    got = taxonomy.phrase_hits(docs, "d", "t", labels, "l", "w")
    assert sorted((r["d"], r["l"], r["hits"]) for r in got.collect()) == [(1, 1, 1), (1, 2, 1)]
    assert taxonomy.phrase_hits(docs, "d", "t", labels.limit(0), "l", "w").count() == 0


def planted(sizes, dim=10, noise=0.02, seed=4):
    rng = np.random.default_rng(seed)
    rows, truth = [], []
    for c, n in enumerate(sizes):
        centre = rng.standard_normal(dim)
        rows += [centre + noise * rng.standard_normal(dim) for _ in range(n)]
        truth += [c] * n
    return pd.DataFrame({"id": np.arange(len(rows)), "v": rows}), np.array(truth)


def test_constrained_medoids_find_the_planted_groups():
    df, truth = planted([8, 7, 9, 8])
    got = clusters.constrained_medoids(df, "id", "v", np.zeros((32, 32), bool))
    assert sorted(map(tuple, got.groupby("cluster")["id"].apply(list))) == [tuple(np.flatnonzero(truth == c)) for c in range(4)]


def test_constraints_tiers_and_sizes():
    df, truth = planted([10, 10])
    n = 20
    hard, relaxed = np.zeros((n, n), bool), np.zeros((n, n), bool)
    hard[0, 1:10] = hard[1:10, 0] = True  # row 0 may not meet its own group
    relaxed[10, 11:] = relaxed[11:, 10] = True  # row 10 should not, but would be alone
    label = clusters.constrained_medoids(df, "id", "v", hard, relaxed, target=10, least=1)["cluster"].to_numpy()
    assert not any(label[a] == label[b] for a in range(n) for b in range(n) if hard[a, b])
    big, _ = planted([50])
    got = clusters.constrained_medoids(big, "id", "v", np.zeros((50, 50), bool), target=50, most=30)
    assert got.groupby("cluster").size().max() <= 50 and len(got) == 50
    every = np.ones((6, 6), bool) & ~np.eye(6, dtype=bool)
    assert clusters.constrained_medoids(planted([6])[0], "id", "v", every)["cluster"].nunique() == 6
    assert len(clusters.constrained_medoids(planted([1])[0], "id", "v", np.zeros((1, 1), bool))) == 1
    assert len(clusters.constrained_medoids(planted([2])[0], "id", "v", np.zeros((2, 2), bool))) == 2


def test_silhouette_as_by_hand():
    d = np.array([[0, 1, 4], [1, 0, 3], [4, 3, 0.0]])
    assert clusters.silhouette_of(d, np.array([0, 0, 1])) == pytest.approx(((4 - 1) / 4 + (3 - 1) / 3 + 0) / 3)
