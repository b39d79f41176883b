import numpy as np
from pyspark.sql import functions as F

from tracklattice.llm import linkage as L

P = "row_id long, name string, artists array<string>, duration_sec double, confidence double"
FILES = "file_no long, title_tokens array<string>, all_tokens array<string>, audio_duration_sec double, exact string"


def frames(spark, copies=30):
    words = ["amber", "bramble", "cinder", "dovetail", "ember", "fathom", "granite", "harbour", "indigo", "juniper", "kestrel", "lagoon"]
    people = [("nora", "vale"), ("ivan", "stone"), ("mia", "frost"), ("otto", "lane")]
    rows, files, k = [], [], 0
    for i in range(copies):
        a, b = words[i % 12], words[(i * 5 + 3 + i // 12) % 12]
        who = people[i % 4]
        rows.append((k, f"{a.title()} {b.title()}", [f"{who[0].title()} {who[1].title()}"], 200.0 + i * 7, 1.0))
        files.append((k, [a, b], [*who, a, b], 200.4 + i * 7, "x"))
        k += 1
    return rows, files


def run(spark, rows, files):
    got = L.linked_pairs(spark.createDataFrame(rows, P), spark.createDataFrame(files, FILES)).collect()
    return {(r["row_id"], r["file_no"]) for r in got if r["exact"] and r["confidence"] >= 0.5}


def test_pairs_versions_and_noise(spark):
    rows, files = frames(spark)
    rows += [
        (100, "AMBER DOVETAIL (Ivan Stone Remix)", ["Nora Vale"], 200_000.0, 1.0), (101, "Amber Dovetail - Original Mix", ["Vale, Nora"], None, 1.0), (102, "Ambér  Dovetail (feat. Mia Frost)", ["The Nora Vale", "Mia Frost"], 0.0, 1.0),
        (103, None, None, None, 1.0), (104, "", [], float("nan"), 1.0), (105, "Amber Dovetail", ["Nora Vale"], 200.0, 1.0), (105, "Amber Dovetail", ["Nora Vale"], 200.0, 1.0),
    ]
    files += [(200, ["amber", "dovetail", "ivan", "stone", "remix"], ["nora", "vale", "amber", "dovetail", "ivan", "stone", "remix"], 200.0, "x"), (201, None, None, None, "x"), (202, [], [], 0.0, "x")]
    got = run(spark, rows, files)
    assert {(i, i) for i in range(30)} <= got
    assert (100, 200) in got and (101, 0) in got and (102, 0) in got and (105, 0) in got
    assert not {p for p in got if p[0] in (103, 104) or p[1] in (201, 202)} and (101, 200) not in got and (100, 0) not in got


def test_short_titles_without_a_duration_meet(spark):
    rows, files = frames(spark)
    rows += [(200, "Hello", ["Adele"], None, 1.0), (201, "Hello", ["Adele"], 0.0, 1.0), (202, "Amber Dovetail", ["Nora Vale"], None, 1.0), (203, "Quartz Opal", ["Zephyr Moss"], None, 1.0)]
    files += [(200, ["hello"], ["adele", "hello"], 180.0, "x"), (201, ["hello"], ["adele", "hello"], None, "x"), (203, ["quartz", "opla"], ["zephyr", "moss", "quartz", "opla"], None, "x")]
    got = run(spark, rows, files)
    assert {(200, 200), (200, 201), (201, 200), (201, 201), (202, 0)} <= got
    assert not {p for p in got if p[0] in (200, 201) and p[1] < 200}


def test_blocking_loses_next_to_none_of_the_pairs_that_brute_force_finds(spark, monkeypatch):
    data = [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("playlist_tracks", "file_entries")]
    data[0] = data[0].where("row_id % 3 = 0")  # a fixture: every pair of what is left is compared
    pairs = lambda: {(r["row_id"], r["file_no"]) for r in L.linked_pairs(*data).where("exact").collect()}
    blocked = pairs()
    monkeypatch.setattr(L, "_candidates", lambda pc, fc: pc.join(fc, pc["kind"] == fc["kind"]).select("p", "f"))
    every = pairs()
    assert blocked <= every and len(blocked) >= 0.995 * len(every), (len(blocked), len(every))


def test_lower_end_of_a_share(spark):
    got = [spark.range(1).select(L._lower_share(F.lit(k), n)).collect()[0][0] for k, n in ((5, 100), (50, 1000), (5000, 100_000), (0, 10))]
    assert got[0] < got[1] < got[2] < 0.05 and abs(got[3]) < 1e-12


def test_empty_tables(spark):
    rows, files = frames(spark, 3)
    assert run(spark, [], files) == set() and run(spark, rows, []) == set()


def test_parts():
    assert L.title_parts("Foo Bar [live, Rome]")[:2] == (["foo", "bar"], ["live", "rome"])
    assert L.title_parts("Foo - X Y Remix")[:2] == (["foo"], ["remix", "x", "y"])
    assert L.title_parts("Foo (Original Mix) - Remastered")[:2] == (["foo"], [])
    assert L.artist_parts(["Stone, Ivan", "Mia Frost & X Y"])[0] == ["stone", "ivan"]
    assert L.artist_parts(None) == ([], [], [])


def test_em_separates_two_classes():
    rng = np.random.default_rng(0)
    match = rng.random(4000) < 0.2
    levels = np.stack([np.where(match, rng.random(4000) < p, rng.random(4000) < q) for p, q in ((0.95, 0.1), (0.9, 0.2), (0.97, 0.3))], axis=1).astype(int)
    patterns, counts = np.unique(levels, axis=0, return_counts=True)
    post, fitted = L.expectation_maximisation(patterns, counts.astype(float))
    assert 0.12 < fitted["prior"] < 0.3
    assert post[(patterns == 1).all(axis=1)][0] > 0.9 and post[(patterns == 0).all(axis=1)][0] < 0.05


def test_a_third_of_the_rows_is_one_recording(spark):
    rows, files = frames(spark, 40)
    rows += [(1000 + i, "Amber Dovetail", ["Nora Vale"], 200.0 + (i % 7) / 10, 1.0) for i in range(60)]
    files += [(1000 + i, ["amber", "dovetail"], ["nora", "vale", "amber", "dovetail"], 200.5, "x") for i in range(20)]
    got = run(spark, rows, files)
    assert sum(1 for a, b in got if a >= 1000 and b >= 1000) == 1200
