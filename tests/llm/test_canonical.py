import random

from pyspark.sql import functions as F

from tracklattice.llm import canonical as C


def tables(spark):
    ref = spark.createDataFrame([(1, "Cobalt Ambient", ["Tixvian"], "x"), (2, "Cobalt Step", None, "x"), (3, "Salt & Slate Wave", [], "x"), (4, "Harbour Techno", ["Rorcond", None, ""], "x")], "gid long, genre string, aliases array<string>, value string")
    return ref


def mapped(spark, values, ref=None):
    df = spark.createDataFrame([(v,) for v in values], "genres string")
    got = C.map_values(df, tables(spark) if ref is None else ref, "gid", "genre", "aliases").collect()
    return {r["value"]: r["entry"] for r in got}


def test_spellings(spark):
    want = {
        "cobalt ambient": 1, "COBALT-AMBIENT": 1, "Ambient, Cobalt": 1, "Coba. Ambient": 1, "Cblt Ambient": 1, "Cоbаlt Аmbient": 1, "Ｃｏｂａｌｔ Ａｍｂｉｅｎｔ": 1, "C0b4lt 4mb13nt": 1,
        "genre: Cobalt Ambient": 1, "Cobalt Ambient 2021": 1, "Cboalt Ambient": 1, "#cobaltstep": 2, "Salt and Slate Wave": 3, "tixvain": 1, "Harbour​ Techno": 4, "rorcond": 4,
        "misc": -1, "": -1, "???": -1, "n/a": -1, "Zither Polka": -1, "x" * 5000: -1,
    }
    got = mapped(spark, [*want, *want, None])
    assert got == want


def test_same_distance_to_two_entries_is_no_match(spark):
    ref = spark.createDataFrame([(1, "abcdef", []), (2, "abcdeg", [])], "gid long, genre string, aliases array<string>")
    assert mapped(spark, ["abcdeh", "abcdef"], ref) == {"abcdeh": -1, "abcdef": 1}


def test_retrieval_misses_no_spelling_above_the_threshold():
    rng = random.Random(4)
    names = ["".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randint(4, 12))) + rng.choice(["", " house", " wave"]) for _ in range(120)]
    index = C.NameIndex([(i, n, []) for i, n in enumerate(names)])
    rows = [C.grams(w) for w in index.written]
    weigh = lambda g: {x: c * index.weight.get(x, index.new) for x, c in g.items()}
    unit = lambda g: {x: c / sum(v * v for v in g.values()) ** 0.5 for x, c in g.items()}
    rows = [unit(weigh(g)) for g in rows]
    for n in rng.sample(names, 40):
        s = list("".join(C.squash(n)))
        s[rng.randrange(len(s))] = "x"
        q = unit(weigh(C.grams("".join(s))))
        want = {i: sum(q[x] * r.get(x, 0.0) for x in q) for i, r in enumerate(rows)}
        at, score = index.scores("".join(s), 0.38)
        assert set(at.tolist()) == {i for i, x in want.items() if x >= 0.38}
        assert all(abs(want[i] - x) < 1e-9 for i, x in zip(at.tolist(), score.tolist()))


def test_names_within_the_margin_are_told_apart_by_letters(spark):
    ref = spark.createDataFrame([(i, f"Mudia{x}", []) for i, x in enumerate("rstvw")], "gid long, genre string, aliases array<string>")
    assert mapped(spark, ["mduiat", "mudiaz"], ref) == {"mduiat": 2, "mudiaz": -1}


def test_a_value_that_fills_a_third_of_the_rows(spark):
    values = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "cobalt-step").otherwise(F.concat(F.lit("Salt & Slate Wave "), F.col("id") % 40)).alias("value"))
    got = C.map_values(values, tables(spark), "gid", "genre", "aliases").collect()
    assert len(got) == 41 and {r["entry"] for r in got} == {2, 3}


def test_empty_tables(spark):
    assert mapped(spark, ["a"], tables(spark).limit(0)) == {"a": -1}
    df = spark.createDataFrame([], "genres string")
    assert C.map_values(df, tables(spark), "gid", "genre", "aliases").count() == 0


def test_blocks_of_the_reference(spark, monkeypatch):
    monkeypatch.setattr(C, "REFERENCE_BLOCK", 1)
    assert mapped(spark, ["cobalt step!", "Harbor Techno"]) == {"cobalt step!": 2, "Harbor Techno": 4}


def test_join_back_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(C, "SMALL_MAPPING", 0)
    rows = spark.createDataFrame([(i, 0, "a" if i % 3 else "b") for i in range(30)], "row_id long, pos long, value string")
    mapping = spark.createDataFrame([("a", 1), ("b", 2)], "value string, entry long")
    assert C.apply_mapping(rows, mapping).count() == 30
