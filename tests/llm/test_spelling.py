import random

import numpy as np
from pyspark.sql import functions as F

from tracklattice.llm import filters
from tracklattice.llm import spelling as S
from tracklattice.llm.text import typo_distance


def test_near_equal_against_brute_force(spark):
    rng = random.Random(2)
    base = ["kraukglusanvraukviteilfoseitpik", "kraukglusanvraukplimdandeizu", "kraukglusanvraukplimdandeizuremix", "jausgukziarndrestixreemdraugol1", "jausgukziarndrestixreemdraugol2"]
    words = set(base)
    for w in base:
        for _ in range(40):
            v = list(w)
            for _ in range(rng.choice((1, 1, 2, 3))):
                i, kind = rng.randrange(len(v) - 1), rng.randrange(4)
                if kind == 0:
                    del v[i]
                elif kind == 1:
                    v.insert(i, rng.choice("abcxyz"))
                elif kind == 2:
                    v[i] = rng.choice("abcxyz")
                else:
                    v[i], v[i + 1] = v[i + 1], v[i]
            words.add("".join(v))
    words = sorted(words)
    df = spark.createDataFrame([(w, w not in base) for w in words], "s string, probe boolean")
    got = {(r["a"], r["b"]) for r in S.near_equal(df).collect()}
    digits = lambda s: "".join(c for c in s if c.isdigit())
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if typo_distance(a, b, 2) <= 2 and digits(a) == digits(b) and not (a in base and b in base)}
    swaps = {(a, b) for a, b in want - got}
    assert got <= want and len(swaps) <= 0.02 * len(want), (len(swaps), len(want), sorted(swaps)[:3])


def test_corrections(spark):
    counts = [("remix", 400), ("remx", 3), ("remixx", 2), ("kestrel", 200), ("kestral", 5), ("kestrle", 1), ("abc", 1), ("abd", 900), ("9amber", 1), ("amber", 300), ("ember", 250), ("zzzzzz", 1)]
    got = {r["word"]: r["right"] for r in S.corrections(spark.createDataFrame(counts, "word string, n long")).collect()}
    assert got == {"remx": "remix", "remixx": "remix", "kestral": "kestrel", "kestrle": "kestrel"}
    assert S.corrections(spark.createDataFrame([], "word string, n long")).count() == 0


def test_corrected_by_map_and_by_join(spark, monkeypatch):
    rows = spark.createDataFrame([(1, ["remx", "a", "remx"], 5), (2, [], 6), (3, ["kestral"], None)], "id long, w array<string>, x int")
    fixes = spark.createDataFrame([("remx", "remix"), ("kestral", "kestrel")], "word string, right string")
    want = {1: (["remix", "a", "remix"], 5), 2: ([], 6), 3: (["kestrel"], None)}
    for most in (10, 0):
        monkeypatch.setattr(S, "SMALL_FIXES", most)
        assert {r["id"]: (r["w"], r["x"]) for r in S.corrected(rows, ["w"], fixes, "id").collect()} == want
        assert S.corrected(rows, ["w"], fixes.limit(0), "id").count() == 3


def test_filter_holds_all_keys_and_few_others(spark, monkeypatch):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    got = filters.filter_of(keys)
    own = np.array([r["key"] for r in keys.collect()], dtype=np.int64).view(np.uint64)
    others = np.random.default_rng(0).integers(0, 2**63, 20_000, dtype=np.uint64)
    assert got.holds(own).all() and got.holds(others).mean() < 0.01
    monkeypatch.setattr(filters, "MOST_BITS", 1 << 12)
    assert filters.filter_of(keys).holds(others).all()
    assert not filters.filter_of(keys.limit(0)).holds(others).any()


def sent_to_driver(spark, after=-1):
    """(last stage, bytes of the results of the stages after `after`)."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    each = [(s.stageId(), s.resultSize()) for s in map(stages.apply, range(stages.size()))]
    return max([after, *(i for i, _ in each)]), sum(n for i, n in each if i > after)


def test_one_set_of_a_filter_comes_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(filters, "MOST_BITS", 1 << 21)
    keys = spark.range(400_000).select(F.xxhash64("id").alias("key"))
    want = filters.Bits.empty(400_000)
    want.add(keys.toPandas()["key"].to_numpy().view(np.uint64))
    last, _ = sent_to_driver(spark)
    got = filters.filter_of(keys)
    assert (got.bits == want.bits).all()
    assert sent_to_driver(spark, last)[1] < 2 * len(got.bits)
