"""Codes, comment lines and exchange operators by hand, with empty tables, nulls and repeats."""

from pyspark.sql import functions as F

from tracklattice.functions import codes
from tracklattice.operators import exchange, features, linkage, metrics, taxonomy


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_codes(spark):
    df = spark.createDataFrame([("dark", "fv"), (" Sun-Set ", "No Vocals"), ("SUNSET", "spoken word"), (None, None), ("weird x", "rap")], "m string, v string")
    got = df.select(codes.mood_code(F.col("m")), codes.vocal_code(F.col("v")), codes.is_sung(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("DRK", "FVOC", True), ("SUN_SET", "INST", False), ("SUN", "SPK", True), ("", "", False), ("WEIRD_X", "RAP", True)]


def test_lines_and_back(spark):
    df = spark.createDataFrame([("9A", 3, "hypnotic", "inst", "drk.tech", "G007"), (None, None, None, None, None, None), ("1B", 5, "x", "y", "G123", "")], "k string, e int, m string, v string, c string, g string")
    lines = df.select(codes.tag_line(*[F.col(c) for c in "kemvcg"]).alias("line"))
    assert [r[0] for r in lines.collect()] == ["9A|E3|HYPN|INST|DRK.TECH|G007", "??|E?|??|??", "1B|E5|??|??"]
    bad = lines.unionByName(spark.createDataFrame([("9A|E7|HYPN|INST",), ("text",), (None,)], "line string"))
    got = bad.select(codes.tag_fields(F.col("line")).alias("x")).where("x is not null").select("x.*")
    assert values(got.na.fill("-"), "key", "energy", "mood", "vocal", "category", "grp") == [("1B", "5", "??", "??", "-", "-"), ("9A", "3", "HYPN", "INST", "DRK.TECH", "G007"), ("??", "?", "??", "??", "-", "-")]


def test_reviews(spark):
    q = spark.createDataFrame([("a", "Accept", "9A", None), ("b", "override", "9A", "Em"), ("c", "override", "9A", "zz"), ("d", "accept", "9A", None), ("e", None, "9A", None)], "track_id string, decision string, suggested string, chosen string")
    t = spark.createDataFrame([(x,) for x in "aabce"], "track_id string")
    assert values(exchange.reviewed(q, t).na.fill("-"), "track_id", "outcome", "key") == [("a", "accepted", "9A"), ("b", "overridden", "9A"), ("c", "skipped", "-"), ("d", "skipped", "-"), ("e", "skipped", "-")]
    assert exchange.reviewed(q.limit(0), t).count() == 0


def test_cues(spark):
    c = spark.createDataFrame([(1, "t", "hot", 2, 1.0, 1.0, "A"), (2, "t", "memory", -1, 5.0, 5.0, "M"), (3, "t", "loop", -1, 9.0, 8.0, "L"), (4, "u", "hot", 1, 1.0, 1.0, "A"), (5, "t", "hot", 9, 1.0, 1.0, "A"), (6, "t", "hot", 3, 1.0, 1.0, "C"), (7, "t", None, 3, 1.0, 1.0, "C")],
        "cue_id int, track_id string, kind string, num int, start double, end double, name string")
    m = spark.createDataFrame([("t", 0, 2, 7.0, 7.0, "other"), ("t", 0, -1, 5.0005, 5.0, "M")], "track_id string, type int, num int, start double, end double, name string")
    known = c.where("track_id = 't'")
    got = dict(values(exchange.cue_statuses(c, m, known, "replace-generated"), "cue_id", "status"))
    assert got == {1: "skipped_conflict", 2: "replaced", 3: "invalid", 4: "unmatched", 5: "invalid", 6: "inserted", 7: "invalid"}
    assert dict(values(exchange.cue_statuses(c, m, known, dry_run=True), "cue_id", "status"))[6] == "would_insert"
    assert set(dict(values(exchange.cue_statuses(c, m, known, "review-only"), "cue_id", "status")).values()) == {"review_only", "unmatched"}


def test_grid_payloads(spark):
    rows = spark.createDataFrame([("a", 2, 4.5), ("a", 1, 2.5)], "id string, place int, time double")
    stored = exchange.cue_grid(rows, "id", "place", "time")
    more = stored.unionByName(spark.createDataFrame([("b", '{"schema": "x", "bars": [1.0]}'), ("c", '{"schema": "%s", "bars": []}' % exchange.CUE_SCHEMA), ("d", "no json"), ("e", None)], "id string, payload string"))
    assert values(exchange.cue_grid_read(more, "id", "payload"), "id", "place", "time") == [("a", 0, 2.5), ("a", 1, 4.5)]


def test_partition_needs_two(spark):
    df = spark.createDataFrame([(1, "voc", 0.9), (2, "inst", 0.9), (3, "voc", 0.1)], "id int, v string, c double")
    part = lambda d: dict(values(exchange.soft_partition(d, codes.is_sung(F.col("v")), F.col("c"), 0.5, "part"), "id", "part"))
    assert part(df) == {1: 0, 2: 0, 3: 0}
    assert part(df.unionByName(df.withColumn("id", F.col("id") + 10))) == {1: 1, 2: 0, 3: 0, 11: 1, 12: 0, 13: 0}


def test_nested_keys(spark):
    df = spark.createDataFrame([(1, '{"a": {"plays": 3, "b": {"Play_count": "x"}}, "plays": null}'), (2, "[]"), (3, None)], "id int, p string")
    got = exchange.nested_keys(df, "id", "p", "play")
    assert values(got.where("value is not null"), "path", "value") == [("a.b.Play_count", "x"), ("a.plays", "3")]


def test_ranges_hold_a_hot_value(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 120.0).otherwise(F.col("id") * 1.0).alias("bpm"))
    rules = spark.createDataFrame([("slow", 60.0, 95.5), ("mid", 115.0, 124.0), ("none", 9.0, 1.0)], "rule string, low double, high double")
    got = features.range_priors(rows, "id", "bpm", rules, "rule", "low", "high")
    want = [(r["id"], n) for r in rows.collect() for n, a, b in (("slow", 60, 95.5), ("mid", 115, 124)) if a <= r["bpm"] <= b]
    assert values(got, "id", "rule") == sorted(want)


def test_reasons_are_distinct_and_ordered(spark):
    e = spark.createDataFrame([("t", f"r{i % 12:02}", float(i % 3)) for i in range(24)], "id string, why string, w double")
    got = features.explained(e, "id", "why", "w").collect()[0]["reasons"]
    assert len(got) == 8 and len(set(got)) == 8 and got[:4] == ["r02", "r05", "r08", "r11"]


def test_collapse_guard_keeps_the_flattest(spark):
    def said(k):
        return spark.range(12).select((F.col("id") % (k + 1)).alias("label"))

    tried = []
    model, labels, share = metrics.collapse_guard(lambda seed: tried.append(seed) or seed, said, 0.34)
    assert (model, tried, round(share, 3)) == (2, [0, 1, 2], 0.333) and labels.count() == 12
    assert metrics.collapse_guard(lambda seed: 0, said, 0.1, 2)[2] == 1.0


def test_three_levels(spark):
    e = spark.createDataFrame([("t", "F", None, None, 1.0), ("t", "F", "G", None, 1.0), ("t", "F", "G", "S", 0.5), ("t", None, "G", None, 9.0), ("t", "H", None, None, 0.0), ("u", "F", "G", "S", 0.1)], "id string, f string, g string, s string, d double")
    scores = taxonomy.path_scores(e, "id", "f", "g", "s", "d")
    assert values(scores.where("id = 't'").na.fill("-"), "family", "genre", "subgenre", "score") == [("F", "-", "-", 1.41), ("F", "G", "-", 1.26), ("F", "G", "S", 0.5)]
    assert values(taxonomy.deepest_path(scores, "id").na.fill("-"), "id", "family", "genre", "subgenre") == [("t", "F", "G", "S"), ("u", "-", "-", "-")]


def test_nearest_of_a_group_as_by_brute_force(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", float((i * 37) % 400) / 3 if i % 11 else None) for i in range(600)]
    hits = [(f"h{i:03}", "hot" if i % 3 == 0 else f"g{i % 5}", float((i * 53) % 500) / 4) for i in range(90)] + [("a", None, 1.0), ("b", "g1", None)]
    q, h = spark.createDataFrame(rows, "id int, g string, v double"), spark.createDataFrame(hits, "hit string, g string, v double")
    got = {r["id"]: (r["gap"], r["hit"]) for r in linkage.nearest_in_group(q, "id", h, "hit", "g", "v").collect()}
    want = {}
    for i, g, v in rows:
        near = sorted((round(abs(x - v), 6), n) for n, k, x in hits if k == g and x is not None and v is not None)
        if near:
            want[i] = near[0]
    assert got == want
    assert linkage.nearest_in_group(q, "id", h.limit(0), "hit", "g", "v").count() == 0
