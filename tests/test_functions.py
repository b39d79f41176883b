import pytest
from pyspark.sql import functions as F

from tracklattice.functions import music, scores, text, vectors


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_camelot_reads_every_notation(spark):
    said = {"8A": "8A", " 08a ": "8A", "12B": "12B", "13B": None, "0A": None, "8A - Am": "8A", "Am": "8A", "A minor": "8A", "Amin": "8A", "C": "8B", "Cmaj": "8B", "F♯m": "11A", "Gbm": "11A", "D♭": "3B", "A#": "6B", "E": "12B", "": None, "NK": None, "??": None, None: None, "H": None}
    assert values(spark, music.camelot, list(said)) == list(said.values())


def test_tempo_reads_units_and_limits(spark):
    said = {"128": 128.0, " 127,5 bpm": 127.5, "120 BPM": 120.0, "999": None, "-1": None, "0.0": None, "n/a": None, "": None, None: None, "66.30": 66.3}
    assert values(spark, music.tempo, list(said)) == list(said.values())


def test_wheel(spark):
    df = spark.createDataFrame([("1A", "12A"), ("8A", "8B"), ("1A", "7B"), ("??", "1A"), (None, "1A")], "a string, b string")
    assert [r[0] for r in df.select(music.wheel_distance(F.col("a"), F.col("b"))).collect()] == [1, 1, 7, None, None]
    assert values(spark, music.wheel_position, ["1A", "1B", "12B", "x", None]) == [0, 1, 23, None, None]
    assert values(spark, music.key_bucket, ["1A", "2A", "11B", "??"]) == ["01-02A", "01-02A", "11-12B", None]
    assert values(spark, music.tempo_bucket, [89.9, 90.0, 180.0, None], "double") == ["000-090", "090-105", "180+", None]


def test_text(spark):
    assert values(spark, text.normalise_artist, ["A Ft. B", "A,B and  C vs. D", None]) == ["a feat b", "a & b & c & d", ""]
    assert values(spark, text.normalise_title, ["Song (feat. X)", "Song ft. Y", "  Song  Two"]) == ["song", "song", "song two"]
    assert values(spark, text.normalise_mix, ["(Original)", "Extended Remix", "X Remix", ""]) == ["original mix", "extended mix", "x remix", ""]
    assert values(spark, lambda c: text.split_mix(c)[0], ["Song (X Remix)", "Song (Live)", "Song (2)"]) == ["Song", "Song", "Song (2)"]
    assert values(spark, lambda c: text.split_mix(c)[1], ["Song (X Remix)", "Song [Dub Version] ", "Song"]) == ["X Remix", "Dub Version", ""]
    assert values(spark, lambda c: text.tokens(c, 2, ("the",)), ["The Café - a Café"]) == [["cafe"]]
    assert values(spark, lambda c: text.ngrams(F.split(c, " "), 2), ["a b c", "a"]) == [["a b", "b c"], []]
    assert values(spark, text.compact_code, ["Deep House (Vocal)", ""]) == ["DEEP.HOUS.VOCA", ""]
    assert values(spark, text.clock_seconds, ["3:05", "1:00:01", "x", None]) == [185, 3601, None, None]
    assert values(spark, text.sanitised_cell, ["=1+1", "ok", None]) == ["'=1+1", "ok", None]
    assert values(spark, text.file_stem, ["a/b\\c.d.mp3", "x"]) == ["c.d", "x"]
    assert values(spark, text.safe_name, ['a/b:c?"']) == ["a_b_c__"]
    assert values(spark, text.year_of, ["2021-03", "x", None]) == [2021, None, None]


def test_scores(spark):
    assert values(spark, scores.energy_level, [0.0, 0.25, 0.6, 0.9], "double") == [1, 2, 4, 5]
    assert values(spark, scores.value_band, [0.1, 0.25, 0.7, 0.9, None], "double") == ["very_low", "low", "high", "very_high", None]
    assert values(spark, scores.confidence_level, [0.9, 0.7, 0.1], "double") == ["high", "medium-high", "unknown"]
    label, top, gap = scores.best_of({"B": F.lit(0.5), "A": F.lit(0.5), "C": F.lit(0.2)})
    assert spark.range(1).select(label, top, gap).collect()[0][:] == ("A", 0.5, 0.0)
    assert spark.range(1).select(scores.model_confidence(F.lit(0.5), F.lit(0.2), F.lit(3))).collect()[0][0] == pytest.approx(0.636)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.half_distance(vectors.unit(F.col("a")), vectors.unit(F.col("b")))).collect()
    assert rows[0][0] == pytest.approx(0.96) and rows[0][1] == pytest.approx(0.1414213, abs=1e-6) and rows[1][0] == 0.0
    assert spark.range(1).select(vectors.blended(F.lit(1.0), F.lit(0.0), F.lit(None).cast("double"))).collect()[0][0] == pytest.approx(0.45)
