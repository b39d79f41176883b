"""Operators over ordered measurements of a track: bars, intros, sections, flow, cue points, runs.

A sequence is the ordered rows of one key. Windows are partitioned by that key and every frame is a few rows wide, so memory does
not grow with the length of a sequence; statistics of a whole sequence come from aggregates joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, key: str, *order: str, name: str = "bar") -> DataFrame:
    """Place of each row in its sequence, from 0."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def bars(beats: DataFrame, key: str, value: str, *order: str, per_bar: int = 4) -> DataFrame:
    """Mean of each full run of per_bar beats; an incomplete last bar is dropped."""
    n = numbered(beats, key, *order, name="beat").withColumn("bar", F.floor(F.col("beat") / per_bar).cast("int"))
    return n.groupBy(key, "bar").agg(F.avg(value).alias("energy"), F.count("*").alias("n")).where(F.col("n") == per_bar).drop("n")


def phrase_snap(bar: Column, direction: str = "nearest", phrase: int = 8) -> Column:
    """Multiple of the phrase length below, above or nearest (half to even)."""
    x = bar / phrase
    return (F.floor(x) if direction == "floor" else F.ceil(x) if direction == "ceil" else F.bround(x)).cast("int") * phrase


def intro(rows: DataFrame, key: str, bar: str, energy: str, run: int = 8, share: float = 0.8) -> DataFrame:
    """Rows (key, intro_end, snapped, confidence): the first bar from which `run` bars all exceed a share of the median.

    snapped is the nearest of 16, 32 and 64, the smaller on ties; without such a bar 16 at the least confidence.
    """
    mid = rows.groupBy(key).agg(F.median(energy).alias("mid"))
    w = Window.partitionBy(key).orderBy(bar).rowsBetween(0, run - 1)
    ahead = rows.withColumn("low", F.min(energy).over(w)).withColumn("n", F.count("*").over(w)).join(mid, key)
    start = ahead.where((F.col("n") == run) & (F.col("low") > F.col("mid") * share)).groupBy(key).agg(F.min(bar).alias("intro_end"))
    snap = F.array_min(F.array(*[F.struct(F.abs(F.col("intro_end") - s).alias("d"), F.lit(s).alias("s")) for s in (16, 32, 64)]))["s"]
    out = mid.select(key).join(start, key, "left").withColumn("snapped", F.coalesce(F.when(F.col("intro_end").isNotNull(), snap), F.lit(16)))
    confidence = F.when(F.col("intro_end").isNull(), F.lit(0.2)).otherwise(F.greatest(F.lit(0.2), 1 - F.abs(F.col("intro_end") - F.col("snapped")) / 16))
    return out.withColumn("confidence", F.round(confidence, 4))


def flow(rows: DataFrame, key: str, bar: str, energy: str, parts: int = 8, tolerance: float = 0.08) -> DataFrame:
    """Rows (key, variance, jump, slope, plateaus, flow) from the means of `parts` equal segments over their largest.

    Bars after the last full segment are dropped; sequences of fewer bars than segments give no row. flow: L level, H steady,
    D drop, B build-up, G growing.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= parts)
    seg = rows.join(n, key).withColumn("seg", F.floor(F.col(bar) / F.floor(F.col("n") / parts)).cast("int")).where(F.col("seg") < parts)
    means = seg.groupBy(key, "seg").agg(F.avg(energy).alias("m"))
    listed = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "m"))), lambda x: x["m"]).alias("ms"))  # `parts` values
    top = F.array_max("ms")
    listed = listed.withColumn("ms", F.transform("ms", lambda x: F.when(top > 0, x / top).otherwise(0.0)))
    mean = F.aggregate("ms", F.lit(0.0), lambda a, x: a + x) / parts
    steps = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.col("ms")[i] - F.col("ms")[i - 1])
    middle = (parts - 1) / 2
    spread = sum((i - middle) ** 2 for i in range(parts))
    listed = listed.select(
        key,
        (F.aggregate(F.transform("ms", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / parts).alias("variance"),
        F.array_max(F.transform(steps, lambda s: F.abs(s))).alias("jump"),
        (F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: (i - F.lit(middle)) * (F.col("ms")[i] - mean)), F.lit(0.0), lambda a, x: a + x) / spread).alias("slope"),
        F.transform(steps, lambda s: F.abs(s) < tolerance).alias("flat"),
    )
    starts = F.filter(F.sequence(F.lit(0), F.lit(parts - 2)), lambda i: F.col("flat")[i] & F.when(i == 0, F.lit(True)).otherwise(~F.coalesce(F.get("flat", i - 1), F.lit(False))))
    listed = listed.withColumn("plateaus", F.size(starts)).drop("flat")
    v, j, s = F.col("variance"), F.col("jump"), F.col("slope")
    kind = F.when(v < 0.005, "L").when((v < 0.02) & (j < 0.15), "H").when(j > 0.40, "D").when((s > 0.05) & (F.col("plateaus") >= 2), "B").when(s > 0.03, "G").otherwise("H")
    return listed.withColumn("flow", kind)


def islands(rows: DataFrame, key: str, place: str, label: str) -> DataFrame:
    """Runs of neighbouring rows with one label: (key, run, label, first, last)."""
    w = Window.partitionBy(key).orderBy(place)
    flagged = rows.withColumn("new", F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    run = flagged.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "run").agg(F.first(label).alias(label), F.min(place).alias("first"), F.max(place).alias("last"))


def sections(rows: DataFrame, key: str, bar: str, energy: str, phrase: int = 8) -> DataFrame:
    """Phrases labelled peak, breakdown or groove by the quartiles of the sequence's phrases, equal neighbours merged."""
    phrases = rows.groupBy(key, F.floor(F.col(bar) / phrase).cast("int").alias("phrase")).agg(F.avg(energy).alias("e"))
    edges = phrases.groupBy(key).agg(F.percentile("e", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    named = phrases.join(edges, key).withColumn("section", F.when(F.col("e") >= F.col("q")[1], "peak").when(F.col("e") <= F.col("q")[0], "breakdown").otherwise("groove"))
    return islands(named, key, "phrase", "section").select(key, "run", "section", (F.col("first") * phrase).alias("start_bar"), ((F.col("last") + 1) * phrase).alias("end_bar"))


def cue_points(rows: DataFrame, key: str, bar: str, energy: str, from_bar: int = 16, phrase: int = 8) -> DataFrame:
    """Rows (key, mix_in, drop_bar, rise, mix_out, drop_confidence).

    mix_in: first bar of four above 0.6 of the median (at least 0.05), else 0; drop_bar: the largest rise from the mean of the phrase before to that of
    the phrase from it, from from_bar on, the earlier on ties; mix_out: the last phrase start with two phrases left.
    """
    stat = rows.groupBy(key).agg(F.median(energy).alias("mid"), F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(bar)
    wide = rows.withColumns({
        "low4": F.min(energy).over(w.rowsBetween(0, 3)), "n4": F.count("*").over(w.rowsBetween(0, 3)), "before": F.avg(energy).over(w.rowsBetween(-phrase, -1)),
        "after": F.avg(energy).over(w.rowsBetween(0, phrase - 1)), "n_after": F.count("*").over(w.rowsBetween(0, phrase - 1)), "n_before": F.count("*").over(w.rowsBetween(-phrase, -1)),
    }).join(stat, key)
    rise = F.when((F.col(bar) >= from_bar) & (F.col("n_after") == phrase) & (F.col("n_before") == phrase), F.round(F.col("after") - F.col("before"), 6))
    got = wide.withColumn("rise", rise).groupBy(key).agg(
        F.coalesce(F.min(F.when((F.col("n4") == 4) & (F.col("low4") > F.greatest(F.lit(0.05), F.col("mid") * 0.6)), F.col(bar))), F.lit(0)).alias("mix_in"),
        F.min(F.when(F.col("rise").isNotNull(), F.struct((-F.col("rise")).alias("r"), F.col(bar).alias("b")))).alias("x"), F.first("n").alias("n"),
    )
    out = F.greatest(F.lit(0), F.floor((F.col("n") - 2 * phrase) / phrase).cast("int") * phrase)
    return got.select(
        key, "mix_in", F.col("x.b").alias("drop_bar"), (-F.col("x.r")).alias("rise"), out.alias("mix_out"), F.when(F.col("x").isNull(), 0.45).when(-F.col("x.r") > 0.05, 0.66).otherwise(0.55).alias("drop_confidence")
    )


def bar_time(times: Column, bar: Column, seconds_per_bar: Column) -> Column:
    """Time of a bar from its list, extrapolated past the end by the last step (or the given length with fewer than two)."""
    n = F.size(times)
    step = F.when(n >= 2, F.get(times, n - 1) - F.get(times, n - 2)).otherwise(seconds_per_bar)
    return F.when(bar < n, F.get(times, bar)).when(n > 0, F.get(times, n - 1) + (bar - n + 1) * step).otherwise(bar * seconds_per_bar)


def beat_grid(bpm: Column, seconds: Column) -> Column:
    """Times of the beats of a tempo up to a length."""
    count = F.floor(seconds * bpm / 60).cast("int")
    return F.when((bpm > 0) & (count > 0), F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * F.lit(60.0) / bpm)).otherwise(F.array().cast("array<double>"))


def mean_run_length(rows: DataFrame, key: str, place: str, active: Column) -> DataFrame:
    """Rows (key, runs, mean_run): how many runs of active rows there are, and their mean length."""
    marked = rows.withColumn("__a", active)
    runs = islands(marked, key, place, "__a").where("__a")
    return runs.groupBy(key).agg(F.count("*").alias("runs"), F.round(F.avg(F.col("last") - F.col("first") + 1), 6).alias("mean_run"))


def activity(rows: DataFrame, key: str, time: str, width: str, value: str, floor: float) -> DataFrame:
    """Rows (key, windows, active_share): share of the key's tumbling windows whose mean value is above a floor."""
    per = rows.groupBy(key, F.window(time, width).alias("w")).agg(F.avg(value).alias("m"))
    return per.groupBy(key).agg(F.count("*").alias("windows"), F.round(F.avg((F.col("m") > floor).cast("double")), 6).alias("active_share"))


#: extra markers: name, the cue it hangs on, bars from it, bars of its loop (0: none)
MARKERS = [("start", "mix_in", -16, 0), ("mix_in", "mix_in", 0, 8), ("before_drop", "drop_bar", -8, 0), ("drop", "drop_bar", 0, 0), ("mix_out", "mix_out", 0, 8), ("end", "mix_out", 16, 0)]


def markers(cues: DataFrame, key: str, n_bars: Column, review_below: float = 0.65) -> DataFrame:
    """Rows (key, marker, bar, loop_end, confidence, review): the cue points in order with the markers that hang on them.

    The drop comes after mix-in and mix-out after the drop: a cue out of order moves a phrase behind the one before it and its
    confidence is 0.5 at most. Markers outside the track are left out; a loop needs its bars to be there.
    """
    drop0 = F.coalesce("drop_bar", F.col("mix_in") + 8)
    drop = F.greatest(drop0, F.col("mix_in") + 8)
    out = F.greatest(F.col("mix_out"), drop + 8)
    moved = (drop != drop0) | (out != F.col("mix_out"))
    confidence = F.when(moved, F.least(F.col("drop_confidence"), F.lit(0.5))).otherwise(F.col("drop_confidence"))
    at = {"mix_in": F.col("mix_in"), "drop_bar": drop, "mix_out": out}
    cells = [F.struct(F.lit(name).alias("marker"), (at[cue] + shift).cast("int").alias("bar"), F.lit(loop).alias("loop")) for name, cue, shift, loop in MARKERS]
    each = cues.select(key, n_bars.alias("n"), confidence.alias("confidence"), F.explode(F.array(*cells)).alias("m")).where((F.col("m.bar") >= 0) & (F.col("m.bar") < F.col("n")))
    loop_end = F.when((F.col("m.loop") > 0) & (F.col("m.bar") + F.col("m.loop") <= F.col("n")), F.col("m.bar") + F.col("m.loop"))
    return each.select(key, "m.marker", "m.bar", loop_end.alias("loop_end"), "confidence", (F.col("confidence") < review_below).alias("review"))


# fixed values: published tonal profiles of major and minor keys
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def profile_keys(rows: DataFrame, id_col: str, chroma: Column) -> DataFrame:
    """Rows (id, tonic, mode, correlation, margin): the best of 24 correlations of a 12-element chroma with the rotated profiles."""
    spark = rows.sparkSession
    dim = [(t, m, i, float(p[(i - t) % 12])) for m, p in (("major", MAJOR_PROFILE), ("minor", MINOR_PROFILE)) for t in range(12) for i in range(12)]
    profiles = spark.createDataFrame(dim, "tonic int, mode string, i int, w double")
    long = rows.select(id_col, F.posexplode(chroma).alias("i", "c"))
    corr = long.join(F.broadcast(profiles), "i").groupBy(id_col, "tonic", "mode").agg(F.round(F.corr("c", "w"), 6).alias("r"))
    w = Window.partitionBy(id_col).orderBy(F.desc("r"), "mode", "tonic")
    ranked = corr.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("r").over(w)).where("place = 1")
    return ranked.select(id_col, "tonic", "mode", F.col("r").alias("correlation"), F.round(F.col("r") - F.col("next"), 6).alias("margin"))
