"""Queries of sequence, rank and score operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklattice.functions import scores
from tracklattice.operators import ranks, sequence
from tracklattice.plans.registry import query
from tracklattice.session import table

_BAR = "b AS (SELECT user_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS bar FROM events)"


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event is one bar."""
    return sequence.numbered(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id")


@query(f"WITH {_BAR} SELECT user_id, CAST(bar // 4 AS INTEGER) AS bar, round(avg(value), 4) AS energy FROM b GROUP BY 1, 2 HAVING count(*) = 4")
def bars_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of four beats."""
    return sequence.bars(table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id").withColumn("energy", F.round("energy", 4))


@query(f"""
WITH {_BAR}, m AS (SELECT user_id, median(value) AS mid FROM b GROUP BY 1),
a AS (SELECT user_id, bar, min(value) OVER w AS low, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY user_id ORDER BY bar ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
s AS (SELECT a.user_id, min(bar) AS intro_end FROM a JOIN m USING (user_id) WHERE n = 8 AND low > mid * 0.1 GROUP BY 1),
x AS (SELECT m.user_id, intro_end, CASE WHEN intro_end IS NULL THEN 16 WHEN abs(intro_end - 16) <= abs(intro_end - 32) THEN 16 WHEN abs(intro_end - 32) <= abs(intro_end - 64) THEN 32 ELSE 64 END AS snapped FROM m LEFT JOIN s USING (user_id))
SELECT user_id, intro_end, snapped, round(CASE WHEN intro_end IS NULL THEN 0.2 ELSE greatest(0.2, 1 - abs(intro_end - snapped) / 16) END, 4) AS confidence FROM x
""")
def intro_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First bar of a sustained run, snapped to a usual intro length (a tenth of the median: events are rougher than bars)."""
    return sequence.intro(_bars(spark, sf_dir), "user_id", "bar", "value", share=0.1)


@query(f"""
WITH {_BAR}, n AS (SELECT user_id, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 8),
s AS (SELECT user_id, CAST(bar // (n // 8) AS INTEGER) AS seg, avg(value) AS m FROM b JOIN n USING (user_id) WHERE bar // (n // 8) < 8 GROUP BY 1, 2),
x AS (SELECT user_id, seg, CASE WHEN max(m) OVER (PARTITION BY user_id) > 0 THEN m / max(m) OVER (PARTITION BY user_id) ELSE 0 END AS m FROM s),
d AS (SELECT *, m - lag(m) OVER (PARTITION BY user_id ORDER BY seg) AS step FROM x),
f AS (SELECT *, abs(step) < 0.08 AS flat, lag(abs(step) < 0.08) OVER (PARTITION BY user_id ORDER BY seg) AS before FROM d),
g AS (SELECT user_id, var_pop(m) AS v, max(abs(step)) AS j, regr_slope(m, seg) AS s, CAST(count(*) FILTER (flat AND NOT coalesce(before, false)) AS INTEGER) AS plateaus FROM f GROUP BY 1)
SELECT user_id, round(v, 6) AS variance, round(j, 6) AS jump, round(s, 6) AS slope, plateaus,
  CASE WHEN v < 0.005 THEN 'L' WHEN v < 0.02 AND j < 0.15 THEN 'H' WHEN j > 0.40 THEN 'D' WHEN s > 0.05 AND plateaus >= 2 THEN 'B' WHEN s > 0.03 THEN 'G' ELSE 'H' END AS flow FROM g
""")
def flow_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of the energy over eight segments."""
    got = sequence.flow(_bars(spark, sf_dir), "user_id", "bar", "value")
    return got.select("user_id", *[F.round(c, 6).alias(c) for c in ("variance", "jump", "slope")], "plateaus", "flow")


@query(f"""
WITH {_BAR}, p AS (SELECT user_id, CAST(bar // 8 AS INTEGER) AS phrase, avg(value) AS e FROM b GROUP BY 1, 2),
q AS (SELECT user_id, quantile_cont(e, 0.25) AS lo, quantile_cont(e, 0.75) AS hi FROM p GROUP BY 1),
l AS (SELECT p.user_id, phrase, CASE WHEN e >= hi THEN 'peak' WHEN e <= lo THEN 'breakdown' ELSE 'groove' END AS section FROM p JOIN q USING (user_id)),
c AS (SELECT *, CASE WHEN lag(section) OVER (PARTITION BY user_id ORDER BY phrase) IS NOT DISTINCT FROM section THEN 0 ELSE 1 END AS new FROM l),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY phrase) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, section, min(phrase) * 8 AS start_bar, (max(phrase) + 1) * 8 AS end_bar FROM r GROUP BY 1, 2, 3
""")
def section_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases by quartile, merged into sections."""
    return sequence.sections(_bars(spark, sf_dir), "user_id", "bar", "value")


@query(f"""
WITH {_BAR}, m AS (SELECT user_id, median(value) AS mid, count(*) AS n FROM b GROUP BY 1),
w AS (SELECT user_id, bar, min(value) OVER f4 AS low4, count(*) OVER f4 AS n4, avg(value) OVER bef AS before, count(*) OVER bef AS nb, avg(value) OVER aft AS after, count(*) OVER aft AS na FROM b
  WINDOW f4 AS (PARTITION BY user_id ORDER BY bar ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), bef AS (PARTITION BY user_id ORDER BY bar ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), aft AS (PARTITION BY user_id ORDER BY bar ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
r AS (SELECT user_id, bar, CASE WHEN bar >= 16 AND na = 8 AND nb = 8 THEN round(after - before, 6) END AS rise FROM w),
best AS (SELECT user_id, bar AS drop_bar, rise FROM r WHERE rise IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rise DESC, bar) = 1),
mi AS (SELECT w.user_id, min(bar) AS mix_in FROM w JOIN m USING (user_id) WHERE n4 = 4 AND low4 > greatest(0.05, mid * 0.6) GROUP BY 1)
SELECT m.user_id, coalesce(mix_in, 0) AS mix_in, drop_bar, rise, CAST(greatest(0, floor((n - 16) / 8) * 8) AS INTEGER) AS mix_out,
  CASE WHEN rise IS NULL THEN 0.45 WHEN rise > 0.05 THEN 0.66 ELSE 0.55 END AS drop_confidence FROM m LEFT JOIN mi USING (user_id) LEFT JOIN best USING (user_id)
""")
def cue_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix-in, drop and mix-out bars."""
    return sequence.cue_points(_bars(spark, sf_dir), "user_id", "bar", "value")


@query("""
SELECT event_id, CAST(floor(floor(value) / 8) * 8 AS INTEGER) AS down, CAST(ceil(floor(value) / 8) * 8 AS INTEGER) AS up, CAST(round_even(floor(value) / 8, 0) * 8 AS INTEGER) AS near FROM events
""")
def phrase_snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars snapped to phrases in three ways."""
    bar = F.floor("value")
    return table(spark, sf_dir, "events").select("event_id", *[sequence.phrase_snap(bar, d).alias(n) for d, n in (("floor", "down"), ("ceil", "up"), ("nearest", "near"))])


@query(f"""
WITH {_BAR}, f AS (SELECT *, value > 20 AS a, row_number() OVER (PARTITION BY user_id ORDER BY bar) - row_number() OVER (PARTITION BY user_id, value > 20 ORDER BY bar) AS grp FROM b),
r AS (SELECT user_id, grp, count(*) AS n FROM f WHERE a GROUP BY 1, 2) SELECT user_id, CAST(count(*) AS BIGINT) AS runs, round(avg(n), 6) AS mean_run FROM r GROUP BY 1
""")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of active bars and their mean length."""
    return sequence.mean_run_length(_bars(spark, sf_dir), "user_id", "bar", F.col("value") > 20)


@query("""
WITH w AS (SELECT user_id, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS t, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT user_id, CAST(count(*) AS BIGINT) AS windows, round(avg(CASE WHEN m > 25 THEN 1.0 ELSE 0.0 END), 6) AS active_share FROM w GROUP BY 1
""")
def activity_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of half-day windows above a floor."""
    return sequence.activity(table(spark, sf_dir, "events"), "user_id", "ts", "12 hours", "value", 25.0)


@query("""
SELECT p_partkey, round((rank() OVER (ORDER BY p_size) - 1 + (count(*) OVER (PARTITION BY p_size) - 1) / 2) / (count(*) OVER () - 1), 6) AS size_rank,
  round((rank() OVER (ORDER BY p_retailprice) - 1 + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2) / (count(*) OVER () - 1), 6) AS price_rank FROM part
""")
def percentile_rank_avg_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-tie percentile ranks of two columns."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    got = ranks.percentile_ranks(ranks.percentile_ranks(part, "p_size", "size_rank"), "p_retailprice", "price_rank")
    return got.select("p_partkey", F.round("size_rank", 6).alias("size_rank"), F.round("price_rank", 6).alias("price_rank"))


@query("""
WITH q AS (SELECT quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM events) SELECT event_id, round(least(1.0, greatest(0.0, (value - a) / (b - a))), 6) AS stretched FROM events, q
""")
def contrast_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values stretched between two quantiles."""
    got = ranks.contrast_stretched(table(spark, sf_dir, "events").select("event_id", "value"), "value", "stretched")
    return got.select("event_id", F.round("stretched", 6).alias("stretched"))


_CLIP = "least(1.0, greatest(0.0, {}))"
_FEATURES = """
f AS (SELECT l_partkey AS id, avg(l_quantity) / 12 AS beat, avg(l_tax) * 50 AS onset, avg(l_extendedprice) / 20 AS centroid, avg(l_discount) * 6 AS loud, count(*) AS n,
  var_pop(l_tax) * 2000 AS onset_variance, var_pop(l_extendedprice) / 400 AS centroid_variance, avg(l_discount) AS chroma, avg(l_tax) / 2 AS flat, avg(l_quantity) AS low, avg(l_discount) * 60 AS flux
  FROM lineitem GROUP BY 1)
"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        (F.avg("l_quantity") / 12).alias("beat"), (F.avg("l_tax") * 50).alias("onset"), (F.avg("l_extendedprice") / 20).alias("centroid"), (F.avg("l_discount") * 6).alias("loud"), F.count("*").alias("n"),
        (F.var_pop("l_tax") * 2000).alias("onset_variance"), (F.var_pop("l_extendedprice") / 400).alias("centroid_variance"), F.avg("l_discount").alias("chroma"), (F.avg("l_tax") / 2).alias("flat"),
        F.avg("l_quantity").alias("low"), (F.avg("l_discount") * 60).alias("flux"),
    )


@query(f"""
WITH {_FEATURES}, c AS (SELECT id, 0.35 * {_CLIP.format('(beat - 1.5) / 2.5')} + 0.30 * {_CLIP.format('(onset - 1.0) / 2.0')} + 0.20 * {_CLIP.format('(centroid - 1000.0) / 2000.0')} + 0.15 * {_CLIP.format('(loud - 0.15) / 0.20')} AS c FROM f)
SELECT id, round(c, 5) AS composite, 1 + CAST(c >= 0.25 AS INTEGER) + CAST(c >= 0.42 AS INTEGER) + CAST(c >= 0.58 AS INTEGER) + CAST(c >= 0.75 AS INTEGER) AS level,
  round(least(1.0, least(abs(c - 0.25), abs(c - 0.42), abs(c - 0.58), abs(c - 0.75)) / 0.10), 5) AS confidence,
  CASE WHEN c < 0.25 THEN 'very_low' WHEN c < 0.45 THEN 'low' WHEN c < 0.65 THEN 'mid' WHEN c < 0.82 THEN 'high' ELSE 'very_high' END AS band,
  CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.70 THEN 'medium-high' WHEN c >= 0.55 THEN 'medium' WHEN c >= 0.35 THEN 'low' ELSE 'unknown' END AS certainty FROM c
""")
def energy_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy composite, level, confidence and bands from averaged features."""
    f = _features(spark, sf_dir)
    c = scores.energy_composite(F.col("beat"), F.col("onset"), F.col("centroid"), F.col("loud"))
    f = f.select("id", c.alias("c"))
    return f.select(
        "id", F.round("c", 5).alias("composite"), scores.energy_level(F.col("c")).alias("level"), F.round(scores.energy_confidence(F.col("c")), 5).alias("confidence"), scores.value_band(F.col("c")).alias("band"),
        scores.confidence_level(F.col("c")).alias("certainty"),
    )


_MOODS = f"""
{_FEATURES}, v AS (SELECT id, onset_variance / (onset * onset + 1e-8) AS ov, centroid_variance / (centroid * centroid + 1e-8) AS cv, * EXCLUDE (id) FROM f),
m AS (SELECT id,
  {_CLIP.format("least(1.0, chroma / 0.10) * 0.55 + " + _CLIP.format("(0.025 - flat) / 0.015") + " * 0.20")} AS mel,
  {_CLIP.format("0.25 * " + _CLIP.format("(ov - 2) / 2") + " + 0.30 * " + _CLIP.format("(flat - 0.018) / 0.030") + " + 0.25 * " + _CLIP.format("(low - 50) / 25") + " + 0.20 * " + _CLIP.format("(flux - 2.5) / 2.5"))} AS drk,
  {_CLIP.format("0.70 * " + _CLIP.format("(loud - 0.40) / 0.15") + " + 0.44 * " + _CLIP.format("(0.03 - flat) / 0.02"))} AS trib,
  {_CLIP.format("0.45 * " + _CLIP.format("(42 - low) / 12") + " + 0.30 * " + _CLIP.format("(1.5 - onset) / 0.8") + " + 0.25 * " + _CLIP.format("(1.5 - ov) / 1.0"))} AS raw,
  {_CLIP.format("(1.0 - least(1.0, cv * 10)) * 0.5 + 0.50 * " + _CLIP.format("(2 - ov) / 1.5"))} AS hypn,
  {_CLIP.format("0.35 * " + _CLIP.format("(2000 - centroid) / 1000") + " + 0.35 * " + _CLIP.format("(0.22 - loud) / 0.10") + " + 0.30 * " + _CLIP.format("(low - 50) / 20"))} AS deep,
  {_CLIP.format("1.0 * " + _CLIP.format("(cv - 0.75) / 0.40"))} AS acid,
  {_CLIP.format("0.50 * " + _CLIP.format("(1.5 - onset) / 1.0") + " + 0.50 * " + _CLIP.format("(0.20 - loud) / 0.08"))} AS atm FROM v),
l AS (SELECT id, 'MEL' AS mood, round(mel, 6) AS s FROM m UNION ALL SELECT id, 'DRK', round(drk, 6) FROM m UNION ALL SELECT id, 'TRIB', round(trib, 6) FROM m UNION ALL SELECT id, 'RAW', round(raw, 6) FROM m
  UNION ALL SELECT id, 'HYPN', round(hypn, 6) FROM m UNION ALL SELECT id, 'DEEP', round(deep, 6) FROM m UNION ALL SELECT id, 'ACID', round(acid, 6) FROM m UNION ALL SELECT id, 'ATM', round(atm, 6) FROM m),
r AS (SELECT *, row_number() OVER w AS place, lead(s) OVER w AS next FROM l WINDOW w AS (PARTITION BY id ORDER BY s DESC, mood)),
best AS (SELECT id, mood, s AS score, round(s - next, 6) AS margin FROM r WHERE place = 1)
"""


def _moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    names = {"onset_variance": "onset_variance", "onset_density": "onset", "centroid_variance": "centroid_variance", "centroid": "centroid", "chroma_variance": "chroma", "flatness": "flat", "low": "low", "flux": "flux", "percussive": "loud", "rms": "loud"}
    label, score, margin = scores.best_of({k: F.round(c, 6) for k, c in scores.mood_scores({k: F.col(v) for k, v in names.items()}).items()})
    return f.select("id", label.alias("mood"), score.alias("score"), F.round(margin, 6).alias("margin"))


@query(f"WITH {_MOODS} SELECT * FROM best")
def mood_scores_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight mood scores, the best and its margin."""
    return _moods(spark, sf_dir)


@query(f"""
WITH {_MOODS} SELECT best.id, mood, CASE WHEN f.n % 7 = 0 THEN 'BREAKDOWN' WHEN e <= 2 AND f.n % 7 = 1 THEN 'TOOL' WHEN e <= 2 AND mood IN ('ATM', 'CIN', 'DEEP', 'SUB', 'SUN') THEN 'RESET' WHEN e <= 2 THEN 'TOOL'
  WHEN e >= 4 THEN 'PEAK' WHEN e = 3 AND mood IN ('MEL', 'EMO', 'EUP', 'SOUL', 'WARM', 'ATM', 'CIN', 'DEEP', 'SUN') THEN 'BRIDGE' ELSE 'DRIVER' END AS role
FROM best JOIN f ON best.id = f.id JOIN (SELECT id, 1 + CAST(low >= 23 AS INTEGER) + CAST(low >= 25 AS INTEGER) + CAST(low >= 26 AS INTEGER) + CAST(low >= 27 AS INTEGER) AS e FROM f) x ON x.id = f.id
""")
def role_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role from flow, energy and mood by the first rule that holds."""
    f = _features(spark, sf_dir).withColumn("e", sum((F.when(F.col("low") >= t, 1).otherwise(0) for t in (23, 25, 26, 27)), F.lit(1)))
    flow = F.when(F.col("n") % 7 == 0, "B").when(F.col("n") % 7 == 1, "L").otherwise("H")
    return _moods(spark, sf_dir).join(f.select("id", "e", flow.alias("flow")), "id").select("id", "mood", scores.role(F.col("flow"), F.col("e"), F.col("mood")).alias("role"))


@query(f"""
WITH {_FEATURES}, v AS (SELECT id, -45 + low AS ratio, flux / 8 AS act FROM f),
p AS (SELECT *, {_CLIP.format("0.55 * " + _CLIP.format("(ratio + 40) / 30") + " + 0.45 * " + _CLIP.format("act / 0.7"))} AS pres FROM v)
SELECT id, round(pres, 5) AS presence, CASE WHEN ratio < -35 THEN false WHEN ratio < -30 AND act < 0.20 THEN false WHEN ratio > -25 OR act > 0.40 THEN true ELSE pres > 0.45 END AS vocal FROM p
""")
def vocal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocal presence from a level and an activity share."""
    f = _features(spark, sf_dir).select("id", (F.col("low") - 45).alias("ratio"), (F.col("flux") / 8).alias("act"))
    return f.select("id", F.round(scores.vocal_presence(F.col("ratio"), F.col("act")), 5).alias("presence"), scores.has_vocals(F.col("ratio"), F.col("act")).alias("vocal"))


@query("""
WITH j AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type, event_id FROM events),
r AS (SELECT user_id, event_type, max(k) AS best, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1, 2), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY best DESC, event_type) AS INTEGER) AS place FROM r)
SELECT * FROM p WHERE place <= 3
""")
def json_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three kinds of each user by a score inside a JSON column."""
    k = F.from_json("props", "k INT")["k"]
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(k).alias("best"), F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("best"), "event_type")
    return per.withColumn("place", F.row_number().over(w)).where("place <= 3")
