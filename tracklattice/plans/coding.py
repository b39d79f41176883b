"""Queries of mood and vocal codes, full scorecards, comment lines, feature blocks and their inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.functions import codes, scores
from tracklattice.functions.music import is_wheel_code
from tracklattice.operators import features
from tracklattice.plans.registry import query
from tracklattice.plans.sequences import _CLIP, _FEATURES, _features
from tracklattice.session import table


def _values(*maps: dict[str, str]) -> str:
    pairs = {k.upper(): v for m in maps for k, v in m.items()}
    return ", ".join(f"('{k}', '{v}')" for k, v in pairs.items())


_READ = f"mc(k, c) AS (VALUES {_values(codes.MOODS, codes.MOOD_ALIASES)}), vc(k, c) AS (VALUES {_values(codes.VOCALS, codes.VOCAL_ALIASES)})"
_TOKEN = r"upper(regexp_replace(trim(coalesce({}, '')), '[\s-]+', '_', 'g'))"


@query(f"""
WITH {_READ}, t AS (SELECT 'mood' AS kind, unnest(moods) AS w FROM dj_taxonomy_category UNION ALL SELECT 'mood', unnest(keywords) FROM dj_taxonomy_category UNION ALL SELECT 'vocal', unnest(vocal_profiles) FROM dj_taxonomy_category
  UNION ALL SELECT 'mood', genre FROM source_observations UNION ALL SELECT 'vocal', genre FROM source_observations),
n AS (SELECT kind, {_TOKEN.format('w')} AS k FROM t), r AS (SELECT kind, coalesce(CASE WHEN kind = 'mood' THEN mc.c ELSE vc.c END, n.k) AS code FROM n LEFT JOIN mc ON n.k = mc.k LEFT JOIN vc ON n.k = vc.k)
SELECT kind, code, kind = 'vocal' AND code <> '' AND code NOT IN ('INST', 'TOOL', 'DUB') AS sung, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2
""")
def codes_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mood and vocal tokens as codes, counted; a genre that is no mood passes through."""
    c = table(spark, sf_dir, "dj_taxonomy_category")
    g = table(spark, sf_dir, "source_observations").select(F.col("genre").alias("w"))
    mood = c.select(F.explode(F.concat("moods", "keywords")).alias("w")).unionByName(g).groupBy(codes.mood_code(F.col("w")).alias("code")).agg(F.count("*").alias("n"))
    vocal = c.select(F.explode("vocal_profiles").alias("w")).unionByName(g).groupBy(codes.vocal_code(F.col("w")).alias("code")).agg(F.count("*").alias("n"))
    return mood.select(F.lit("mood").alias("kind"), "code", F.lit(False).alias("sung"), "n").unionByName(vocal.select(F.lit("vocal").alias("kind"), "code", codes.is_sung(F.col("code")).alias("sung"), "n"))


# service values of a part: null for every seventh
_SERVICE = "s AS (SELECT id, CASE WHEN id % 7 > 0 THEN (id % 101) / 100.0 END AS valence, CASE WHEN id % 5 > 0 THEN (id % 89) / 88.0 END AS energy, CASE WHEN id % 3 > 0 THEN (id % 67) / 66.0 END AS instr, (id % 53) / 52.0 AS live, CASE WHEN id % 4 > 0 THEN (id % 71) / 70.0 END AS acoustic, (id % 43) / 42.0 AS speech FROM f)"


def _up(x: str, w: float, o: float, s: float) -> str:
    return f"{w} * " + _CLIP.format(f"({x} - {o}) / {s}")


def _down(x: str, w: float, o: float, s: float) -> str:
    return f"{w} * " + _CLIP.format(f"({o} - {x}) / {s}")


_ALL_MOODS = f"""
{_FEATURES}, {_SERVICE}, v AS (SELECT f.*, onset_variance / (onset * onset + 1e-8) AS ov, centroid_variance / (centroid * centroid + 1e-8) AS cv, valence, energy, instr, live, acoustic, speech FROM f JOIN s USING (id)),
b0 AS (SELECT *, {_CLIP.format("least(1.0, chroma / 0.10) * 0.55 + " + _CLIP.format("(0.025 - flat) / 0.015") + " * 0.20")} AS mel0, {_CLIP.format(" + ".join([_up("ov", 0.25, 2, 2), _up("flat", 0.30, 0.018, 0.030), _up("low", 0.25, 50, 25), _up("flux", 0.20, 2.5, 2.5)]))} AS drk0,
  {_CLIP.format(_up("loud", 0.70, 0.40, 0.15) + " + " + _down("flat", 0.44, 0.03, 0.02))} AS trib0, {_CLIP.format(" + ".join([_down("low", 0.45, 42, 12), _down("onset", 0.30, 1.5, 0.8), _down("ov", 0.25, 1.5, 1.0)]))} AS raw0,
  {_CLIP.format("(1.0 - least(1.0, cv * 10)) * 0.5 + " + _down("ov", 0.50, 2, 1.5))} AS hypn0, {_CLIP.format(" + ".join([_down("centroid", 0.35, 2000, 1000), _down("loud", 0.35, 0.22, 0.10), _up("low", 0.30, 50, 20)]))} AS deep0,
  {_CLIP.format(_up("cv", 1.0, 0.75, 0.40))} AS acid, {_CLIP.format(_down("onset", 0.50, 1.5, 1.0) + " + " + _down("loud", 0.50, 0.20, 0.08))} AS atm0 FROM v),
b AS (SELECT *, {_CLIP.format("drk0 + " + "CASE WHEN valence IS NULL THEN 0 ELSE " + _down("valence", 0.15, 0.35, 0.25) + " END + CASE WHEN energy IS NULL THEN 0 ELSE " + _up("energy", 0.10, 0.60, 0.30) + " END")} AS drk,
  {_CLIP.format("hypn0 + CASE WHEN instr IS NULL THEN 0 ELSE " + _up("instr", 0.15, 0.70, 0.25) + " END + CASE WHEN valence IS NULL THEN 0 ELSE " + _down("valence", 0.10, 0.40, 0.30) + " END")} AS hypn,
  {_CLIP.format("trib0 + CASE WHEN instr IS NULL THEN 0 ELSE " + _up("instr", 0.10, 0.70, 0.25) + " END + CASE WHEN energy IS NULL THEN 0 ELSE " + _up("energy", 0.10, 0.60, 0.30) + " END")} AS trib,
  {_CLIP.format("deep0 + CASE WHEN energy IS NULL THEN 0 ELSE " + _down("energy", 0.15, 0.40, 0.25) + " END + CASE WHEN valence IS NULL THEN 0 ELSE " + _down("valence", 0.10, 0.35, 0.25) + " END")} AS deep,
  {_CLIP.format("atm0 + CASE WHEN energy IS NULL THEN 0 ELSE " + _down("energy", 0.15, 0.35, 0.25) + " END + CASE WHEN acoustic IS NULL THEN 0 ELSE " + _up("acoustic", 0.10, 0.40, 0.30) + " END")} AS atm,
  {_CLIP.format("raw0 + " + _up("live", 0.15, 0.40, 0.30))} AS raw, {_CLIP.format("mel0 + CASE WHEN valence IS NULL THEN 0 ELSE " + _up("valence", 0.15, 0.50, 0.30) + " END")} AS mel FROM b0),
x AS (SELECT *, coalesce(valence, {_CLIP.format("chroma / 0.12")}) AS bright, coalesce(1.0 - valence, drk) AS gloomy, coalesce(energy, greatest(drk, trib)) AS strong, coalesce(1.0 - energy, greatest(deep, atm)) AS calm,
  coalesce(acoustic, {_CLIP.format("(0.03 - flat) / 0.03")}) AS ac FROM b),
m AS (SELECT id, acid AS "ACID", atm AS "ATM", {_CLIP.format("0.58 * atm + 0.34 * mel + 0.08 * calm")} AS "CIN", deep AS "DEEP", drk AS "DRK", {_CLIP.format("0.58 * mel + 0.32 * gloomy + 0.10 * deep")} AS "EMO",
  {_CLIP.format("0.48 * mel + 0.32 * bright + 0.20 * strong")} AS "EUP", {_CLIP.format("0.54 * raw + 0.30 * drk + 0.16 * " + _CLIP.format("flux / 5.0"))} AS "GRIT", hypn AS "HYPN", mel AS "MEL",
  {_CLIP.format("0.52 * hypn + 0.28 * deep + 0.20 * " + _CLIP.format("(2.0 - onset) / 2.0"))} AS "MIN", {_CLIP.format("0.50 * trib + 0.30 * ac + 0.20 * live")} AS "ORG", {_CLIP.format("0.42 * bright + 0.30 * " + _CLIP.format("onset / 3.0") + " + 0.28 * mel")} AS "PLAY",
  {_CLIP.format("0.52 * acid + 0.30 * hypn + 0.18 * " + _CLIP.format("cv"))} AS "PSY", raw AS "RAW", {_CLIP.format("0.46 * bright + 0.30 * mel + 0.24 * ac")} AS "SOUL", {_CLIP.format("0.64 * deep + 0.36 * " + _CLIP.format("(low - 45.0) / 35.0"))} AS "SUB",
  {_CLIP.format("0.46 * bright + 0.30 * calm + 0.24 * mel")} AS "SUN", {_CLIP.format("0.46 * drk + 0.28 * gloomy + 0.26 * " + _CLIP.format("ov / 4.0"))} AS "TENS", trib AS "TRIB", {_CLIP.format("0.42 * bright + 0.34 * deep + 0.24 * ac")} AS "WARM",
  {_CLIP.format("0.46 * raw + 0.34 * drk + 0.20 * strong")} AS "WHSE" FROM x)
"""
_PARTS = {"onset_variance": "onset_variance", "onset_density": "onset", "centroid_variance": "centroid_variance", "centroid": "centroid", "chroma_variance": "chroma", "flatness": "flat", "low": "low", "flux": "flux", "percussive": "loud", "rms": "loud"}
_VOICES = ["valence", "energy", "instrumentalness", "liveness", "acousticness", "speechiness"]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with service values and the 22 moods as columns m_<code>."""
    i = F.col("id")
    f = _features(spark, sf_dir).select(
        "*", F.when(i % 7 > 0, (i % 101) / 100.0).alias("valence"), F.when(i % 5 > 0, (i % 89) / 88.0).alias("energy"), F.when(i % 3 > 0, (i % 67) / 66.0).alias("instrumentalness"), ((i % 53) / 52.0).alias("liveness"),
        F.when(i % 4 > 0, (i % 71) / 70.0).alias("acousticness"), ((i % 43) / 42.0).alias("speechiness"),
    )
    moods = scores.all_moods({k: F.col(v) for k, v in _PARTS.items()}, {k: F.col(k) for k in _VOICES})
    return f.select("*", *[c.alias(f"m_{k}") for k, c in moods.items()])


@query(f"""
WITH {_ALL_MOODS}, l AS (UNPIVOT m ON COLUMNS(* EXCLUDE (id)) INTO NAME mood VALUE score), r AS (SELECT id, mood, round(score, 6) AS s FROM l),
w AS (SELECT id, mood, s, row_number() OVER p AS place, lead(s) OVER p AS next, round(sum(s) OVER (PARTITION BY id), 3) AS total FROM r WINDOW p AS (PARTITION BY id ORDER BY s DESC, mood))
SELECT id, mood, s AS score, round(s - next, 6) AS margin, total FROM w WHERE place = 1
""")
def all_mood_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-two moods with service terms: the best, its margin, and the sum of all."""
    m = {k: F.round(F.col(f"m_{k}"), 6) for k in sorted(codes.MOODS.values())}
    label, score, margin = scores.best_of(m)
    return _scored(spark, sf_dir).select("id", label.alias("mood"), score.alias("score"), F.round(margin, 6).alias("margin"), F.round(sum(m.values(), F.lit(0.0)), 3).alias("total"))


@query(f"""
WITH {_ALL_MOODS}, q AS (SELECT x.id, -45 + low AS ratio, flux / 8 AS act, onset, chroma, loud, coalesce(instr, 0) AS instr, speech, coalesce(acoustic, 0) AS acoustic FROM x),
p AS (SELECT *, {_CLIP.format("0.55 * " + _CLIP.format("(ratio + 40) / 30") + " + 0.45 * " + _CLIP.format("act / 0.7"))} AS pres, {_CLIP.format("act / 0.7")} AS sust FROM q),
h AS (SELECT *, CASE WHEN ratio < -35 THEN false WHEN ratio < -30 AND act < 0.20 THEN false WHEN ratio > -25 OR act > 0.40 THEN true ELSE pres > 0.45 END AS sung FROM p JOIN m USING (id)),
l AS (SELECT id, sung, unnest([{{'k': 'INST', 's': {_CLIP.format("0.65 * (1 - pres) + 0.35 * instr")} * CASE WHEN sung THEN 0.65 ELSE 1 END}},
  {{'k': 'TOOL', 's': {_CLIP.format("0.45 * (1 - pres) + " + " + ".join([_up("onset", 0.30, 1.8, 1.6), _down("chroma", 0.15, 0.06, 0.06), _up("loud", 0.10, 0.35, 0.40)]))} * CASE WHEN sung THEN 0.65 ELSE 1 END}},
  {{'k': 'DUB', 's': {_CLIP.format(_CLIP.format("sust / 0.15") + " * " + _CLIP.format("(0.60 - sust) / 0.40") + ' * (0.50 * (1 - pres) + 0.30 * ("DEEP" + "SUB" + "MIN" + "ATM") + 0.10 * acoustic + 0.10 * instr)')} * CASE WHEN sung THEN 0.65 ELSE 1 END}},
  {{'k': 'VOC', 's': {_CLIP.format("0.70 * pres + 0.20 * (1 - instr) + 0.10 * sust")} * CASE WHEN sung THEN 1 ELSE 0.45 END}}, {{'k': 'FVOC', 's': {_CLIP.format("0.55 * pres + 0.30 * sust + 0.15 * (1 - instr)")} * CASE WHEN sung THEN 1 ELSE 0.45 END}},
  {{'k': 'SPK', 's': {_CLIP.format("0.65 * speech + 0.20 * pres + 0.15 * (1 - sust)")} * CASE WHEN sung THEN 1 ELSE 0.45 END}}, {{'k': 'CHANT', 's': {_CLIP.format('0.35 * pres + 0.45 * "TRIB" + 0.20 * sust')} * CASE WHEN sung THEN 1 ELSE 0.45 END}}]) AS z FROM h),
r AS (SELECT id, sung, z.k AS k, round(z.s, 6) AS s FROM l), w AS (SELECT *, row_number() OVER o AS place, lead(s) OVER o AS next FROM r WINDOW o AS (PARTITION BY id ORDER BY s DESC, k))
SELECT id, k AS profile, s AS score, sung, round({_CLIP.format("(s - next) / (s + 1e-8)")}, 4) AS confidence FROM w WHERE place = 1
""")
def all_vocal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven vocal profiles, damped by the flag: the best and its confidence."""
    f = _scored(spark, sf_dir)
    ratio, act = F.col("low") - 45, F.col("flux") / 8
    sung = scores.has_vocals(ratio, act)
    named = scores.vocal_scores(scores.vocal_presence(ratio, act), scores.clip01(act / 0.7), sung, {k: F.col(v) for k, v in _PARTS.items()}, {k: F.col(k) for k in _VOICES}, {k: F.col(f"m_{k}") for k in codes.MOODS.values()})
    label, score, margin = scores.best_of({k: F.round(c, 6) for k, c in named.items()})
    return f.select("id", label.alias("profile"), score.alias("score"), sung.alias("sung"), F.round(scores.clip01(margin / (score + 1e-8)), 4).alias("confidence"))


# what a tagger said of a track: made up of the columns at hand, with words, codes, blanks and nonsense
_N = "length(coalesce(title_canonical, ''))"
_SAID = f"""g AS (SELECT track_id, canonical_key_camelot AS k, CASE WHEN {_N} % 6 > 0 THEN {_N} % 6 END AS energy, ['dark', 'Hypnotic', 'sun set', 'MEL', 'weird x', '', 'sunset'][{_N} % 7 + 1] AS mood, ['No Vocals', 'fv', 'VOC', 'rap', ''][{_N} % 5 + 1] AS vocal,
  CASE {_N} % 4 WHEN 0 THEN 'DRK.TECH' WHEN 1 THEN 'G123' WHEN 2 THEN 'a b' END AS category, CASE WHEN {_N} % 3 = 0 THEN 'G' || lpad(CAST({_N} AS VARCHAR), 3, '0') ELSE '' END AS grp, canonical_bpm FROM tracks_master)"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.coalesce("title_canonical", F.lit("")))
    pick = lambda words, m: F.element_at(F.array(*[F.lit(w) for w in words]), n % m + 1)
    return table(spark, sf_dir, "tracks_master").select(
        "track_id", F.col("canonical_key_camelot").alias("k"), F.when(n % 6 > 0, n % 6).alias("energy"), pick(["dark", "Hypnotic", "sun set", "MEL", "weird x", "", "sunset"], 7).alias("mood"),
        pick(["No Vocals", "fv", "VOC", "rap", ""], 5).alias("vocal"), F.when(n % 4 == 0, "DRK.TECH").when(n % 4 == 1, "G123").when(n % 4 == 2, "a b").alias("category"),
        F.when(n % 3 == 0, F.concat(F.lit("G"), F.lpad(n.cast("string"), 3, "0"))).otherwise("").alias("grp"), "canonical_bpm",
    )


_LINE = f"""
{_READ}, {_SAID}, c AS (SELECT g.*, coalesce(mc.c, {_TOKEN.format('mood')}) AS m, coalesce(vc.c, {_TOKEN.format('vocal')}) AS v FROM g LEFT JOIN mc ON mc.k = {_TOKEN.format('mood')} LEFT JOIN vc ON vc.k = {_TOKEN.format('vocal')}),
l AS (SELECT track_id, concat_ws('|', CASE WHEN regexp_matches(k, '^(1[0-2]|[1-9])[AB]$') THEN k ELSE '??' END, 'E' || coalesce(CAST(energy AS VARCHAR), '?'), CASE WHEN m IN (SELECT c FROM mc) THEN m ELSE '??' END, CASE WHEN v IN (SELECT c FROM vc) THEN v ELSE '??' END,
  CASE WHEN category = 'DRK.TECH' THEN category END, CASE WHEN grp <> '' THEN grp END) AS line FROM c)
"""


@query(f"WITH {_LINE} SELECT * FROM l")
def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comment line of each track: KEY|E#|MOOD|VOCAL[|CATEGORY][|GROUP]."""
    key = F.when(is_wheel_code(F.col("k")), F.col("k"))
    return _said(spark, sf_dir).select("track_id", codes.tag_line(key, F.col("energy"), F.col("mood"), F.col("vocal"), F.col("category"), F.col("grp")).alias("line"))


@query(f"""
WITH {_LINE}, b AS (SELECT track_id, CASE WHEN length(line) % 9 = 0 THEN line || '|zz' ELSE line END AS line FROM l), s AS (SELECT track_id, string_split(line, '|') AS p, line FROM b WHERE line NOT LIKE '%|zz')
SELECT track_id, p[1] AS key, p[2][2:] AS energy, p[3] AS mood, p[4] AS vocal, CASE WHEN len(p) > 4 AND NOT regexp_matches(p[5], '^G[0-9]{{3}}$') THEN p[5] END AS category, CASE WHEN regexp_matches(p[-1], '^G[0-9]{{3}}$') THEN p[-1] END AS grp FROM s
""")
def comment_lines_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment lines read back into fields; lines of another form give no row."""
    line = F.when(F.length("line") % 9 == 0, F.concat("line", F.lit("|zz"))).otherwise(F.col("line"))
    return comment_lines(spark, sf_dir).select("track_id", codes.tag_fields(line).alias("x")).where("x is not null").select("track_id", "x.*")


@query(f"""
WITH {_READ}, {_SAID}, c AS (SELECT g.*, coalesce(mc.c, {_TOKEN.format('mood')}) AS m, coalesce(vc.c, {_TOKEN.format('vocal')}) AS v, TRY_CAST(canonical_bpm AS DOUBLE) AS b FROM g LEFT JOIN mc ON mc.k = {_TOKEN.format('mood')} LEFT JOIN vc ON vc.k = {_TOKEN.format('vocal')}),
x AS (SELECT track_id, 'tagger:energy=' || energy AS feature, 1.0 AS value FROM c WHERE energy IS NOT NULL UNION ALL SELECT track_id, 'num:tagger_energy', energy FROM c WHERE energy IS NOT NULL
  UNION ALL SELECT track_id, 'cue:' || unnest(CASE WHEN energy <= 2 THEN ['warmup', 'deep', 'downtempo'] WHEN energy = 4 THEN ['driver', 'rolling'] WHEN energy >= 5 THEN ['peak', 'hard'] ELSE [] END), 1.0 FROM c
  UNION ALL SELECT track_id, 'tagger:vibe=' || m, 1.0 FROM c WHERE m <> '' UNION ALL SELECT track_id, 'tagger:vocal=' || v, 1.0 FROM c WHERE v <> '' UNION ALL SELECT track_id, 'num:bpm', b FROM c WHERE b > 0
  UNION ALL SELECT track_id, 'bpm_band:' || CASE WHEN b < 95 THEN '60_95' WHEN b < 115 THEN '95_115' WHEN b < 124 THEN '115_124' WHEN b < 130 THEN '124_130' WHEN b < 146 THEN '130_146' WHEN b < 160 THEN '146_160' WHEN b < 181 THEN '160_180' ELSE '180_plus' END, 1.0 FROM c WHERE b > 0)
SELECT track_id, feature, CAST(max(value) AS DOUBLE) AS value FROM x GROUP BY 1, 2
""")
def tagger_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of what a tagger said: codes, energy, its cues, tempo and tempo band, one row each."""
    return features.tagger_block(_said(spark, sf_dir).withColumn("bpm", F.expr("try_cast(canonical_bpm as double)")), "track_id", "energy", "mood", "vocal", "bpm")
