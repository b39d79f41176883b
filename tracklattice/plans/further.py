"""Queries of further operators: lookups, overlays, categories, markers, diagnostics, parameter grids, models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklattice.functions import music, scores, text
from tracklattice.operators import clusters, linkage, ranks, resolve, sequence, store
from tracklattice.plans.registry import query
from tracklattice.plans.sequences import _BAR, _bars
from tracklattice.session import table

_KEY = "(1[0-2]|[1-9])[AB]"


@query("""
WITH c AS (SELECT file_no AS k, CASE WHEN extension IN ('wav', 'aiff') THEN 'raw' ELSE 'derived' END AS layer, 'v' || (size_bytes % 2) AS version, size_bytes FROM file_entries WHERE file_no % 3 <> 0)
SELECT f.file_no, c.layer, CASE WHEN c.k IS NULL THEN 'miss' WHEN c.layer = 'raw' OR c.version = 'v1' THEN 'hit' ELSE 'stale' END AS status FROM file_entries f LEFT JOIN c ON f.file_no = c.k
""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached payloads of files: raw layers count in any version, derived ones in the current one only."""
    f = table(spark, sf_dir, "file_entries")
    layer = F.when(F.col("extension").isin("wav", "aiff"), "raw").otherwise("derived")
    cached = f.where("file_no % 3 <> 0").select("file_no", layer.alias("layer"), F.concat(F.lit("v"), F.col("size_bytes") % 2).alias("version"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "miss").when((F.col("layer") == "raw") | (F.col("version") == "v1"), "hit").otherwise("stale")
    return f.select("file_no").join(cached, "file_no", "left").select("file_no", "layer", status.alias("status"))


@query(f"""
SELECT e.row_id, CASE WHEN regexp_full_match(t.canonical_key_camelot, '{_KEY}') THEN t.canonical_key_camelot ELSE e.canonical_key END AS key,
  CASE WHEN TRY_CAST(t.canonical_bpm AS DOUBLE) BETWEEN 40 AND 250 THEN t.canonical_bpm ELSE e.canonical_bpm END AS bpm FROM registry_enrichment e LEFT JOIN tracks_master t ON e.track_id = t.track_id
""")
def canonical_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the master table over those of the enrichment where they are valid."""
    e = table(spark, sf_dir, "registry_enrichment").select("row_id", "track_id", "canonical_key", "canonical_bpm")
    t = table(spark, sf_dir, "tracks_master").select("track_id", F.col("canonical_key_camelot").alias("tk"), F.col("canonical_bpm").alias("tb"))
    key = F.when(music.is_wheel_code(F.col("tk")), F.col("tk")).otherwise(F.col("canonical_key"))
    return e.join(t, "track_id", "left").select("row_id", key.alias("key"), F.when(music.tempo(F.col("tb")).isNotNull(), F.col("tb")).otherwise(F.col("canonical_bpm")).alias("bpm"))


@query("""
WITH f AS (SELECT file_no, path, regexp_replace(path, '^.*/', '') AS base FROM file_entries), m AS (SELECT track_index, path, regexp_replace(path, '^.*/', '') AS base FROM track_features WHERE path IS NOT NULL),
a AS (SELECT m.track_index, min(f.file_no) AS file_no FROM m JOIN f ON m.path = f.path GROUP BY 1), b AS (SELECT m.track_index, min(f.file_no) AS file_no FROM m JOIN f ON m.base = f.base WHERE m.track_index NOT IN (SELECT track_index FROM a) GROUP BY 1)
SELECT m.track_index, coalesce(a.file_no, b.file_no) AS file_no, CASE WHEN a.file_no IS NOT NULL THEN 'path' WHEN b.file_no IS NOT NULL THEN 'name' ELSE 'new' END AS method FROM m LEFT JOIN a USING (track_index) LEFT JOIN b USING (track_index)
""")
def path_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of feature rows by path, then by file name."""
    base = lambda: F.regexp_replace("path", "^.*/", "")
    m = table(spark, sf_dir, "track_features").where("path is not null").select("track_index", "path", base().alias("base"))
    f = table(spark, sf_dir, "file_entries").select("file_no", "path", base().alias("base"))
    passes = [("path", 1.0, [(F.col("l_path"), F.col("r_path"))], None), ("name", 0.9, [(F.col("l_base"), F.col("r_base"))], None)]
    return linkage.cascade(m, f, "track_index", "file_no", passes).drop("score")


@query(f"""
WITH t AS (SELECT track_id, canonical_genre AS g, canonical_key_camelot AS k, TRY_CAST(canonical_bpm AS DOUBLE) AS b FROM tracks_master),
c AS (SELECT 'key' AS kind, k AS category, track_id FROM t WHERE regexp_full_match(k, '{_KEY}') UNION ALL SELECT 'genre', g, track_id FROM t WHERE trim(g) <> ''
  UNION ALL SELECT 'tempo', CASE WHEN b >= 180 THEN '180+' WHEN b >= 160 THEN '160-180' WHEN b >= 146 THEN '146-160' WHEN b >= 135 THEN '135-146' WHEN b >= 128 THEN '128-135' WHEN b >= 122 THEN '122-128' WHEN b >= 115 THEN '115-122' WHEN b >= 105 THEN '105-115' WHEN b >= 90 THEN '090-105' ELSE '000-090' END, track_id FROM t WHERE b BETWEEN 40 AND 250
  UNION ALL SELECT 'coarse_genre', string_split(g, ' ')[-1], track_id FROM t WHERE trim(g) <> '')
SELECT kind, category, CAST(count(*) AS BIGINT) AS n, min(track_id) AS first_track FROM c GROUP BY 1, 2
""")
def categorical_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlists by key, genre, tempo bucket and coarse genre: one pass over the tracks, each in several categories."""
    t = table(spark, sf_dir, "tracks_master").withColumn("b", music.tempo(F.col("canonical_bpm")))
    g, k, b = F.col("canonical_genre"), F.col("canonical_key_camelot"), F.col("b")
    named = F.trim(g) != ""
    cats = [("key", F.when(music.is_wheel_code(k), k)), ("genre", F.when(named, g)), ("tempo", music.tempo_bucket(b)), ("coarse_genre", F.when(named, F.element_at(F.split(g, " "), -1)))]
    each = t.select("track_id", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), c.alias("category")) for n, c in cats])).alias("x")).where("x.category is not null")
    return each.groupBy("x.kind", "x.category").agg(F.count("*").alias("n"), F.min("track_id").alias("first_track"))


@query("""
WITH f AS (SELECT file_no, list_sort(list_distinct(all_tokens)) AS t, CASE extension WHEN 'flac' THEN 0 WHEN 'wav' THEN 1 WHEN 'aiff' THEN 2 WHEN 'm4a' THEN 3 ELSE 4 END AS tier, size_bytes FROM file_entries),
c AS (SELECT t, count(*) AS n FROM f GROUP BY 1 HAVING count(*) > 1)
SELECT file_no, CAST(n AS BIGINT) AS copies, tier FROM f JOIN c USING (t) QUALIFY row_number() OVER (PARTITION BY t ORDER BY tier, size_bytes DESC, file_no) = 1
""")
def best_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files with the same words, the one of the best format, then the largest."""
    tier = F.when(F.col("extension") == "flac", 0).when(F.col("extension") == "wav", 1).when(F.col("extension") == "aiff", 2).when(F.col("extension") == "m4a", 3).otherwise(4)
    f = table(spark, sf_dir, "file_entries").select("file_no", F.array_sort(F.array_distinct("all_tokens")).alias("t"), tier.alias("tier"), "size_bytes")
    best = f.groupBy("t").agg(F.count("*").alias("copies"), F.min(F.struct("tier", (-F.col("size_bytes")).alias("s"), "file_no")).alias("x")).where("copies > 1")
    return best.select("x.file_no", "copies", "x.tier")


@query("""
SELECT track_id, max(CASE WHEN lower(trim(source_system)) NOT LIKE 'analysis%' AND (trim(genre) <> '' OR TRY_CAST(popularity AS DOUBLE) IS NOT NULL) THEN 1 ELSE 0 END) = 1 AS external FROM source_observations WHERE track_id IS NOT NULL GROUP BY 1
""")
def external_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any outside source says anything about a track."""
    s = resolve.source(F.col("source_system"))
    said = ~s.startswith("analysis") & ((F.trim("genre") != "") | F.col("popularity").try_cast("double").isNotNull())
    return table(spark, sf_dir, "source_observations").where("track_id is not null").groupBy("track_id").agg((F.max(F.coalesce(said, F.lit(False)).cast("int")) == 1).alias("external"))


_CUES = f"""
{_BAR}, m AS (SELECT user_id, median(value) AS mid, count(*) AS n FROM b GROUP BY 1),
w AS (SELECT user_id, bar, min(value) OVER f4 AS low4, count(*) OVER f4 AS n4, avg(value) OVER bef AS before, count(*) OVER bef AS nb, avg(value) OVER aft AS after, count(*) OVER aft AS na FROM b
  WINDOW f4 AS (PARTITION BY user_id ORDER BY bar ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), bef AS (PARTITION BY user_id ORDER BY bar ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), aft AS (PARTITION BY user_id ORDER BY bar ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
r AS (SELECT user_id, bar, CASE WHEN bar >= 16 AND na = 8 AND nb = 8 THEN round(after - before, 6) END AS rise FROM w),
best AS (SELECT user_id, bar AS drop_bar, rise FROM r WHERE rise IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rise DESC, bar) = 1),
mi AS (SELECT w.user_id, min(bar) AS mix_in FROM w JOIN m USING (user_id) WHERE n4 = 4 AND low4 > greatest(0.05, mid * 0.6) GROUP BY 1),
c AS (SELECT m.user_id, n, coalesce(mix_in, 0) AS mix_in, coalesce(drop_bar, coalesce(mix_in, 0) + 8) AS d0, CAST(greatest(0, floor((n - 16) / 8) * 8) AS INTEGER) AS o0, CASE WHEN rise IS NULL THEN 0.45 WHEN rise > 0.05 THEN 0.66 ELSE 0.55 END AS cf FROM m LEFT JOIN mi USING (user_id) LEFT JOIN best USING (user_id)),
o AS (SELECT *, greatest(d0, mix_in + 8) AS d, greatest(o0, greatest(d0, mix_in + 8) + 8) AS mo FROM c),
k AS (SELECT *, CASE WHEN d <> d0 OR mo <> o0 THEN least(cf, 0.5) ELSE cf END AS confidence FROM o)
"""


@query(f"""
WITH {_CUES}, x AS (SELECT user_id, n, confidence, 'start' AS marker, mix_in - 16 AS bar, 0 AS lp FROM k UNION ALL SELECT user_id, n, confidence, 'mix_in', mix_in, 8 FROM k UNION ALL SELECT user_id, n, confidence, 'before_drop', d - 8, 0 FROM k
  UNION ALL SELECT user_id, n, confidence, 'drop', d, 0 FROM k UNION ALL SELECT user_id, n, confidence, 'mix_out', mo, 8 FROM k UNION ALL SELECT user_id, n, confidence, 'end', mo + 16, 0 FROM k)
SELECT user_id, marker, CAST(bar AS INTEGER) AS bar, CAST(CASE WHEN lp > 0 AND bar + lp <= n THEN bar + lp END AS INTEGER) AS loop_end, CAST(confidence AS DOUBLE) AS confidence, confidence < 0.65 AS review FROM x WHERE bar >= 0 AND bar < n
""")
def cue_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue points put in order, with markers and loops."""
    bars = _bars(spark, sf_dir)
    n = bars.groupBy("user_id").agg(F.count("*").alias("n_bars"))
    return sequence.markers(sequence.cue_points(bars, "user_id", "bar", "value").join(n, "user_id"), "user_id", F.col("n_bars"))


_PROF = "unnest([6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]) AS major, unnest([6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]) AS minor, unnest(range(12)) AS j"


@query(f"""
WITH p AS (SELECT {_PROF}), t AS (SELECT unnest(range(12)) AS tonic), d AS (SELECT tonic, 'major' AS mode, (j + tonic) % 12 AS i, CAST(major AS DOUBLE) AS w FROM p, t UNION ALL SELECT tonic, 'minor', (j + tonic) % 12, CAST(minor AS DOUBLE) FROM p, t),
c AS (SELECT vec_id, unnest(range(12)) AS i, unnest(list_slice(embedding::DOUBLE[], 1, 12)) AS c FROM embeddings), r AS (SELECT vec_id, tonic, mode, round(corr(c, w), 6) AS r FROM c JOIN d USING (i) GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER w AS place, lead(r) OVER w AS next FROM r WINDOW w AS (PARTITION BY vec_id ORDER BY r DESC, mode, tonic))
SELECT vec_id, CAST(tonic AS INTEGER) AS tonic, mode, r AS correlation, round(r - next, 6) AS margin FROM k WHERE place = 1
""")
def key_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key of a chroma by correlation with tonal profiles."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double")).alias("chroma"))
    return sequence.profile_keys(e, "vec_id", F.col("chroma"))


@query(f"""
WITH g AS (SELECT unnest([0.0, 0.3, 0.5, 0.7]) AS floor), v AS (SELECT g.floor, o.track_id, o.key_camelot AS key, count(*) AS n, sum(CAST(key_confidence AS DECIMAL(6,4))) AS w FROM source_observations o, g
  WHERE o.track_id IS NOT NULL AND regexp_full_match(o.key_camelot, '{_KEY}') AND o.key_confidence >= g.floor GROUP BY 1, 2, 3),
b AS (SELECT floor, track_id, arg_min(key, {{'w': -w, 'k': key}}) AS by_weight, arg_min(key, {{'n': -n, 'k': key}}) AS by_count FROM v GROUP BY 1, 2)
SELECT CAST(floor AS DOUBLE) AS floor, CAST(count(*) AS BIGINT) AS tracks, CAST(count(*) FILTER (by_weight = t.canonical_key_camelot) AS BIGINT) AS weight_hits, CAST(count(*) FILTER (by_count = t.canonical_key_camelot) AS BIGINT) AS count_hits
FROM b JOIN tracks_master t USING (track_id) GROUP BY 1
""")
def vote_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two ways of voting over a grid of confidence floors; observations are read once and exploded to the floors they pass."""
    o = table(spark, sf_dir, "source_observations").where("track_id is not null").select("track_id", music.camelot(F.col("key_camelot")).alias("key"), "key_confidence").where("key is not null")
    floors = F.filter(F.array(*[F.lit(f) for f in (0.0, 0.3, 0.5, 0.7)]), lambda f: f <= F.col("key_confidence"))
    v = o.select("track_id", "key", "key_confidence", F.explode(floors).alias("floor")).groupBy("floor", "track_id", "key").agg(F.count("*").alias("n"), F.sum(F.col("key_confidence").cast("decimal(6,4)")).alias("w"))
    b = v.groupBy("floor", "track_id").agg(F.min(F.struct((-F.col("w")).alias("w"), "key")).alias("a"), F.min(F.struct((-F.col("n")).alias("n"), "key")).alias("b"))
    j = b.join(table(spark, sf_dir, "tracks_master").select("track_id", "canonical_key_camelot"), "track_id")
    hit = lambda c: F.sum((F.col(c) == F.col("canonical_key_camelot")).cast("long"))
    return j.groupBy("floor").agg(F.count("*").alias("tracks"), hit("a.key").alias("weight_hits"), hit("b.key").alias("count_hits"))


@query("""
WITH e AS (SELECT unnest(genres) AS g FROM playlist_tracks UNION ALL SELECT unnest(all_genres) FROM registry_enrichment),
a AS (SELECT DISTINCT unnest(aliases) AS alias FROM genre_reference), k AS (SELECT CASE WHEN g IS NULL THEN 'null' WHEN trim(g) = '' THEN 'blank' WHEN g IN (SELECT genre FROM genre_reference) THEN 'exact' WHEN g IN (SELECT alias FROM a) THEN 'alias' ELSE 'other' END AS status FROM e)
SELECT status, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1
""")
def label_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre entries by how they stand to the reference."""
    e = table(spark, sf_dir, "playlist_tracks").select(F.explode("genres").alias("g")).unionByName(table(spark, sf_dir, "registry_enrichment").select(F.explode("all_genres").alias("g")))
    ref = table(spark, sf_dir, "genre_reference")
    names = ref.select(F.col("genre").alias("g")).distinct().withColumn("exact", F.lit(True))
    aliases = ref.select(F.explode("aliases").alias("g")).distinct().withColumn("alias", F.lit(True))
    j = e.join(F.broadcast(names), "g", "left").join(F.broadcast(aliases), "g", "left")  # the reference list is fixed
    status = F.when(F.col("g").isNull(), "null").when(F.trim("g") == "", "blank").when(F.col("exact"), "exact").when(F.col("alias"), "alias").otherwise("other")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT canonical_genre AS g, TRY_CAST(canonical_bpm AS DOUBLE) AS b, linked_file_count % 5 + 1 AS e FROM tracks_master WHERE trim(canonical_genre) <> ''),
s AS (SELECT g, count(*) AS n, max(CASE WHEN b BETWEEN 40 AND 250 THEN b END) AS hi, min(CASE WHEN b BETWEEN 40 AND 250 THEN b END) AS lo, max(e) - min(e) AS es FROM t GROUP BY 1)
SELECT g AS genre, CAST(n AS BIGINT) AS size, n < 2 OR n > 20 AS bad_size, coalesce((hi - lo) / ((hi + lo) / 2) > 0.07, false) AS bad_tempo, es > 3 AS bad_energy FROM s
""")
def group_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups outside their limits of size, tempo spread and energy spread."""
    b = music.tempo(F.col("canonical_bpm"))
    e = F.col("linked_file_count") % 5 + 1
    t = table(spark, sf_dir, "tracks_master").where(F.trim("canonical_genre") != "").groupBy(F.col("canonical_genre").alias("genre"))
    s = t.agg(F.count("*").alias("size"), F.max(b).alias("hi"), F.min(b).alias("lo"), (F.max(e) - F.min(e)).alias("es"))
    spread = F.coalesce((F.col("hi") - F.col("lo")) / ((F.col("hi") + F.col("lo")) / 2) > 0.07, F.lit(False))
    return s.select("genre", "size", ((F.col("size") < 2) | (F.col("size") > 20)).alias("bad_size"), spread.alias("bad_tempo"), (F.col("es") > 3).alias("bad_energy"))


_LABELS = "u AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings), d AS (SELECT a.label AS a, b.label AS b, avg(1 - list_dot_product(a.v, b.v)) AS d FROM u a JOIN u b ON a.label < b.label GROUP BY 1, 2)"


@query(f"""
WITH {_LABELS}, f AS (SELECT * FROM (VALUES (0, 1, 'good', 1.0), (2, 3, 'bad', 0.5), (1, 4, 'good', 0.4)) x(a, b, kind, s))
SELECT d.a, d.b, round(d.d * CASE f.kind WHEN 'good' THEN 1 - 0.3 * s WHEN 'bad' THEN 1 + 0.5 * s ELSE 1 END, 6) AS distance FROM d LEFT JOIN f USING (a, b)
""")
def feedback_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of groups drawn together by good feedback and pushed apart by bad."""
    d = clusters.group_distances(clusters.centres(table(spark, sf_dir, "embeddings"), "label", "embedding", 64), "label")
    f = spark.createDataFrame([(0, 1, "good", 1.0), (2, 3, "bad", 0.5), (1, 4, "good", 0.4)], "a int, b int, kind string, s double")
    factor = F.when(F.col("kind") == "good", 1 - F.col("s") * 0.3).when(F.col("kind") == "bad", 1 + F.col("s") * 0.5).otherwise(1.0)
    return d.join(F.broadcast(f), ["a", "b"], "left").select("a", "b", F.round(F.col("distance") * factor, 6).alias("distance"))


@query("""
SELECT observation_id, ingested_at, CASE WHEN p IS NULL THEN NULL WHEN p < 0.25 THEN 'very_low' WHEN p < 0.45 THEN 'low' WHEN p < 0.65 THEN 'mid' WHEN p < 0.82 THEN 'high' ELSE 'very_high' END AS band FROM (SELECT observation_id, ingested_at, TRY_CAST(popularity AS DOUBLE) / 100 AS p FROM source_observations)
""")
def popularity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popularity as a band."""
    return table(spark, sf_dir, "source_observations").select("observation_id", "ingested_at", scores.value_band(F.col("popularity").try_cast("double") / 100).alias("band"))


@query("""
SELECT row_id, array_to_string(list_filter(list_transform(range(1, len(genres) + 1), lambda i: CASE WHEN list_position(genres, genres[i]) = i THEN genres[i] END), lambda x: x IS NOT NULL), '|') AS genres FROM playlist_tracks WHERE genres IS NOT NULL AND len(genres) > 0
""")
def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an array once each, in order of first appearance, nulls left out."""
    p = table(spark, sf_dir, "playlist_tracks").where(F.size("genres") > 0)
    return p.select("row_id", F.array_join(F.array_distinct("genres"), "|").alias("genres"))


@query("""
WITH q AS (SELECT unnest([0.02, 0.25, 0.5, 0.75, 0.98]) AS share) SELECT CAST(share AS DOUBLE) AS share, round((SELECT quantile_cont(l_extendedprice, [0.02, 0.25, 0.5, 0.75, 0.98]) FROM lineitem)[list_position([0.02, 0.25, 0.5, 0.75, 0.98], share)], 4) AS value FROM q
""")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of a large column, found range by range."""
    shares = [0.02, 0.25, 0.5, 0.75, 0.98]
    got = ranks.quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", shares)
    return spark.createDataFrame([(s, round(v, 4)) for s, v in zip(shares, got)], "share double, value double")


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2003-09-02' GROUP BY 1, 2
""")
def pushed_down_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped sums over a filtered scan: filter and columns reach the files."""
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2003-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum_price"), F.count("*").alias("n"))


@query("""
WITH o AS (SELECT observation_id, lower(trim(source_system)) AS s, popularity, bpm, ingested_at FROM source_observations WHERE observation_id IS NOT NULL),
e AS (SELECT *, (CASE WHEN popularity IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN TRY_CAST(bpm AS DOUBLE) > 0 THEN 1 ELSE 0 END) AS rich FROM o)
SELECT observation_id, max(rich) AS rich FROM e GROUP BY 1
""")
def richer_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest of several entries of one key."""
    o = table(spark, sf_dir, "source_observations").where("observation_id is not null").select("observation_id", "popularity", "bpm", "ingested_at")
    rich = F.when(F.col("popularity").isNotNull(), 1).otherwise(0) + F.when(F.col("bpm").try_cast("double") > 0, 1).otherwise(0)
    return store.richer_entry(o.withColumn("rich", rich), ["observation_id"], F.col("rich"), F.col("ingested_at")).select("observation_id", "rich")


@query()
def agglomerative_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-linkage groups of each label, cut at 0.9."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return clusters.linked_groups(e, "label", "vec_id", "embedding", 0.9)


@query()
def boosted_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-boosted trees that tell whether a track is of the most frequent family, with and without its observations' words (ablation).

    Rows (features, n, accuracy); tracks of one artist are on one side of the split only.
    """
    ref = table(spark, sf_dir, "genre_reference").select("genre", "family")
    t = table(spark, sf_dir, "tracks_master").select("track_id", "artist_canonical", F.col("canonical_genre").alias("genre"), music.tempo(F.col("canonical_bpm")).alias("bpm")).join(F.broadcast(ref), "genre")
    top = t.groupBy("family").count().orderBy(F.desc("count"), "family").limit(1).collect()[0]["family"]
    said = table(spark, sf_dir, "source_observations").where("track_id is not null").groupBy("track_id").agg(F.collect_set(F.lower("genre")).alias("gs"))
    rows = t.join(said, "track_id").withColumn("label", (F.col("family") == top).cast("double"))
    tempo_words = F.array(F.concat(F.lit("tempo="), music.tempo_bucket(F.coalesce("bpm", F.lit(0.0)))), F.concat(F.lit("artist="), F.col("artist_canonical")))
    variants = {"all": F.concat(tempo_words, text.tokens(F.array_join("gs", " "))), "without observations": tempo_words}
    held_out = F.pmod(F.xxhash64("artist_canonical"), F.lit(5)) == 0
    out = None
    for name, words in variants.items():
        x = HashingTF(numFeatures=256, inputCol="words", outputCol="features").transform(rows.withColumn("words", words))
        model = GBTClassifier(maxIter=10, maxDepth=4, seed=1).fit(x.where(~held_out))
        got = model.transform(x.where(held_out)).agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("accuracy")).withColumn("features", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


@query("""
WITH x AS (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, CAST(count(*) FILTER (before IS NULL OR ts - before > INTERVAL 6 HOUR) AS BIGINT) AS sessions, CAST(count(*) AS BIGINT) AS events FROM x GROUP BY 1
""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events without a longer gap, by Spark's session windows."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("t", "6 hours 1 microsecond").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("""
SELECT row_id, CAST(row_number() OVER (PARTITION BY playlist ORDER BY added_at DESC NULLS LAST, row_id) AS INTEGER) AS place FROM playlist_tracks
""")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each playlist, the newest first."""
    w = Window.partitionBy("playlist").orderBy(F.col("added_at").desc_nulls_last(), "row_id")
    return table(spark, sf_dir, "playlist_tracks").select("row_id", F.row_number().over(w).alias("place"))
