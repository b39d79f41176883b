"""Queries of votes, evidence, review and store operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklattice.functions import music, scores, text
from tracklattice.operators import resolve, store
from tracklattice.plans.registry import query
from tracklattice.session import table

SOURCES = ["tag", "rekordbox", "songstats", "analysis_librosa", "manual"]

_VOTES = """
votes AS (
  SELECT track_id, CAST(round_even(TRY_CAST(trim(bpm) AS DOUBLE), 0) AS INTEGER) AS v, lower(trim(source_system)) AS s
  FROM source_observations WHERE track_id IS NOT NULL AND TRY_CAST(trim(bpm) AS DOUBLE) BETWEEN 1 AND 999),
"""


@query(f"""
WITH {_VOTES} per_value AS (
  SELECT track_id, v, count(*) AS votes, max(CASE WHEN s = 'tag' THEN 1 ELSE 0 END) AS tagged,
    min(CASE s WHEN 'tag' THEN 0 WHEN 'rekordbox' THEN 1 WHEN 'songstats' THEN 2 WHEN 'analysis_librosa' THEN 3 WHEN 'analysis_essentia' THEN 4 ELSE 99 END) AS rnk
  FROM votes GROUP BY 1, 2),
ranked AS (
  SELECT *, sum(votes) OVER (PARTITION BY track_id) AS total, row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, tagged DESC, rnk, v) AS place FROM per_value)
SELECT track_id, v AS bpm, CAST(votes AS BIGINT) AS votes, CAST(total AS BIGINT) AS total, round(votes / total, 3) AS confidence FROM ranked WHERE place = 1
""")
def majority_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tempo that most observations of a track give."""
    return resolve.majority_tempo(table(spark, sf_dir, "source_observations"))


_KEYS = """
keyed AS (
  SELECT track_id, key_camelot AS key, lower(trim(source_system)) AS s, coalesce(key_confidence, 0) AS c
  FROM source_observations WHERE track_id IS NOT NULL AND regexp_full_match(key_camelot, '(1[0-2]|[1-9])[AB]')),
per_key AS (
  SELECT track_id, key, count(*) AS n,
    sum(CAST(c AS DECIMAL(6,4)) * CAST(CASE s WHEN 'manual' THEN 1.0 WHEN 'analysis_essentia' THEN 0.85 WHEN 'analysis_librosa' THEN 0.8 WHEN 'rekordbox' THEN 0.75 WHEN 'tag' THEN 0.55 WHEN 'songstats' THEN 0.4 ELSE 0.5 END AS DECIMAL(4,2))) AS base,
    min(CASE s WHEN 'tag' THEN 0 WHEN 'rekordbox' THEN 1 WHEN 'songstats' THEN 2 WHEN 'analysis_librosa' THEN 3 WHEN 'analysis_essentia' THEN 4 ELSE 99 END) AS rnk,
    max(CASE WHEN s LIKE 'analysis~_%' ESCAPE '~' THEN 1 ELSE 0 END) AS ana, max(CASE WHEN s IN ('rekordbox', 'songstats') THEN 1 ELSE 0 END) AS ext,
    array_to_string(list_sort(list(DISTINCT s)), '+') AS sources
  FROM keyed GROUP BY 1, 2),
scored AS (SELECT *, CAST(round(base + CAST((n - 1) * 0.15 AS DECIMAL(18,2)) + CAST(ana * ext * 0.1 AS DECIMAL(18,2)), 4) AS DOUBLE) AS score FROM per_key),
ranked AS (
  SELECT *, row_number() OVER w AS place, lead(score) OVER w AS next_score, lead(rnk) OVER w AS next_rnk, sum(base) OVER (PARTITION BY track_id) AS total_base,
    sum(n) OVER (PARTITION BY track_id) AS all_rows, max(ana) OVER (PARTITION BY track_id) AS any_ana
  FROM scored WINDOW w AS (PARTITION BY track_id ORDER BY score DESC, rnk, key)),
tops AS (
  SELECT *, (n * 2 > all_rows) OR (score >= 0.55 AND (next_score IS NULL OR round(score - next_score, 4) >= 0.05)) OR (score >= 0.55 AND next_score IS NOT NULL AND rnk < next_rnk) AS resolved
  FROM ranked WHERE place = 1),
final AS (
  SELECT track_id, key, score, CASE WHEN total_base > 0 THEN round(CAST(base AS DOUBLE) / CAST(total_base AS DOUBLE), 3) ELSE 0.0 END AS confidence, sources, resolved,
    CASE WHEN resolved AND next_score IS NULL AND n = 1 THEN 'single_source' WHEN resolved AND next_score IS NULL THEN 'all_agree' WHEN resolved THEN 'majority_or_score'
      WHEN any_ana = 0 THEN 'no_analysis' WHEN next_score IS NOT NULL THEN 'source_conflict' ELSE 'low_confidence' END AS reason
  FROM tops)
"""


@query(f"WITH {_KEYS} SELECT * FROM final")
def weighted_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key of the highest weighted vote of a track, with its reason."""
    return resolve.weighted_key(table(spark, sf_dir, "source_observations"))


@query(f"""
WITH {_KEYS}
SELECT f.track_id, f.reason,
  max(CASE WHEN r.place = 1 THEN r.key END) AS key_1, max(CASE WHEN r.place = 1 THEN CAST(round(r.base, 4) AS DOUBLE) END) AS score_1,
  max(CASE WHEN r.place = 2 THEN r.key END) AS key_2, max(CASE WHEN r.place = 2 THEN CAST(round(r.base, 4) AS DOUBLE) END) AS score_2,
  max(CASE WHEN r.place = 3 THEN r.key END) AS key_3, max(CASE WHEN r.place = 3 THEN CAST(round(r.base, 4) AS DOUBLE) END) AS score_3,
  CASE f.reason WHEN 'source_conflict' THEN 'high' WHEN 'no_analysis' THEN 'low' ELSE 'medium' END AS priority
FROM final f JOIN ranked r USING (track_id) WHERE NOT f.resolved GROUP BY f.track_id, f.reason
""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved tracks with three candidates as columns."""
    return resolve.review_queue(table(spark, sf_dir, "source_observations"))


@query("""
WITH latest AS (
  SELECT track_id, lower(trim(source_system)) AS s, arg_max(key_camelot, observed_at || '|' || coalesce(observation_id, '')) AS k
  FROM source_observations WHERE track_id IS NOT NULL AND regexp_full_match(key_camelot, '(1[0-2]|[1-9])[AB]') GROUP BY 1, 2),
named AS (SELECT track_id, s, k, list_position(['manual', 'analysis_essentia', 'analysis_librosa', 'rekordbox', 'tag', 'songstats'], s) AS pos FROM latest)
SELECT track_id, string_agg(s || '=' || k, '; ' ORDER BY pos) AS evidence FROM named WHERE pos IS NOT NULL GROUP BY 1
""")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last valid key of each source in a fixed order."""
    return resolve.evidence_summary(table(spark, sf_dir, "source_observations"))


@query("""
WITH x AS (SELECT track_id, lower(trim(source_system)) AS s, bpm, key_camelot, observed_at || '|' || coalesce(observation_id, '') AS t FROM source_observations WHERE track_id IS NOT NULL),
o AS (SELECT track_id,
  arg_max(bpm, t) FILTER (s = 'tag' AND bpm IS NOT NULL) AS bpm_tag, arg_max(bpm, t) FILTER (s = 'rekordbox' AND bpm IS NOT NULL) AS bpm_rekordbox,
  arg_max(bpm, t) FILTER (s = 'songstats' AND bpm IS NOT NULL) AS bpm_songstats, arg_max(bpm, t) FILTER (s = 'analysis_librosa' AND bpm IS NOT NULL) AS bpm_analysis_librosa,
  arg_max(bpm, t) FILTER (s = 'manual' AND bpm IS NOT NULL) AS bpm_manual,
  arg_max(key_camelot, t) FILTER (s = 'tag' AND key_camelot IS NOT NULL) AS key_tag, arg_max(key_camelot, t) FILTER (s = 'rekordbox' AND key_camelot IS NOT NULL) AS key_rekordbox,
  arg_max(key_camelot, t) FILTER (s = 'songstats' AND key_camelot IS NOT NULL) AS key_songstats, arg_max(key_camelot, t) FILTER (s = 'analysis_librosa' AND key_camelot IS NOT NULL) AS key_analysis_librosa,
  arg_max(key_camelot, t) FILTER (s = 'manual' AND key_camelot IS NOT NULL) AS key_manual FROM x GROUP BY 1)
SELECT t.track_id, t.artist_canonical, t.title_canonical, o.* EXCLUDE (track_id) FROM tracks_master t LEFT JOIN o USING (track_id)
""")
def source_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per track, all sources as columns."""
    tracks = table(spark, sf_dir, "tracks_master").select("track_id", "artist_canonical", "title_canonical")
    return resolve.overview(tracks, table(spark, sf_dir, "source_observations"), SOURCES)


@query("""
SELECT observation_id, track_id, source_system, ingested_at FROM source_observations WHERE observation_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY ingested_at DESC, coalesce(observed_at, '') DESC) = 1
""")
def delivered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last delivery of each observation."""
    return resolve.delivered_once(table(spark, sf_dir, "source_observations")).where("observation_id is not null").select("observation_id", "track_id", "source_system", "ingested_at")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_linenumber, l_partkey, l_suppkey) AS place,
  count(*) OVER (PARTITION BY l_orderkey) AS linked_count, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS had_primary FROM lineitem)
SELECT l_orderkey, l_linenumber, l_returnflag, linked_count, had_primary FROM r WHERE place = 1
""")
def primary_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First flagged line of each order, else its first line."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")
    got = resolve.primary_rows(rows, "l_orderkey", F.col("l_returnflag") == "R", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return got.select("l_orderkey", "l_linenumber", "l_returnflag", "linked_count", "had_primary")


@query("""
WITH f AS (SELECT file_id, min(track_id) AS ft FROM source_observations WHERE file_id IS NOT NULL AND trim(coalesce(track_id, '')) <> '' GROUP BY 1)
SELECT o.observation_id, o.file_id, coalesce(CASE WHEN trim(o.track_id) <> '' THEN o.track_id END, f.ft) AS track_id, o.ingested_at FROM source_observations o LEFT JOIN f USING (file_id)
""")
def observations_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations whose blank track is filled over their file."""
    obs = table(spark, sf_dir, "source_observations").select("observation_id", "file_id", "track_id", "ingested_at")
    files = obs.where("file_id is not null and trim(track_id) <> ''").groupBy("file_id").agg(F.min("track_id").alias("track_id"))
    return resolve.backfilled(obs, files, "file_id", ["track_id"])


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replaced by key, new ones added."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    updates = orders.where("o_orderstatus in ('F', 'O')").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", "done").otherwise(F.col("o_orderstatus")))
    return store.upsert(orders.where("o_orderstatus <> 'O'"), updates, ["o_orderkey"])


@query("""
SELECT track_id, artist_canonical, title_canonical, canonical_bpm FROM tracks_master t WHERE NOT EXISTS (
  SELECT 1 FROM source_observations o WHERE o.track_id = t.track_id AND lower(trim(o.source_system)) = 'rekordbox')
""")
def delete_by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that one source has never observed: the complement of a semi join."""
    tracks = table(spark, sf_dir, "tracks_master").select("track_id", "artist_canonical", "title_canonical", "canonical_bpm")
    seen = table(spark, sf_dir, "source_observations").where(resolve.source(F.col("source_system")) == "rekordbox")
    return store.without(tracks, seen, ["track_id"])


@query("""
WITH old AS (SELECT path, size_bytes, mtime_utc FROM file_entries WHERE mtime_utc < TIMESTAMP '2023-01-01' OR extension = 'mp3'),
new AS (SELECT path, CASE WHEN extension = 'mp3' THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, mtime_utc FROM file_entries WHERE mtime_utc >= TIMESTAMP '2021-01-01')
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN o.size_bytes IS DISTINCT FROM n.size_bytes OR o.mtime_utc IS DISTINCT FROM n.mtime_utc THEN 'changed' ELSE 'same' END AS change
FROM old o FULL OUTER JOIN new n ON o.path = n.path
""")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of a file table compared: new, changed, same, removed."""
    files = table(spark, sf_dir, "file_entries").select("path", "size_bytes", "mtime_utc", "extension")
    old = files.where((F.col("mtime_utc") < F.lit("2023-01-01").cast("timestamp_ntz")) | (F.col("extension") == "mp3")).drop("extension")
    new = files.where(F.col("mtime_utc") >= F.lit("2021-01-01").cast("timestamp_ntz")).withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("extension") == "mp3", 1).otherwise(0)).drop("extension")
    return store.changes(old, new, ["path"], ["size_bytes", "mtime_utc"]).select("path", "change")


@query("""
SELECT track_id, source_system AS src, max(ingested_at) AS fresh, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT track_id, lower(trim(source_system)) AS source_system, ingested_at FROM source_observations WHERE track_id IS NOT NULL) GROUP BY 1, 2
""")
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of each track and source with the last arrival."""
    obs = table(spark, sf_dir, "source_observations").where("track_id is not null")
    return obs.groupBy("track_id", resolve.source(F.col("source_system")).alias("src")).agg(F.max("ingested_at").alias("fresh"), F.count("*").alias("n"))


@query("""
WITH a AS (SELECT file_no AS k, 'v' || (size_bytes % 3) AS version, mtime_utc AS m, 'a' AS side FROM file_entries WHERE extension <> 'wav'),
b AS (SELECT file_no AS k, 'v' || (size_bytes % 2) AS version, mtime_utc + INTERVAL 1 DAY * (CAST(file_no % 3 AS INTEGER) - 1) AS m, 'b' AS side FROM file_entries WHERE extension <> 'flac')
SELECT coalesce(a.k, b.k) AS k,
  CASE WHEN a.k IS NULL THEN 'b' WHEN b.k IS NULL THEN 'a' WHEN (b.version = 'v1') <> (a.version = 'v1') THEN CASE WHEN b.version = 'v1' THEN 'b' ELSE 'a' END WHEN b.m > a.m THEN 'b' ELSE 'a' END AS side,
  CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'kept' WHEN (b.version = 'v1') <> (a.version = 'v1') THEN CASE WHEN b.version = 'v1' THEN 'replaced' ELSE 'kept' END WHEN b.m > a.m THEN 'replaced' ELSE 'kept' END AS outcome
FROM a FULL OUTER JOIN b ON a.k = b.k
""")
def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two caches merged: the current version beats others, then the newer entry, ties keep the first."""
    files = table(spark, sf_dir, "file_entries")
    a = files.where("extension <> 'wav'").select(F.col("file_no").alias("k"), F.concat(F.lit("v"), F.col("size_bytes") % 3).alias("version"), F.col("mtime_utc").alias("m"), F.lit("a").alias("side"))
    b = files.where("extension <> 'flac'").select(
        F.col("file_no").alias("k"), F.concat(F.lit("v"), F.col("size_bytes") % 2).alias("version"), F.expr("mtime_utc + make_dt_interval(cast(file_no % 3 as int) - 1)").alias("m"), F.lit("b").alias("side")
    )
    return store.merge_caches(a, b, "k", "version", "m", "v1").select("k", "side", "outcome")


@query("""
SELECT track_id, regexp_full_match(canonical_key_camelot, '(1[0-2]|[1-9])[AB]') AS known_key, canonical_key_camelot IN ('', '??', 'NK') AS placeholder,
  CASE WHEN regexp_full_match(canonical_key_camelot, '(1[0-2]|[1-9])[AB]') THEN (CAST(regexp_extract(canonical_key_camelot, '^[0-9]+') AS INTEGER) - 1) * 2 + CASE WHEN right(canonical_key_camelot, 1) = 'B' THEN 1 ELSE 0 END END AS wheel_pos
FROM tracks_master
""")
def key_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored keys are keys, which are placeholders, and where they lie on the wheel."""
    k = F.col("canonical_key_camelot")
    return table(spark, sf_dir, "tracks_master").select("track_id", music.is_wheel_code(k).alias("known_key"), k.isin("", "??", "NK").alias("placeholder"), music.wheel_position(k).alias("wheel_pos"))


@query("""
WITH k AS (SELECT DISTINCT key_camelot AS c FROM source_observations WHERE regexp_full_match(key_camelot, '(1[0-2]|[1-9])[AB]')),
n AS (SELECT c, CAST(regexp_extract(c, '^[0-9]+') AS INTEGER) AS i, right(c, 1) AS m FROM k)
SELECT a.c AS key_a, b.c AS key_b, least(abs(a.i - b.i), 12 - abs(a.i - b.i)) + CASE WHEN a.m <> b.m THEN 1 ELSE 0 END AS steps FROM n a JOIN n b ON a.c < b.c
""")
def key_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps between all pairs of keys that occur; the wheel has 24 codes."""
    k = table(spark, sf_dir, "source_observations").select(music.camelot(F.col("key_camelot")).alias("c")).where("c is not null").distinct()
    pairs = k.select(F.col("c").alias("key_a")).join(F.broadcast(k.select(F.col("c").alias("key_b"))), F.col("key_a") < F.col("key_b"))
    return pairs.withColumn("steps", music.wheel_distance(F.col("key_a"), F.col("key_b")))


@query("""
SELECT row_id, CASE canonical_key_n WHEN '' THEN NULL ELSE canonical_key_n END AS key FROM (
SELECT row_id, CASE WHEN regexp_full_match(upper(trim(canonical_key)), '0?([1-9]|1[0-2])[AB]') THEN CAST(CAST(regexp_extract(trim(canonical_key), '^0?([0-9]+)', 1) AS INTEGER) AS VARCHAR) || upper(right(trim(canonical_key), 1)) ELSE '' END AS canonical_key_n
FROM registry_enrichment WHERE regexp_full_match(upper(trim(canonical_key)), '[0-9]{1,2}[AB]'))
""")
def wheel_codes_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wheel codes in any spelling brought to one; impossible ones become null."""
    rows = table(spark, sf_dir, "registry_enrichment").where(F.upper(F.trim("canonical_key")).rlike("^[0-9]{1,2}[AB]$"))
    return rows.select("row_id", music.camelot(F.col("canonical_key")).alias("key"))


@query()
def keys_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all records in any notation as wheel codes; what is neither code nor name becomes null. wheel_codes_parsed and its SQL hold wheel codes only."""
    return table(spark, sf_dir, "registry_enrichment").select("row_id", music.camelot(F.col("canonical_key")).alias("key"))


@query("""
SELECT o_custkey, CAST(count(*) AS BIGINT) AS suspects FROM (
  SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
WHERE before > 0 AND o_totalprice > 0 AND abs(o_totalprice - before) > 20 AND abs(o_totalprice - before) > 0.12 * before GROUP BY 1
""")
def duration_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring values that differ by more than an amount and a share."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.lag("o_totalprice").over(w).alias("before"))
    return rows.where(scores.duration_suspect(F.col("before"), F.col("o_totalprice"))).groupBy("o_custkey").agg(F.count("*").alias("suspects"))


@query("""
SELECT track_id, lower(regexp_replace(trim(artist_canonical), '\\s+', ' ', 'g')) AS artist_n, lower(regexp_replace(trim(title_canonical), '\\s+', ' ', 'g')) AS title_n,
  coalesce(map_extract(MAP {'original mix': 'original mix', 'original': 'original mix', 'extended mix': 'extended mix', 'extended': 'extended mix', 'extended remix': 'extended mix', 'radio edit': 'radio edit', 'radio mix': 'radio edit', 'dub mix': 'dub mix', 'dub': 'dub mix', 'vip': 'vip', 'vip mix': 'vip', 'instrumental': 'instrumental', 'instrumental mix': 'instrumental', 'live': 'live', 'live version': 'live'},
    lower(regexp_replace(trim(mix_canonical), '\\s+', ' ', 'g')))[1], lower(regexp_replace(trim(mix_canonical), '\\s+', ' ', 'g'))) AS mix_n
FROM tracks_master
""")
def identity_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist, title and mix in the form that identities are compared in."""
    return table(spark, sf_dir, "tracks_master").select(
        "track_id", text.normalise_artist(F.col("artist_canonical")).alias("artist_n"), text.normalise_title(F.col("title_canonical")).alias("title_n"), text.normalise_mix(F.col("mix_canonical")).alias("mix_n")
    )


@query("""
SELECT track_id, array_to_string(list_transform(list_filter(string_split_regex(upper(regexp_replace(title_canonical, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''), lambda x: left(x, 4)), '.') AS code,
  sha256(artist_canonical || '|' || title_canonical) AS signature, trim(regexp_replace(title_canonical, '[<>:"/\\\\|?*]', '_', 'g')) AS file_title FROM tracks_master
""")
def codes_and_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact code, content signature and a safe file name of each title."""
    t = F.col("title_canonical")
    return table(spark, sf_dir, "tracks_master").select("track_id", text.compact_code(t).alias("code"), F.sha2(F.concat_ws("|", "artist_canonical", t), 256).alias("signature"), text.safe_name(t).alias("file_title"))
