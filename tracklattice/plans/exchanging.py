"""Queries of reviews, observations, tagger results, cue points, comment lines, better copies, payloads and evidence blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.functions import codes
from tracklattice.functions.music import tempo
from tracklattice.operators import exchange, features, linkage
from tracklattice.plans.coding import _LINE, _READ, _SAID, _TOKEN, _said, comment_lines
from tracklattice.plans.registry import query
from tracklattice.session import table

_MINOR = "CASE WHEN regexp_matches(k, '^(1[0-2]|[1-9])[AB]$') THEN k END"
_VOTES = """v AS (SELECT track_id, key_camelot AS k, row_number() OVER (PARTITION BY track_id ORDER BY observation_id, observed_at, source_system, key_camelot, bpm) AS place FROM source_observations WHERE track_id IS NOT NULL AND regexp_matches(key_camelot, '^(1[0-2]|[1-9])[AB]$')),
q AS (SELECT track_id, max(k) AS suggested, min(k) AS chosen, count(*) AS n FROM v GROUP BY 1)"""


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "source_observations").where(F.col("track_id").isNotNull() & F.col("key_camelot").rlike("^(1[0-2]|[1-9])[AB]$"))
    return o.groupBy("track_id").agg(F.max("key_camelot").alias("suggested"), F.min("key_camelot").alias("chosen"), F.count("*").alias("n"))


@query(f"""
WITH {_VOTES}, d AS (SELECT *, ['accept', ' Override', 'skip', '', 'later'][CAST(n % 5 AS INTEGER) + 1] AS decision, CASE WHEN n % 10 = 0 THEN '' ELSE suggested END AS s, CASE WHEN n % 3 = 0 THEN '99Z' ELSE chosen END AS c FROM q),
o AS (SELECT d.*, CASE WHEN t.track_id IS NULL THEN 'skipped' WHEN decision = 'accept' AND s <> '' THEN 'accepted' WHEN decision = ' Override' AND c <> '99Z' THEN 'overridden' ELSE 'skipped' END AS outcome FROM d LEFT JOIN (SELECT DISTINCT track_id FROM tracks_master) t USING (track_id))
SELECT track_id, outcome, CASE outcome WHEN 'accepted' THEN s WHEN 'overridden' THEN c END AS key FROM o
""")
def review_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of reviewers as manual observations: accepted, overridden or skipped, with the key."""
    n = F.col("n")
    said = F.element_at(F.array(*[F.lit(x) for x in ("accept", " Override", "skip", "", "later")]), (n % 5 + 1).cast("int"))
    queue = _keys(spark, sf_dir).select("track_id", said.alias("decision"), F.when(n % 10 == 0, "").otherwise(F.col("suggested")).alias("suggested"), F.when(n % 3 == 0, "99Z").otherwise(F.col("chosen")).alias("chosen"))
    return exchange.reviewed(queue, table(spark, sf_dir, "tracks_master")).select("track_id", "outcome", "key")


@query(r"""
SELECT observation_id AS source_id, 'OBS-' || replace(source_system, 'analysis_', '') || '-' || file_id AS observation_id, CASE WHEN regexp_matches(key_camelot, '^(1[0-2]|[1-9])[AB]$') THEN key_camelot ELSE '' END AS key, bpm, genre
FROM source_observations WHERE (key_camelot IS NULL OR trim(key_camelot) = '' OR regexp_matches(key_camelot, '^(1[0-2]|[1-9])[AB]$')) AND (coalesce(regexp_matches(key_camelot, '^(1[0-2]|[1-9])[AB]$'), false) OR coalesce(trim(bpm) <> '', false) OR coalesce(trim(genre) <> '', false))
""")
def observations_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of an analysis: a row where there is a key or any other field."""
    plain = F.col("key_camelot").isNull() | (F.trim("key_camelot") == "") | F.col("key_camelot").rlike("^(1[0-2]|[1-9])[AB]$")
    o = table(spark, sf_dir, "source_observations").where(plain).select(F.col("observation_id").alias("source_id"), "source_system", "file_id", F.col("key_camelot").alias("key"), "bpm", "genre")
    return exchange.observations(o, "source_system", "file_id", "key", ["bpm", "genre"]).select("source_id", "observation_id", "key", "bpm", "genre")


@query("""
SELECT track_id, coalesce(list_sort(list_distinct(list(trim(genre)) FILTER (trim(genre) <> ''))), []) AS genres, arg_min(bpm, {'a': observed_at, 'b': observation_id, 'c': bpm}) FILTER (trim(bpm) <> '') AS bpm, arg_min(popularity, {'a': observed_at, 'b': observation_id, 'c': popularity}) FILTER (trim(popularity) <> '') AS popularity
FROM source_observations WHERE track_id IS NOT NULL GROUP BY 1
""")
def evidence_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a track: all genres said of it, and the first value of each further field that is filled."""
    first = lambda c: F.min_by(c, F.when(F.trim(c) != "", F.struct("observed_at", "observation_id", c))).alias(c)
    o = table(spark, sf_dir, "source_observations").where("track_id is not null")
    return o.groupBy("track_id").agg(F.array_sort(F.collect_set(F.when(F.trim("genre") != "", F.trim("genre")))).alias("genres"), first("bpm"), first("popularity"))


@query("""
WITH r AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN danceability END AS a, danceability AS b, CASE WHEN row_id % 2 = 0 THEN '' ELSE coalesce(primary_genre, '') END AS ss, coalesce(primary_genre, '') AS rb, CASE WHEN row_id % 4 = 0 THEN '' ELSE array_to_string(all_genres, ' ; ') END AS every, canonical_key AS k, canonical_bpm AS b2 FROM registry_enrichment)
SELECT row_id, TRY_CAST(coalesce(nullif(a, ''), b) AS DOUBLE) AS danceability, TRY_CAST(coalesce(nullif(a, ''), b) AS DOUBLE) IS NOT NULL AS has_service, coalesce(nullif(trim(ss), ''), trim(rb)) AS primary_genre,
  CASE WHEN trim(coalesce(every, '')) <> '' THEN list_filter(list_transform(string_split(every, ';'), lambda x: trim(x)), lambda x: x <> '') WHEN coalesce(nullif(trim(ss), ''), trim(rb)) <> '' THEN [coalesce(nullif(trim(ss), ''), trim(rb))] ELSE [] END AS genres,
  CASE WHEN trim(k) NOT IN ('', '??') THEN trim(k) END AS key, TRY_CAST(nullif(trim(b2), '') AS DOUBLE) AS bpm FROM r
""")
def overview_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an overview read with their fallbacks: a prefixed column before the plain one, one genre source before the other, lists at semicolons."""
    i = F.col("row_id")
    r = table(spark, sf_dir, "registry_enrichment").select(
        "row_id", F.when(i % 3 == 0, F.col("danceability")).alias("a"), F.col("danceability").alias("b"), F.when(i % 2 == 0, "").otherwise(F.coalesce("primary_genre", F.lit(""))).alias("ss"), F.coalesce("primary_genre", F.lit("")).alias("rb"),
        F.when(i % 4 == 0, "").otherwise(F.array_join("all_genres", " ; ")).alias("every"), F.trim("canonical_key").alias("k"), F.trim("canonical_bpm").alias("b2"),
    )
    value = F.coalesce(F.nullif(F.col("a"), F.lit("")), F.col("b")).try_cast("double")
    genre = F.coalesce(F.nullif(F.trim("ss"), F.lit("")), F.trim("rb"))
    listed = F.filter(F.transform(F.split("every", ";"), lambda x: F.trim(x)), lambda x: x != "")
    genres = F.when(F.trim(F.coalesce("every", F.lit(""))) != "", listed).when(genre != "", F.array(genre)).otherwise(F.array().cast("array<string>"))
    return r.select("row_id", value.alias("danceability"), value.isNotNull().alias("has_service"), genre.alias("primary_genre"), genres.alias("genres"), F.when(~F.col("k").isin("", "??"), F.col("k")).alias("key"), F.nullif(F.col("b2"), F.lit("")).try_cast("double").alias("bpm"))


@query(f"""
WITH {_READ}, {_SAID}, t AS (SELECT track_id, CASE WHEN energy > 2 THEN energy END AS energy, {_MINOR} AS key, CASE WHEN length(track_id) % 2 = 0 THEN CAST(energy AS INTEGER) * 30 END AS bpm, 'DRK' AS mood, 'INST' AS vocal, energy AS ne, '4A' AS nk, TRY_CAST(canonical_bpm AS DOUBLE) AS nb, nullif(g.mood, '') AS nm, g.vocal AS nv FROM g),
m AS (SELECT *, energy IS NULL OR key IS NULL AS missing FROM t)
SELECT track_id, CASE WHEN missing AND ne IS NOT NULL THEN ne ELSE energy END AS energy, CASE WHEN missing THEN nk ELSE key END AS key, CASE WHEN missing AND bpm IS NULL AND nb > 0 THEN CAST(round(nb) AS INTEGER) ELSE bpm END AS bpm,
  CASE WHEN nm IS NOT NULL THEN coalesce(mc.c, {_TOKEN.format('nm')}) ELSE mood END AS mood, CASE WHEN coalesce(nv, '') <> '' THEN coalesce(vc.c, {_TOKEN.format('nv')}) ELSE vocal END AS vocal
FROM m LEFT JOIN mc ON mc.k = {_TOKEN.format('nm')} LEFT JOIN vc ON vc.k = {_TOKEN.format('nv')}
""")
def tagger_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagger's result applied: what is missing is filled, mood and vocal profile are replaced."""
    from tracklattice.functions.music import is_wheel_code

    g = _said(spark, sf_dir)
    rows = g.select(
        "track_id", F.when(F.col("energy") > 2, F.col("energy")).alias("energy"), F.when(is_wheel_code(F.col("k")), F.col("k")).alias("key"), F.when(F.length("track_id") % 2 == 0, F.col("energy") * 30).alias("bpm"), F.lit("DRK").alias("mood"),
        F.lit("INST").alias("vocal"), F.col("energy").alias("new_energy"), F.lit("4A").alias("new_key"), F.col("canonical_bpm").try_cast("double").alias("new_bpm"), F.nullif(F.col("mood"), F.lit("")).alias("new_mood"), F.col("vocal").alias("new_vocal"),
    )
    return exchange.with_tagger_result(rows, F.col("energy").isNull() | F.col("key").isNull())


@query("""
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS place, CAST(value AS DOUBLE) AS time FROM events WHERE user_id % 5 > 0 AND value IS NOT NULL
""")
def cue_grid_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids written as payloads and read back; payloads of another schema give no row."""
    e = table(spark, sf_dir, "events").where("value is not null")
    stored = exchange.cue_grid(e, "user_id", "event_id", "value")
    other = F.when(F.col("user_id") % 5 == 0, F.regexp_replace("payload", exchange.CUE_SCHEMA, "other")).otherwise(F.col("payload"))
    return exchange.cue_grid_read(stored.withColumn("payload", other), "user_id", "payload")


_CUES = """c AS (SELECT l_orderkey * 10 + l_linenumber AS cue_id, l_orderkey % 500 AS track_id, ['hot', 'memory', 'loop', 'odd'][CAST(l_linenumber % 4 + 1 AS INTEGER)] AS kind, CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_quantity AS INTEGER) % 10 ELSE -1 END AS num, l_quantity AS start, l_quantity + l_linenumber - 3 AS "end",
  ['A', 'B', 'C'][CAST(l_suppkey % 3 + 1 AS INTEGER)] AS name FROM lineitem),
m AS (SELECT track_id, CASE WHEN kind = 'loop' THEN 4 ELSE 0 END AS type, num, start, "end", name FROM c WHERE cue_id % 17 = 0)"""


@query(f"""
WITH {_CUES}, p AS (SELECT c.cue_id, bool_and(m.name = c.name) AS gen FROM c JOIN m ON m.track_id = c.track_id AND (CASE c.kind WHEN 'hot' THEN m.type = 0 AND m.num >= 0 AND m.num = c.num WHEN 'memory' THEN m.type = 0 AND m.num = -1 AND abs(m.start - c.start) <= 0.001
  WHEN 'loop' THEN m.type = 4 AND abs(m.start - c.start) <= 0.001 AND abs(m."end" - c."end") <= 0.001 ELSE false END) GROUP BY 1),
s AS (SELECT CASE WHEN c.track_id % 11 = 0 THEN 'unmatched' WHEN NOT (CASE c.kind WHEN 'hot' THEN c.num BETWEEN 0 AND 7 WHEN 'memory' THEN c.num = -1 WHEN 'loop' THEN c.num = -1 AND c."end" > c.start ELSE false END) THEN 'invalid' WHEN gen IS NULL THEN 'would_insert' WHEN gen THEN 'would_replace' ELSE 'skipped_conflict' END AS status, c.kind AS kind
  FROM c LEFT JOIN p USING (cue_id)) SELECT kind, status, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2
""")
def cue_sink_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What writing cue points into a collection would do: insert, replace its own, leave a conflict, refuse what is invalid."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    c = li.select(
        (F.col("l_orderkey") * 10 + n).alias("cue_id"), (F.col("l_orderkey") % 500).alias("track_id"), F.element_at(F.array(*[F.lit(x) for x in ("hot", "memory", "loop", "odd")]), (n % 4 + 1).cast("int")).alias("kind"),
        F.when(n % 4 == 0, F.col("l_quantity").cast("int") % 10).otherwise(-1).alias("num"), F.col("l_quantity").cast("double").alias("start"), (F.col("l_quantity") + n - 3).cast("double").alias("end"), F.element_at(F.array(*[F.lit(x) for x in "ABC"]), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("name"),
    )
    marks = c.where("cue_id % 17 = 0").select("track_id", F.when(F.col("kind") == "loop", 4).otherwise(0).alias("type"), "num", "start", "end", "name")
    done = exchange.cue_statuses(c, marks, c.where("track_id % 11 > 0"), "replace-generated", dry_run=True)
    return done.groupBy("kind", "status").agg(F.count("*").alias("n"))


@query(f"""
WITH {_CUES}, f AS (SELECT cue_id, (cue_id % 100) / 100.0 AS conf, ['fallback bar', 'adjusted', 'no_bar_grid', 'short_loop x', '', 'possible_grid_offset'][CAST(cue_id % 6 + 1 AS INTEGER)] AS reason, kind, ['peak', 'intro', 'outro_start'][CAST(cue_id % 3 + 1 AS INTEGER)] AS role, "end" AS e, CASE WHEN cue_id % 13 = 0 THEN 0.0 ELSE 45.0 END AS len, CASE WHEN cue_id % 5 = 0 THEN 'skipped_conflict' ELSE 'inserted' END AS status FROM c),
x AS (SELECT list_filter([CASE WHEN conf < 0.55 THEN 'low_confidence' END, CASE WHEN reason IN ('fallback bar', 'no_bar_grid') THEN 'fallback_used' END, CASE WHEN role IN ('peak', 'outro_start') AND reason = 'fallback bar' THEN 'missing_section' END, CASE WHEN kind = 'loop' AND reason = 'short_loop x' THEN 'short_loop' END,
  CASE WHEN kind = 'loop' AND len > 0 AND e >= greatest(0.0, len - 10) THEN 'loop_near_track_end' END, CASE WHEN reason = 'adjusted' THEN 'cue_order_adjusted' END, CASE WHEN reason = 'possible_grid_offset' THEN 'possible_grid_offset' END, CASE WHEN status = 'skipped_conflict' THEN 'export_conflict' END], lambda v: v IS NOT NULL) AS flags FROM f)
SELECT array_to_string(flags, ',') AS flags, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1
""")
def cue_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubts about cue points, counted."""
    li = table(spark, sf_dir, "lineitem")
    n, i = F.col("l_linenumber"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    pick = lambda words, m: F.element_at(F.array(*[F.lit(w) for w in words]), (i % m + 1).cast("int"))
    flags = exchange.cue_flags(
        (i % 100) / 100.0, pick(["fallback bar", "adjusted", "no_bar_grid", "short_loop x", "", "possible_grid_offset"], 6), F.element_at(F.array(*[F.lit(x) for x in ("hot", "memory", "loop", "odd")]), (n % 4 + 1).cast("int")), pick(["peak", "intro", "outro_start"], 3),
        (F.col("l_quantity") + n - 3).cast("double"), F.when(i % 13 == 0, 0.0).otherwise(45.0), F.when(i % 5 == 0, "skipped_conflict").otherwise("inserted"),
    )
    return li.select(F.array_join(flags, ",").alias("flags")).groupBy("flags").agg(F.count("*").alias("n"))


@query(f"""
WITH {_LINE}, d AS (SELECT primary_file_id AS file_id, track_id, CASE WHEN length(track_id || coalesce(title_canonical, '')) % 2 = 0 THEN (SELECT any_value(line) FROM l WHERE l.track_id = t.track_id) ELSE 'old' END AS comment FROM tracks_master t WHERE primary_file_id IS NOT NULL)
SELECT file_id, d.track_id, CASE WHEN l.line IS NULL THEN 'no line' WHEN comment IS NOT DISTINCT FROM l.line THEN 'same' ELSE 'write' END AS action FROM d LEFT JOIN (SELECT * FROM l WHERE length(line) % 5 > 0) l USING (track_id)
""")
def comment_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files' comments a synchronisation writes: only those that differ."""
    lines = comment_lines(spark, sf_dir)
    t = table(spark, sf_dir, "tracks_master").where("primary_file_id is not null")
    even = F.length(F.concat("track_id", F.coalesce("title_canonical", F.lit("")))) % 2 == 0
    files = t.join(lines.withColumnRenamed("line", "own"), "track_id", "left").select(F.col("primary_file_id").alias("file_id"), "track_id", F.when(even, F.col("own")).otherwise("old").alias("comment"))
    return exchange.line_changes(files, lines.where(F.length("line") % 5 > 0)).select("file_id", "track_id", "action")


@query("""
WITH p AS (SELECT file_no AS track, path AS stem, CAST(file_no % 4 AS INTEGER) AS tier, coalesce(extension, '') AS cut FROM file_entries), o AS (SELECT row_id % 5000 AS track, name AS offer, CAST(row_id % 5 AS INTEGER) AS tier, ['mp3', 'flac', 'wav'][CAST(row_id % 3 + 1 AS INTEGER)] AS cut FROM playlist_tracks WHERE name IS NOT NULL),
b AS (SELECT track, arg_max(offer, {'t': tier, 'o': encode(offer)}) AS offer, max(tier) AS tier, arg_max(cut, {'t': tier, 'o': encode(offer), 'c': cut}) AS cut FROM o GROUP BY 1),
v AS (SELECT p.track, p.stem, CASE WHEN p.tier >= 3 THEN 'best already' WHEN p.track % 7 = 0 THEN 'checked before' WHEN b.track IS NULL THEN 'not found' WHEN p.cut <> b.cut THEN 'other cut' WHEN b.tier <= p.tier THEN 'no upgrade' ELSE 'upgrade' END AS verdict, b.offer FROM p LEFT JOIN b USING (track))
SELECT track, stem, verdict, CASE WHEN verdict = 'upgrade' THEN offer END AS offer FROM v
""")
def upgrade_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on looking for better copies of the files."""
    f = table(spark, sf_dir, "file_entries").select(F.col("file_no").alias("track"), F.col("path").alias("stem"), (F.col("file_no") % 4).cast("int").alias("tier"), F.coalesce("extension", F.lit("")).alias("cut"))
    i = F.col("row_id")
    offers = table(spark, sf_dir, "playlist_tracks").where("name is not null").select((i % 5000).alias("track"), F.col("name").alias("offer"), (i % 5).cast("int").alias("tier"), F.element_at(F.array(*[F.lit(x) for x in ("mp3", "flac", "wav")]), (i % 3 + 1).cast("int")).alias("cut"))
    best = offers.groupBy("track").agg(F.max_by(F.struct("offer", "tier", "cut"), F.struct("tier", "offer", "cut")).alias("x")).select("track", "x.*")
    return exchange.upgrade_verdicts(f, f.where("track % 7 = 0").select("track", "stem"), best)


@query("""
WITH f AS (SELECT file_no, path, audio_duration_sec AS d, mtime_utc FROM file_entries WHERE audio_duration_sec > 0 AND file_no % 6 > 0), w AS (SELECT row_id, duration_sec AS d FROM playlist_tracks WHERE duration_sec > 0 AND duration_sec < 10000),
n AS (SELECT w.row_id, arg_min(f.file_no, {'g': round(abs(f.d - w.d), 6), 'f': f.file_no}) AS file_no, round(min(abs(f.d - w.d)), 6) AS gap FROM w JOIN f ON floor(f.d / 2) BETWEEN floor(w.d / 2) - 1 AND floor(w.d / 2) + 1 WHERE abs(f.d - w.d) <= 2 AND f.file_no % 100 = w.row_id % 100 GROUP BY 1)
SELECT * FROM n
""")
def repair_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row the own file nearest in duration within two seconds, files already logged left out; candidates meet by group and band of duration."""
    f = table(spark, sf_dir, "file_entries").where("audio_duration_sec > 0").select("file_no", F.col("audio_duration_sec").alias("f_d"))
    logged = f.where("file_no % 6 = 0").select("file_no")
    w = table(spark, sf_dir, "playlist_tracks").where("duration_sec > 0 and duration_sec < 10000").select("row_id", F.col("duration_sec").alias("d"), (F.col("row_id") % 100).alias("grp"))
    band = F.floor(F.col("d") / 2)
    left = w.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    right = f.join(logged, "file_no", "left_anti").select("file_no", "f_d", (F.col("file_no") % 100).alias("grp"), F.floor(F.col("f_d") / 2).alias("band"))
    gap = F.round(F.abs(F.col("d") - F.col("f_d")), 6)
    return left.join(right, ["grp", "band"]).where(F.abs(F.col("d") - F.col("f_d")) <= 2).groupBy("row_id").agg(F.min_by("file_no", F.struct(gap.alias("g"), "file_no")).alias("file_no"), F.min(gap).alias("gap"))


@query("SELECT extension, arg_max(path, {'m': mtime_utc, 'p': path}) AS path, max(mtime_utc) AS modified FROM file_entries GROUP BY 1")
def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file changed last of each kind."""
    return table(spark, sf_dir, "file_entries").groupBy("extension").agg(F.max_by("path", F.struct("mtime_utc", "path")).alias("path"), F.max("mtime_utc").alias("modified"))


@query(f"""
WITH {_READ}, {_SAID}, c AS (SELECT track_id, coalesce(vc.c, {_TOKEN.format('vocal')}) AS code, (energy / 5.0) AS conf FROM g LEFT JOIN vc ON vc.k = {_TOKEN.format('vocal')}),
s AS (SELECT track_id, code <> '' AND code NOT IN ('INST', 'TOOL', 'DUB') AND coalesce(conf, 1.0) >= 0.6 AS sure FROM c) SELECT track_id, CASE WHEN sure AND (SELECT count(*) FROM s WHERE sure) >= 2 THEN 1 ELSE 0 END AS part FROM s
""")
def vocal_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that are surely sung apart from the rest, before either is clustered."""
    return exchange.soft_partition(_said(spark, sf_dir), codes.is_sung(F.col("vocal")), F.col("energy") / 5.0, 0.6, "part").select("track_id", "part")


@query("""
SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
UNION ALL SELECT event_id, 'stats.k', json_extract_string(props, '$.k') FROM events WHERE event_id % 3 = 0 AND json_extract_string(props, '$.k') IS NOT NULL
""")
def nested_key_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a name anywhere inside JSON payloads, with their path."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "stats": '), F.col("props"), F.lit("}"))).otherwise(F.col("props")).alias("props"))
    return exchange.nested_keys(e, "event_id", "props", "^k$", 3).where("value is not null")


@query("""
WITH s AS (SELECT l_orderkey AS track, l_linenumber AS slice, CAST(l_extendedprice AS DOUBLE) AS level, l_returnflag AS stem FROM lineitem), m AS (SELECT track, stem, median(level) AS middle, var_pop(level) AS spread, sum(level) AS total FROM s GROUP BY 1, 2)
SELECT track, stem, round(middle, 4) AS middle, round(spread / 1e6, 3) AS spread, round(total / sum(total) OVER (PARTITION BY track), 6) AS share FROM m
""")
def stem_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the parts of a recording over its slices: median, variance and share of the whole."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track"), F.col("l_returnflag").alias("stem")).agg(F.median(F.col("l_extendedprice").cast("double")).alias("middle"), F.var_pop(F.col("l_extendedprice").cast("double")).alias("spread"), F.sum(F.col("l_extendedprice").cast("double")).alias("total"))
    whole = s.groupBy("track").agg(F.sum("total").alias("whole"))
    return s.join(whole, "track").select("track", "stem", F.round("middle", 4).alias("middle"), F.round(F.col("spread") / 1e6, 3).alias("spread"), F.round(F.col("total") / F.col("whole"), 6).alias("share"))


@query("SELECT file_no, path || '|' || printf('%.1f', CAST(CAST(coalesce(audio_duration_sec, 0) * 1000 AS BIGINT) // 100 AS DOUBLE) / 10) || '|raw' AS cache_id FROM file_entries")
def cache_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of cache entries: path, duration to a tenth of a second, layer."""
    tenths = F.floor((F.coalesce("audio_duration_sec", F.lit(0.0)) * 1000).cast("decimal(20,0)").cast("long") / 100)
    return table(spark, sf_dir, "file_entries").select("file_no", F.concat("path", F.lit("|"), (tenths / 10).cast("decimal(18,1)").cast("string"), F.lit("|raw")).alias("cache_id"))


@query("""
WITH a AS (SELECT track_id, lower(trim(source_system)) AS s, TRY_CAST(popularity AS DOUBLE) AS p, (length(coalesce(title, '')) % 11) / 10.0 AS valence, CASE WHEN length(coalesce(artist, '')) % 4 > 0 THEN (length(artist) % 13) / 12.0 END AS energy FROM source_observations WHERE track_id IS NOT NULL),
b AS (SELECT *, least(1.0, greatest(0.0, p / 100)) AS q FROM a),
x AS (SELECT track_id, 'num:' || s || ':valence' AS feature, valence AS value FROM b UNION ALL SELECT track_id, 'num:' || s || ':energy', energy FROM b WHERE energy IS NOT NULL
  UNION ALL SELECT track_id, 'audio_band:valence:' || CASE WHEN valence < 0.25 THEN 'very_low' WHEN valence < 0.45 THEN 'low' WHEN valence < 0.65 THEN 'mid' WHEN valence < 0.82 THEN 'high' ELSE 'very_high' END, 1.0 FROM b
  UNION ALL SELECT track_id, 'audio_band:energy:' || CASE WHEN energy < 0.25 THEN 'very_low' WHEN energy < 0.45 THEN 'low' WHEN energy < 0.65 THEN 'mid' WHEN energy < 0.82 THEN 'high' ELSE 'very_high' END, 1.0 FROM b WHERE energy IS NOT NULL
  UNION ALL SELECT track_id, 'cue:dark', 1.0 FROM b WHERE valence <= 0.30 UNION ALL SELECT track_id, unnest(['cue:driving', 'cue:peak']), 1.0 FROM b WHERE energy >= 0.78
  UNION ALL SELECT track_id, 'num:' || s || ':popularity', q FROM b WHERE p >= 0 UNION ALL SELECT track_id, 'popularity_band:' || s || ':' || CASE WHEN q < 0.25 THEN 'lo' WHEN q < 0.60 THEN 'mid' ELSE 'hi' END, 1.0 FROM b WHERE p >= 0)
SELECT track_id, feature, round(max(value), 9) AS value FROM x GROUP BY 1, 2
""")
def audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a service's audio values and popularity."""
    n = F.length(F.coalesce("title", F.lit("")))
    a = table(spark, sf_dir, "source_observations").where("track_id is not null").select(
        "track_id", F.lower(F.trim("source_system")).alias("s"), F.col("popularity").try_cast("double").alias("p"), ((n % 11) / 10.0).alias("valence"), F.when(F.length(F.coalesce("artist", F.lit(""))) % 4 > 0, (F.length("artist") % 13) / 12.0).alias("energy")
    )
    return features.audio_block(a, "track_id", "s", ["valence", "energy"], "p").withColumn("value", F.round("value", 9))


@query("""
WITH g AS (SELECT track_id, CASE lower(trim(source_system)) WHEN 'rekordbox' THEN 1.5 WHEN 'embedded' THEN 1.2 WHEN 'songstats' THEN 1.3 WHEN 'spotify' THEN 1.1 ELSE 1.0 END AS w, unnest(string_split_regex(lower(genre), '[;,/|]+')) AS t FROM source_observations WHERE track_id IS NOT NULL AND genre IS NOT NULL)
SELECT track_id, 'provider_genre:' || regexp_replace(trim(t), '\\s+', '_', 'g') AS feature, CAST(max(w) AS DOUBLE) AS value FROM g WHERE trim(t) <> '' GROUP BY 1, 2
""")
def provider_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre tokens of the sources with the weight of the best source."""
    return features.provider_block(table(spark, sf_dir, "source_observations").where("track_id is not null"), "track_id", "source_system", "genre")


_PRIORS = "pr AS (SELECT trim(label_canonical) AS key, canonical_genre AS category, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY trim(label_canonical)) AS DOUBLE), 6) AS weight FROM tracks_master WHERE trim(label_canonical) <> '' AND trim(canonical_genre) <> '' GROUP BY 1, 2)"


@query(f"WITH {_PRIORS} SELECT t.track_id, 'prior:label:' || category AS feature, max(weight) AS value FROM tracks_master t JOIN pr ON pr.key = trim(t.label_canonical) GROUP BY 1, 2")
def prior_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that a track's label stands for, by their share among the label's tracks."""
    t = table(spark, sf_dir, "tracks_master")
    n = t.where((F.trim("label_canonical") != "") & (F.trim("canonical_genre") != "")).groupBy(F.trim("label_canonical").alias("key"), F.col("canonical_genre").alias("category")).agg(F.count("*").alias("n"))
    whole = n.groupBy("key").agg(F.sum("n").alias("whole"))
    priors = n.join(whole, "key").select("key", "category", F.round(F.col("n") / F.col("whole").cast("double"), 6).alias("weight"))
    return features.prior_block(t, "track_id", "label_canonical", priors, "label")


@query("""
WITH t AS (SELECT track_id, TRY_CAST(canonical_bpm AS DOUBLE) AS b FROM tracks_master WHERE TRY_CAST(canonical_bpm AS DOUBLE) BETWEEN 40 AND 250), r AS (SELECT category_no, id, family, bpm_range[1] AS lo, bpm_range[2] AS hi FROM dj_taxonomy_category WHERE len(bpm_range) = 2)
SELECT track_id, family, round(CAST(count(*) AS DOUBLE) * 0.15, 6) AS score, list_slice(list_sort(list_distinct(list(id || ' ' || lo || '-' || hi))), 1, 8) AS reasons FROM t JOIN r ON b BETWEEN lo AND hi GROUP BY 1, 2
""")
def tempo_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families whose categories' tempo ranges hold a track's tempo, with a score and at most eight reasons."""
    t = table(spark, sf_dir, "tracks_master").select("track_id", F.col("canonical_bpm").try_cast("double").alias("bpm")).where("bpm between 40 and 250")
    rules = table(spark, sf_dir, "dj_taxonomy_category").where(F.size("bpm_range") == 2).select("category_no", "id", "family", F.col("bpm_range")[0].alias("low"), F.col("bpm_range")[1].alias("high"))
    hit = features.range_priors(t, "track_id", "bpm", rules, "category_no", "low", "high").join(F.broadcast(rules), "category_no")  # the taxonomy is fixed
    hit = hit.select("track_id", "family", F.struct("track_id", "family").alias("of"), F.concat_ws(" ", "id", F.concat_ws("-", F.col("low").cast("string"), F.col("high").cast("string"))).alias("reason"), F.lit(0.15).alias("weight"))
    reasons = features.explained(hit, "of", "reason", "weight").select("of.*", "reasons")
    return hit.groupBy("track_id", "family").agg(F.round(F.count("*") * 0.15, 6).alias("score")).join(reasons, ["track_id", "family"])


@query("""
WITH j AS (SELECT event_id, user_id, json_extract_string(props, '$.k') AS k, value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)
SELECT 'OBS-service-' || event_id AS observation_id, user_id, CAST(CAST(k AS INTEGER) % 12 + 1 AS VARCHAR) || CASE WHEN CAST(k AS INTEGER) % 2 = 0 THEN 'A' ELSE 'B' END AS key, CAST(value AS DOUBLE) AS valence FROM j
""")
def payload_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a service, nested JSON, as observations: key and mode become a wheel code, audio values come out of their list."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k INT")["k"]).where("k is not null")
    audio = F.array(F.struct(F.lit("valence").alias("key"), F.col("value").cast("string").alias("value")), F.struct(F.lit("mode").alias("key"), (F.col("k") % 2).cast("string").alias("value")))
    answers = e.select("event_id", "user_id", F.to_json(F.struct(F.struct(F.struct((F.col("k") % 12 + 1).alias("number"), audio.alias("audio_analysis")).alias("track")).alias("result"))).alias("payload"))
    read = F.from_json("payload", "result STRUCT<track: STRUCT<number: INT, audio_analysis: ARRAY<STRUCT<key: STRING, value: STRING>>>>")
    flat = answers.select("event_id", "user_id", read["result"]["track"].alias("t")).withColumn("a", F.map_from_entries("t.audio_analysis"))
    side = F.when(F.col("a")["mode"] == "0", "A").otherwise("B")
    return flat.select(F.concat(F.lit("OBS-service-"), F.col("event_id")).alias("observation_id"), "user_id", F.concat(F.col("t.number").cast("string"), side).alias("key"), F.col("a")["valence"].cast("double").alias("valence"))


_LEVELS = f"""ev AS (SELECT o.track_id, g.family, CASE WHEN length(o.genre) % 7 > 0 THEN o.genre END AS genre, CASE WHEN length(o.genre) % 7 > 0 AND length(o.genre) % 3 > 0 THEN g.aliases[1] END AS sub, length(o.genre) % 2 = 0 AS broad,
  CAST(CASE lower(trim(source_system)) WHEN 'manual' THEN 1.0 WHEN 'rekordbox' THEN 0.75 WHEN 'tag' THEN 0.6 ELSE 0.45 END AS DOUBLE) AS d FROM source_observations o JOIN genre_reference g ON o.genre = g.genre WHERE o.track_id IS NOT NULL),
l AS (SELECT *, CASE WHEN genre IS NULL THEN 1 WHEN sub IS NULL THEN 2 WHEN broad THEN 4 ELSE 3 END AS lv FROM ev),
x AS (SELECT track_id, family, NULL AS genre, NULL AS sub, d * [1.0, 0.30, 0.22, 0.28][lv] AS s FROM l UNION ALL SELECT track_id, family, genre, NULL, d * [0, 1.0, 0.52, 0.78][lv] FROM l WHERE lv > 1 UNION ALL SELECT track_id, family, genre, sub, d * [0, 0, 1.0, 0.42][lv] FROM l WHERE lv > 2),
p AS (SELECT track_id, family, genre, sub, round(CAST(sum(s) AS DOUBLE), 6) AS score FROM x GROUP BY 1, 2, 3, 4)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklattice.operators import taxonomy

    n = F.length("genre")
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in (("manual", 1.0), ("rekordbox", 0.75), ("tag", 0.6)) for x in kv])[F.lower(F.trim("source_system"))], F.lit(0.45))
    ref = F.broadcast(table(spark, sf_dir, "genre_reference").select("genre", "family", F.get("aliases", F.lit(0)).alias("alias")))  # the reference list is fixed
    o = table(spark, sf_dir, "source_observations").where("track_id is not null").join(ref, "genre")
    ev = o.select("track_id", "family", F.when(n % 7 > 0, F.col("genre")).alias("g"), F.when((n % 7 > 0) & (n % 3 > 0), F.col("alias")).alias("sub"), (n % 2 == 0).alias("broad"), weight.alias("d"))
    return taxonomy.path_scores(ev, "track_id", "family", "g", "sub", "d", "broad")


@query(f"WITH {_LEVELS} SELECT track_id, family, genre, sub AS subgenre, score FROM p")
def taxonomy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence added up on three levels, each level by its share."""
    return _paths(spark, sf_dir)


@query(f"""
WITH {_LEVELS}, f AS (SELECT track_id, arg_min(family, {{'s': -score, 'n': family}}) AS family, max(score) AS family_score FROM p WHERE genre IS NULL AND score >= 0.25 GROUP BY 1),
g AS (SELECT track_id, family, arg_min(genre, {{'s': -score, 'n': genre}}) AS genre FROM p WHERE genre IS NOT NULL AND sub IS NULL AND score >= 0.26 GROUP BY 1, 2), s AS (SELECT track_id, family, genre, arg_min(sub, {{'s': -score, 'n': sub}}) AS subgenre FROM p WHERE sub IS NOT NULL AND score >= 0.26 GROUP BY 1, 2, 3)
SELECT i.track_id, f.family, g.genre, s.subgenre, f.family_score FROM (SELECT DISTINCT track_id FROM p) i LEFT JOIN f USING (track_id) LEFT JOIN g ON g.track_id = i.track_id AND g.family = f.family LEFT JOIN s ON s.track_id = i.track_id AND s.family = g.family AND s.genre = g.genre
""")
def three_level_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family, genre and subgenre of each track, each above its threshold inside the one before."""
    from tracklattice.operators import taxonomy

    return taxonomy.deepest_path(_paths(spark, sf_dir), "track_id")


@query("""
WITH t AS (SELECT track_id, lower(trim(title_canonical)) AS k, duration_sec_canonical AS d, nullif(trim(isrc_canonical), '') AS isrc FROM tracks_master), c AS (SELECT k, d, isrc FROM t WHERE regexp_matches(isrc, '^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$')),
b AS (SELECT t.track_id, arg_min(c.isrc, {'g': round(abs(t.d - c.d), 6), 'i': c.isrc}) AS found FROM t JOIN c ON t.k = c.k WHERE t.isrc IS NULL AND t.d > 0 AND c.d > 0 GROUP BY 1)
SELECT t.track_id, coalesce(t.isrc, b.found) AS isrc, CASE WHEN t.isrc IS NOT NULL THEN 'own' WHEN b.found IS NOT NULL THEN 'found' ELSE 'none' END AS source FROM t LEFT JOIN b USING (track_id)
""")
def isrc_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing recording codes filled from the hit of the same title whose duration is nearest."""
    t = table(spark, sf_dir, "tracks_master").select("track_id", F.lower(F.trim("title_canonical")).alias("k"), F.col("duration_sec_canonical").alias("d"), F.nullif(F.trim("isrc_canonical"), F.lit("")).alias("isrc"))
    hits = t.where(F.col("isrc").rlike("^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$") & (F.col("d") > 0)).select("k", "d", F.col("isrc").alias("found"))
    found = linkage.nearest_in_group(t.where("isrc is null and d > 0"), "track_id", hits, "found", "k", "d")
    return t.join(found, "track_id", "left").select("track_id", F.coalesce("isrc", "found").alias("isrc"), F.when(F.col("isrc").isNotNull(), "own").when(F.col("found").isNotNull(), "found").otherwise("none").alias("source"))
