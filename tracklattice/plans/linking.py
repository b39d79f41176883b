"""Queries of linkage, ordering and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklattice.functions import music, text
from tracklattice.operators import linkage
from tracklattice.plans.registry import query
from tracklattice.session import table


@query("""
WITH l AS (SELECT row_id, track_id, file_name FROM registry_enrichment),
n AS (SELECT track_id, lower(artist_canonical || ' - ' || title_canonical) AS name FROM tracks_master),
a AS (SELECT l.row_id, min(t.track_id) AS track_id FROM l JOIN tracks_master t ON l.track_id = t.track_id GROUP BY 1),
b AS (SELECT l.row_id, min(n.track_id) AS track_id FROM l JOIN n ON lower(regexp_replace(regexp_replace(l.file_name, '^.*[/]', ''), '\\.[^.]+$', '')) = n.name WHERE l.row_id NOT IN (SELECT row_id FROM a) GROUP BY 1)
SELECT l.row_id, coalesce(a.track_id, b.track_id) AS track_id, CASE WHEN a.row_id IS NOT NULL THEN 'id' WHEN b.row_id IS NOT NULL THEN 'name' ELSE 'new' END AS method,
  CASE WHEN a.row_id IS NOT NULL THEN 1.0 WHEN b.row_id IS NOT NULL THEN 0.95 ELSE 1.0 END AS score
FROM l LEFT JOIN a USING (row_id) LEFT JOIN b USING (row_id)
""")
def link_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment records linked to tracks by id, then by the name of their file."""
    rows = table(spark, sf_dir, "registry_enrichment").select("row_id", "track_id", F.lower(text.file_stem(F.col("file_name"))).alias("name"))
    tracks = table(spark, sf_dir, "tracks_master").select("track_id", F.lower(F.concat_ws(" - ", "artist_canonical", "title_canonical")).alias("name"))
    passes = [("id", 1.0, [(F.col("l_track_id"), F.col("r_track_id"))], None), ("name", 0.95, [(F.col("l_name"), F.col("r_name"))], None)]
    return linkage.cascade(rows, tracks, "row_id", "track_id", passes)


@query("""
SELECT p.p_partkey, p.p_brand, p.p_size, x.l_partkey FROM part p LEFT JOIN (
  SELECT p_brand, p_size, min(p_partkey) AS l_partkey FROM part GROUP BY 1, 2 HAVING count(*) = 1) x USING (p_brand, p_size)
""")
def unique_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match over (brand, size) only where that key is unique."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return linkage.unique_key_match(part, part.withColumnRenamed("p_partkey", "l_partkey"), ["p_brand", "p_size"], "l_partkey")


@query("""
SELECT a.o_custkey, least(a.o_orderkey, b.o_orderkey) AS id_a, greatest(a.o_orderkey, b.o_orderkey) AS id_b
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.o_totalprice - b.o_totalprice) <= 500.0
""")
def band_join_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one customer's orders within a tolerance of price."""
    return linkage.band_pairs(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 500.0)


_TOKENS_P = "list_filter(list_distinct(string_split_regex(regexp_replace(translate(lower({c}), 'áàâäãåāéèêëēíìîïīóòôöõøōúùûüūýÿñçšž', 'aaaaaaaeeeeeiiiiiooooooouuuuuyyncsz'), '[^a-z0-9]+', ' ', 'g'), ' ')), lambda w: length(w) >= 2)"

_MATCH = f"""
q AS (SELECT row_id, {_TOKENS_P.format(c='name')} AS qt, {_TOKENS_P.format(c="array_to_string(artists, ' ')")} AS qa FROM playlist_tracks),
f AS (SELECT file_no, list_distinct(all_tokens) AS fa, list_distinct(title_tokens) AS ft FROM file_entries),
qx AS (SELECT row_id, unnest(qt) AS token FROM q), fx AS (SELECT file_no, unnest(fa) AS token FROM f),
met AS (SELECT row_id, file_no, count(*) AS c FROM qx JOIN fx USING (token) GROUP BY 1, 2),
s AS (SELECT row_id, file_no, len(list_intersect(qt, ft)) / len(qt) AS it, c / len(qt) AS an, len(list_intersect(qa, fa)) > 0 AS art, len(qt) AS n FROM met JOIN q USING (row_id) JOIN f USING (file_no)),
sc AS (SELECT row_id, file_no, round(CASE WHEN it >= 0.999 THEN CASE WHEN art THEN 0.95 WHEN n >= 3 THEN 0.9 ELSE 0.45 END ELSE CASE WHEN art THEN greatest(it, an * 0.85) * 0.7 + 0.2 ELSE greatest(it, an * 0.85) * 0.7 * 0.5 END END, 6) AS score FROM s),
best AS (SELECT row_id, file_no, score FROM sc QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, file_no) = 1)
"""


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "playlist_tracks").select("row_id", text.tokens(F.col("name"), 2).alias("t"), text.tokens(F.array_join("artists", " "), 2).alias("a"))
    return linkage.best_match(q, "row_id", "t", "a", table(spark, sf_dir, "file_entries").select("file_no", "all_tokens", "title_tokens"), "file_no", "all_tokens", "title_tokens")


@query(f"WITH {_MATCH} SELECT * FROM best WHERE score >= 0.62")
def fuzzy_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best file of each playlist row by words of title and artist."""
    return _best(spark, sf_dir)


@query(f"WITH {_MATCH} SELECT p.row_id, coalesce(b.score >= 0.62, false) AS present FROM playlist_tracks p LEFT JOIN best b USING (row_id)")
def present_missing_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlist rows that the library holds, and those it lacks."""
    rows = table(spark, sf_dir, "playlist_tracks").select("row_id")
    return rows.join(_best(spark, sf_dir), "row_id", "left").select("row_id", F.col("score").isNotNull().alias("present"))


@query("""
WITH m AS (SELECT file_no, list_distinct(title_tokens) AS t FROM file_entries WHERE extension = 'mp3' AND len(title_tokens) > 0),
p AS (SELECT file_no AS other, list_distinct(all_tokens) AS t FROM file_entries WHERE extension <> 'mp3'),
mx AS (SELECT file_no, len(t) AS n, unnest(t) AS w FROM m), px AS (SELECT other, unnest(t) AS w FROM p)
SELECT DISTINCT file_no FROM (SELECT file_no, other, any_value(n) AS n, count(*) AS c FROM mx JOIN px USING (w) GROUP BY 1, 2) WHERE c = n
""")
def prune_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one format whose title words all stand in a file of another format."""
    files = table(spark, sf_dir, "file_entries")
    marked = files.where("extension = 'mp3'").select("file_no", "title_tokens")
    plain = files.where("extension <> 'mp3'").select(F.col("file_no").alias("other"), "all_tokens")
    return linkage.superseded(marked, "file_no", "title_tokens", plain, "other", "all_tokens")


# fixed values: words that say nothing about a recording; pairs that name the same cut
STOP = ("the", "a", "an", "of", "and", "feat", "featuring", "ft", "with", "original", "mix", "mixed", "extended", "version", "radio", "edit", "rework", "dub", "vip", "instrumental", "club")
SAME_CUT = (("original", "extended"), ("mix", "version", "edit", "cut"))


def _best_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = F.split(F.coalesce("name", F.lit("")), r"\s-\s|[()\[\]]")
    said = F.filter(F.transform(segments, lambda x: text.tokens(x, 1, STOP)), lambda x: F.array_contains(x, "remix"))
    remixer = F.array_except(F.flatten(said), F.array(F.lit("remix")))
    q = table(spark, sf_dir, "playlist_tracks").select("row_id", text.tokens(F.col("name"), 1, STOP).alias("t"), text.tokens(F.coalesce(F.array_join("artists", " "), F.lit("")), 1, STOP).alias("a"), remixer.alias("r"))
    skip = F.array(*[F.lit(w) for w in STOP])
    none = F.array().cast("array<string>")
    f = table(spark, sf_dir, "file_entries").select("file_no", *[F.array_except(F.coalesce(c, none), skip).alias(c) for c in ("all_tokens", "title_tokens")])
    return linkage.best_cut(q, "row_id", "t", "a", "r", f, "file_no", "all_tokens", "title_tokens")


@query()
def fuzzy_best_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best file of each playlist row by core words of the title and by artist, remixes apart."""
    return _best_cut(spark, sf_dir)


@query()
def present_cut_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlist rows of which the library holds the same cut, and those it lacks."""
    rows = table(spark, sf_dir, "playlist_tracks").select("row_id")
    return rows.join(_best_cut(spark, sf_dir), "row_id", "left").select("row_id", F.col("score").isNotNull().alias("present"))


@query()
def prune_superseded_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one format whose cut stands in a file of another format, of the same title and artists."""
    files = table(spark, sf_dir, "file_entries")
    plain = files.where("extension <> 'mp3'").select(F.col("file_no").alias("other"), "title_tokens", "all_tokens")
    return linkage.superseded_cut(files.where("extension = 'mp3'"), "file_no", plain, "other", "title_tokens", "all_tokens", SAME_CUT)


@query("""
WITH g AS (SELECT genre_id, list_distinct(string_split(lower(genre), ' ')) AS t FROM genre_reference)
SELECT k.category_no, g.genre_id, CAST(count(*) AS BIGINT) AS common, round(count(*) / any_value(k.n), 6) AS coverage
FROM (SELECT category_no, len(list_distinct(string_split(lower(label), ' '))) AS n, unnest(list_distinct(string_split(lower(label), ' '))) AS w FROM dj_taxonomy_category) k
JOIN (SELECT genre_id, unnest(t) AS w FROM g) g ON g.w = k.w GROUP BY 1, 2
""")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres that share a word with a category's label, with the share of the label covered."""
    cats = table(spark, sf_dir, "dj_taxonomy_category").select("category_no", F.split(F.lower("label"), " ").alias("t"))
    genres = table(spark, sf_dir, "genre_reference").select("genre_id", F.split(F.lower("genre"), " ").alias("t"))
    return linkage.token_matches(cats, "category_no", "t", genres, "genre_id", "t").withColumn("coverage", F.round("coverage", 6))


@query("""
WITH t AS (SELECT track_id, lower(title_canonical) AS k, duration_sec_canonical AS d FROM tracks_master WHERE duration_sec_canonical > 0),
p AS (SELECT row_id, lower(trim(name)) AS k, duration_sec AS d FROM playlist_tracks WHERE duration_sec > 0)
SELECT p.row_id, arg_min(t.track_id, {'g': round(abs(p.d - t.d), 6), 'i': t.track_id}) AS track_id, min(round(abs(p.d - t.d), 6)) AS gap FROM p JOIN t ON p.k = t.k AND abs(p.d - t.d) <= 20 GROUP BY 1
""")
def duration_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track of the same title whose duration is nearest, within a tolerance."""
    tracks = table(spark, sf_dir, "tracks_master").where("duration_sec_canonical > 0").select("track_id", F.lower("title_canonical").alias("k"), "duration_sec_canonical")
    rows = table(spark, sf_dir, "playlist_tracks").where("duration_sec > 0").select("row_id", F.lower(F.trim("name")).alias("k"), "duration_sec")
    return linkage.closest(rows, "row_id", "k", "duration_sec", tracks, "track_id", "k", "duration_sec_canonical", 20.0)


@query("""
SELECT row_id, uri, added_at FROM playlist_tracks WHERE uri IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uri ORDER BY added_at DESC NULLS LAST, row_id) = 1
""")
def dedupe_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest playlist row of each uri."""
    rows = table(spark, sf_dir, "playlist_tracks").where("uri is not null").select("row_id", "uri", "added_at")
    return linkage.first_by(rows, ["uri"], F.col("added_at").desc_nulls_last(), F.col("row_id"))


_WHEEL = "CASE WHEN regexp_full_match(canonical_key_camelot, '(1[0-2]|[1-9])[AB]') THEN (CAST(regexp_extract(canonical_key_camelot, '^[0-9]+') AS INTEGER) - 1) * 2 + CASE WHEN right(canonical_key_camelot, 1) = 'B' THEN 1 ELSE 0 END END"


@query(f"""
WITH t AS (SELECT track_id, canonical_genre, TRY_CAST(canonical_bpm AS DOUBLE) AS b, {_WHEEL} AS p FROM tracks_master WHERE canonical_genre <> '')
SELECT canonical_genre AS playlist, CAST(row_number() OVER (PARTITION BY canonical_genre ORDER BY CASE WHEN b > 0 THEN b END NULLS LAST, p NULLS LAST, track_id) AS INTEGER) AS place, track_id FROM t
""")
def playlist_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of each genre by tempo, then place on the wheel, unknown ones last."""
    t = table(spark, sf_dir, "tracks_master").where("canonical_genre <> ''")
    bpm = music.tempo(F.col("canonical_bpm"), 0.0001, 1e9)
    w = Window.partitionBy("canonical_genre").orderBy(bpm.asc_nulls_last(), music.wheel_position(F.col("canonical_key_camelot")).asc_nulls_last(), "track_id")
    return t.select(F.col("canonical_genre").alias("playlist"), F.row_number().over(w).alias("place"), "track_id")


@query("""
WITH t AS (SELECT TRY_CAST(canonical_bpm AS DOUBLE) AS b, canonical_key_camelot AS k FROM tracks_master),
x AS (SELECT CASE WHEN b >= 180 THEN '180+' WHEN b >= 160 THEN '160-180' WHEN b >= 146 THEN '146-160' WHEN b >= 135 THEN '135-146' WHEN b >= 128 THEN '128-135' WHEN b >= 122 THEN '122-128' WHEN b >= 115 THEN '115-122' WHEN b >= 105 THEN '105-115' WHEN b >= 90 THEN '090-105' WHEN b >= 0 THEN '000-090' END AS bpm_bucket,
  CASE WHEN regexp_full_match(k, '(1[0-2]|[1-9])[AB]') THEN printf('%02d-%02d%s', (CAST(regexp_extract(k, '^[0-9]+') AS INTEGER) - 1) // 2 * 2 + 1, (CAST(regexp_extract(k, '^[0-9]+') AS INTEGER) - 1) // 2 * 2 + 2, right(k, 1)) END AS key_bucket FROM t)
SELECT bpm_bucket, key_bucket, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1, 2
""")
def coarse_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks counted by tempo bucket and key bucket."""
    t = table(spark, sf_dir, "tracks_master")
    return t.select(music.tempo_bucket(music.tempo(F.col("canonical_bpm"), 0, 1e9)).alias("bpm_bucket"), music.key_bucket(F.col("canonical_key_camelot")).alias("key_bucket")).groupBy("bpm_bucket", "key_bucket").agg(F.count("*").alias("n"))


@query("""
WITH h AS (SELECT DISTINCT trim(string_split(canonical_genre, '/')[1]) AS head FROM tracks_master WHERE trim(canonical_genre) <> ''),
f AS (SELECT string_split(head, ' ')[1] AS fam FROM h GROUP BY 1 HAVING count(*) >= 2)
SELECT t.track_id, CASE WHEN f.fam IS NOT NULL THEN f.fam ELSE trim(string_split(t.canonical_genre, '/')[1]) END AS bucket
FROM tracks_master t LEFT JOIN f ON string_split(trim(string_split(t.canonical_genre, '/')[1]), ' ')[1] = f.fam WHERE trim(t.canonical_genre) <> ''
""")
def genre_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres collapsed to their first word where at least two of them share it."""
    t = table(spark, sf_dir, "tracks_master").where(F.trim("canonical_genre") != "").select("track_id", F.trim(F.split("canonical_genre", "/")[0]).alias("head"))
    t = t.withColumn("fam", F.split("head", " ")[0])
    shared = t.select("head", "fam").distinct().groupBy("fam").agg(F.count("*").alias("n")).where("n >= 2").select("fam", F.lit(True).alias("shared"))
    return t.join(shared, "fam", "left").select("track_id", F.when(F.col("shared"), F.col("fam")).otherwise(F.col("head")).alias("bucket"))


@query("""
WITH x AS (SELECT file_no, list_distinct(all_tokens) AS a, list_distinct(title_tokens) AS b, lag(list_distinct(all_tokens)) OVER (PARTITION BY extension ORDER BY file_no) AS c FROM file_entries)
SELECT file_no, CAST(len(list_intersect(a, b)) AS INTEGER) AS both_sets, CAST(len(list_filter(a, lambda w: NOT list_contains(b, w))) AS INTEGER) AS only_all, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS either,
  CAST(len(list_intersect(a, c)) AS INTEGER) AS with_before FROM x WHERE c IS NOT NULL
""")
def set_ops_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union of token sets, and the overlap with the file before."""
    a, b = F.array_distinct("all_tokens"), F.array_distinct("title_tokens")
    w = Window.partitionBy("extension").orderBy("file_no")
    x = table(spark, sf_dir, "file_entries").select("file_no", a.alias("a"), b.alias("b"), F.lag(a).over(w).alias("c")).where("c is not null")
    return x.select(
        "file_no", F.size(F.array_intersect("a", "b")).alias("both_sets"), F.size(F.array_except("a", "b")).alias("only_all"), F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_intersect("a", "c")).alias("with_before")
    )


@query("""
SELECT playlist, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(duration_sec AS DECIMAL(18,6))) AS DOUBLE) AS total_sec, string_agg(DISTINCT label, '|' ORDER BY label) AS labels FROM (
  SELECT playlist, CASE WHEN duration_sec > 10000 THEN duration_sec / 1000 ELSE duration_sec END AS duration_sec, label FROM playlist_tracks WHERE trim(label) <> '') GROUP BY 1
""")
def playlist_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, total duration and labels of each playlist; milliseconds are read as such."""
    p = table(spark, sf_dir, "playlist_tracks").where(F.trim("label") != "")
    d = F.when(F.col("duration_sec") > 10000, F.col("duration_sec") / 1000).otherwise(F.col("duration_sec"))
    return p.groupBy("playlist").agg(F.count("*").alias("n"), F.sum(d.cast("decimal(18,6)")).cast("double").alias("total_sec"), F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"))


@query("""
(SELECT track_id, 'only_master' AS side FROM tracks_master WHERE track_id NOT IN (SELECT track_id FROM source_observations WHERE track_id IS NOT NULL))
UNION ALL (SELECT DISTINCT track_id, 'only_observed' FROM source_observations WHERE track_id IS NOT NULL AND track_id NOT IN (SELECT track_id FROM tracks_master))
""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks known on one side only."""
    m = table(spark, sf_dir, "tracks_master").select("track_id")
    o = table(spark, sf_dir, "source_observations").where("track_id is not null").select("track_id").distinct()
    return m.join(o, "track_id", "left_anti").withColumn("side", F.lit("only_master")).unionByName(o.join(m, "track_id", "left_anti").withColumn("side", F.lit("only_observed")))
