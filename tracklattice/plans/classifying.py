"""Queries of taxonomy, metric, model, source and streaming operators."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklattice.functions import text
from tracklattice.operators import metrics, resolve, taxonomy
from tracklattice.plans.registry import query
from tracklattice.session import shared_dir, table
from tracklattice.sources import cells, collection, playlists
from tracklattice.streaming import ingest

_W = "CAST(CASE lower(trim(source_system)) WHEN 'manual' THEN 1.0 WHEN 'analysis_essentia' THEN 0.85 WHEN 'analysis_librosa' THEN 0.8 WHEN 'rekordbox' THEN 0.75 WHEN 'tag' THEN 0.55 WHEN 'songstats' THEN 0.4 ELSE 0.5 END AS DECIMAL(4,2))"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.create_map(*[F.lit(x) for k, v in resolve.WEIGHTS.items() for x in (k, f"{v:.2f}")])
    obs = table(spark, sf_dir, "source_observations").where("track_id is not null and trim(genre) <> ''")
    o = obs.select("track_id", F.col("genre"), F.coalesce(weights[resolve.source(F.col("source_system"))], F.lit("0.50")).cast("decimal(4,2)").alias("w"))
    ref = table(spark, sf_dir, "genre_reference").select("genre", "family")
    return o.join(F.broadcast(ref), "genre")  # the reference list is fixed


_SEL = f"""
ev AS (SELECT o.track_id, g.family, o.genre, {_W} AS w FROM source_observations o JOIN genre_reference g ON o.genre = g.genre WHERE o.track_id IS NOT NULL),
gs AS (SELECT track_id, family, genre, sum(w) AS gsc FROM ev GROUP BY 1, 2, 3), fs AS (SELECT track_id, family, sum(gsc * 0.30) AS fsc FROM gs GROUP BY 1, 2),
t AS (SELECT gs.track_id, gs.family, round(CAST(any_value(fsc) AS DOUBLE) + CAST(max(gsc) AS DOUBLE) * 0.22, 6) AS total, arg_min(genre, {{'s': -gsc, 'g': genre}}) AS bg FROM gs JOIN fs USING (track_id, family) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS place, lead(total) OVER w AS next FROM t WINDOW w AS (PARTITION BY track_id ORDER BY total DESC, family)),
sel AS (SELECT track_id, CASE WHEN total >= 0.25 THEN family ELSE 'unclassified' END AS family, CASE WHEN total >= 0.25 THEN bg END AS genre, total AS score, round(total - coalesce(next, 0), 6) AS margin,
  coalesce(total >= 0.75 AND next >= 0.60 AND total - next < 0.22, false) AS warning FROM r WHERE place = 1)
"""


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.selection(taxonomy.level_scores(_evidence(spark, sf_dir), "track_id", "family", "genre", "w"), "track_id", "family", "genre")


@query(f"WITH {_SEL} SELECT * FROM sel")
def taxonomy_rollup_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of all sources added up by family and genre, the best chosen with a margin."""
    return _selected(spark, sf_dir)


_WORDS = "list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f"""
WITH l AS (SELECT genre_id, {_WORDS.format(c='genre')} AS w FROM genre_reference), k AS (SELECT genre_id, array_to_string(w, ' ') AS phrase FROM l WHERE len(w) BETWEEN 1 AND 4),
d AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n))
SELECT doc_id, genre_id, CAST(count(*) AS BIGINT) AS hits FROM p JOIN k USING (phrase) GROUP BY 1, 2
""")
def taxonomy_phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres named in documents, by phrase."""
    return taxonomy.phrase_hits(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "genre_reference"), "genre_id", "genre")


@query(f"""
WITH d AS (SELECT {_WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL AND lang = 'en'),
g AS (SELECT list_slice(w, i, i + 1) AS p FROM (SELECT w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) >= 2))
SELECT p[1] || ' ' || p[2] AS gram, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1
""")
def text_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pairs of the English documents, counted."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    d = table(spark, sf_dir, "documents").where("text is not null and lang = 'en'").select(words.alias("w"))
    return d.select(F.explode(text.ngrams(F.col("w"), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query()
def text_ngrams_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pairs of all documents, counted, whatever their label and script; text_ngrams and its SQL hold those labelled "en" letter for letter."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    d = table(spark, sf_dir, "documents").where("text is not null").select(words.alias("w"))
    return d.select(F.explode(text.ngrams(F.col("w"), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


_PLAIN = "list_filter(string_split_regex(regexp_replace(translate(lower({c}), 'áàâäãåāéèêëēíìîïīóòôöõøōúùûüūýÿñçšž', 'aaaaaaaeeeeeiiiiiooooooouuuuuyyncsz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 2)"
_FIRST = "list_filter(list_transform({w}, lambda x, i: CASE WHEN list_position({w}, x) = i THEN x END), lambda x: x IS NOT NULL)"


@query(f"""
WITH c AS (SELECT track_id, unnest([artist_canonical, title_canonical, label_canonical]) AS said FROM tracks_master), w AS (SELECT track_id, {_PLAIN.format(c='said')} AS raw FROM c WHERE said IS NOT NULL),
d AS (SELECT track_id, {_FIRST.format(w='raw')} AS w FROM w), k AS (SELECT track_id, unnest(w) AS feature FROM d UNION SELECT track_id, w[i] || ' ' || w[i + 1] FROM (SELECT track_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) >= 2)),
n AS (SELECT track_id, '=duration_sec_canonical' AS feature, CAST(duration_sec_canonical AS DOUBLE) AS value FROM tracks_master WHERE duration_sec_canonical IS NOT NULL UNION ALL SELECT track_id, '=linked_file_count', CAST(linked_file_count AS DOUBLE) FROM tracks_master WHERE linked_file_count IS NOT NULL)
SELECT track_id, feature, 1.0::DOUBLE AS value FROM k UNION ALL SELECT * FROM n
""")
def feature_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse features of the tracks, one row an entry of their maps."""
    t = table(spark, sf_dir, "tracks_master")
    maps = taxonomy.feature_map(t, "track_id", ["artist_canonical", "title_canonical", "label_canonical"], ["duration_sec_canonical", "linked_file_count"])
    return maps.select("track_id", F.explode("features").alias("feature", "value"))


_PAIRS = f"{_SEL}, pr AS (SELECT t.track_id, g.family AS truth, sel.family AS predicted, score, margin FROM tracks_master t JOIN genre_reference g ON t.canonical_genre = g.genre LEFT JOIN sel USING (track_id))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "tracks_master").select("track_id", F.col("canonical_genre").alias("genre"))
    ref = table(spark, sf_dir, "genre_reference").select("genre", F.col("family").alias("truth"))
    return truth.join(F.broadcast(ref), "genre").select("track_id", "truth").join(_selected(spark, sf_dir).select("track_id", F.col("family").alias("predicted"), "score", "margin"), "track_id", "left")


@query(f"""
WITH {_PAIRS}, tt AS (SELECT truth AS label, count(*) AS support, sum(CASE WHEN truth = coalesce(predicted, '') THEN 1 ELSE 0 END) AS hits FROM pr GROUP BY 1), p AS (SELECT predicted AS label, count(*) AS n_predicted FROM pr WHERE predicted IS NOT NULL GROUP BY 1),
b AS (SELECT coalesce(tt.label, p.label) AS label, coalesce(support, 0) AS support, coalesce(n_predicted, 0) AS n_predicted, coalesce(hits, 0) AS hits FROM tt FULL JOIN p ON tt.label = p.label),
m AS (SELECT *, CASE WHEN n_predicted > 0 THEN hits / n_predicted ELSE 0.0 END AS pre, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS rec FROM b)
SELECT label, CAST(support AS BIGINT) AS support, CAST(n_predicted AS BIGINT) AS n_predicted, CAST(hits AS BIGINT) AS hits, round(pre, 6) AS precision, round(rec, 6) AS recall, round(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0.0 END, 6) AS f1 FROM m
""")
def f1_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each family."""
    return metrics.per_class(_pairs(spark, sf_dir), "truth", "predicted")


@query(f"""
WITH {_PAIRS}, k AS (SELECT unnest([0.0, 0.35, 0.55, 0.70]) AS low, unnest([0.35, 0.55, 0.70, 1.01]) AS high),
c AS (SELECT CASE WHEN x >= 0 AND x < 0.35 THEN 0.0 WHEN x >= 0.35 AND x < 0.55 THEN 0.35 WHEN x >= 0.55 AND x < 0.7 THEN 0.55 WHEN x >= 0.7 AND x < 1.01 THEN 0.7 END AS low, CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END AS h FROM (SELECT *, margin / greatest(score, 1) AS x FROM pr))
SELECT CAST(k.low AS DOUBLE) AS low, CAST(k.high AS DOUBLE) AS high, CAST(count(c.h) AS BIGINT) AS n, round(avg(CAST(c.h AS DOUBLE)), 6) AS accuracy FROM k LEFT JOIN c ON k.low = c.low GROUP BY 1, 2
""")
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by confidence bucket."""
    p = _pairs(spark, sf_dir).withColumn("x", F.col("margin") / F.greatest("score", F.lit(1.0)))
    return metrics.confidence_buckets(p, "x", F.col("truth") == F.col("predicted"))


@query(f"WITH {_SEL}, c AS (SELECT family, count(*) AS n FROM sel GROUP BY 1) SELECT family, n, round(n / (SELECT sum(n) FROM c), 6) AS share, n / (SELECT sum(n) FROM c) > 0.2 AS over_cap FROM c")
def distribution_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the predicted families, those over a fifth marked."""
    return metrics.distribution(_selected(spark, sf_dir), "family")


@query(f"""
WITH {_SEL}, f AS (SELECT gs.track_id, gs.family, round(CAST(any_value(fsc) AS DOUBLE) + CAST(max(gsc) AS DOUBLE) * 0.22, 6) AS total FROM gs JOIN fs USING (track_id, family) GROUP BY 1, 2),
o AS (SELECT track_id, list(family ORDER BY total DESC, family) AS ranked FROM f GROUP BY 1), p AS (SELECT g.family AS truth, o.ranked, sel.margin FROM tracks_master t JOIN genre_reference g ON t.canonical_genre = g.genre JOIN o USING (track_id) JOIN sel USING (track_id))
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN ranked[1] = truth THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN list_contains(list_slice(ranked, 1, 3), truth) THEN 1.0 ELSE 0.0 END), 6) AS top3, round(avg(margin), 5) AS mean_margin FROM p
""")
def accuracy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-1 and top-3 accuracy of the family ranking."""
    s = taxonomy.level_scores(_evidence(spark, sf_dir), "track_id", "family", "genre", "w")
    f = s.groupBy("track_id", "family").agg(F.round(F.max("family_score").cast("double") + F.max("genre_score").cast("double") * 0.22, 6).alias("total"))
    ranked = f.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("t"), "family"))), lambda x: x["family"]).alias("ranked"))  # families of one track
    truth = _pairs(spark, sf_dir).select("track_id", "truth", "margin").join(ranked, "track_id")
    return metrics.accuracy(truth, "truth", "ranked", "margin").withColumnRenamed("mean_confidence", "mean_margin").withColumn("mean_margin", F.round("mean_margin", 5))


@query("SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.25), 5) AS p25, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.75), 5) AS p75, round(max(value), 5) AS top FROM events GROUP BY 1")
def audit_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and quartiles of a score by label."""
    return metrics.audit(table(spark, sf_dir, "events"), "event_type", "value")


@query("""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (trim(canonical_key_camelot) <> '') AS k, count(*) FILTER (trim(canonical_bpm) <> '') AS b, count(*) FILTER (trim(isrc_canonical) <> '') AS i, count(*) FILTER (trim(primary_file_id) <> '') AS p FROM tracks_master)
SELECT unnest(['canonical_key_camelot', 'canonical_bpm', 'isrc_canonical', 'primary_file_id']) AS layer, unnest([k, b, i, p]) AS filled, unnest([round(k / n, 6), round(b / n, 6), round(i / n, 6), round(p / n, 6)]) AS share FROM c
""")
def layer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tracks have each layer filled."""
    return metrics.coverage(table(spark, sf_dir, "tracks_master"), "track_id", ["canonical_key_camelot", "canonical_bpm", "isrc_canonical", "primary_file_id"])


@query(f"""
WITH {_SEL}, f AS (SELECT gs.track_id, gs.family, round(CAST(any_value(fsc) AS DOUBLE) + CAST(max(gsc) AS DOUBLE) * 0.22, 6) AS total FROM gs JOIN fs USING (track_id, family) GROUP BY 1, 2),
k AS (SELECT f.*, g.family AS truth, row_number() OVER (PARTITION BY track_id ORDER BY total DESC, f.family) AS rnk FROM f JOIN tracks_master t USING (track_id) JOIN genre_reference g ON t.canonical_genre = g.genre)
SELECT track_id, CAST(max(CASE WHEN family = truth THEN rnk END) AS INTEGER) AS rank, CAST(count(*) AS BIGINT) AS of FROM k GROUP BY 1
""")
def eval_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the true family among the scored ones."""
    s = taxonomy.level_scores(_evidence(spark, sf_dir), "track_id", "family", "genre", "w")
    f = s.groupBy("track_id", "family").agg(F.round(F.max("family_score").cast("double") + F.max("genre_score").cast("double") * 0.22, 6).alias("total"))
    scored = f.join(_pairs(spark, sf_dir).select("track_id", "truth"), "track_id")
    return metrics.target_ranks(scored, "track_id", "family", "total", "truth")


@query()
def classify_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family of a track by a multinomial logistic model over hashed words of its observations, trained on tracks of four in five artists.

    Tracks of the artists left out are predicted, so no artist is on both sides; under 0.35 the label is unclassified.
    """
    ref = table(spark, sf_dir, "genre_reference").select("genre", "family")
    tracks = table(spark, sf_dir, "tracks_master").select("track_id", "artist_canonical", F.col("canonical_genre").alias("genre")).join(F.broadcast(ref), "genre")
    words = table(spark, sf_dir, "source_observations").where("track_id is not null").groupBy("track_id").agg(F.collect_set(F.lower("genre")).alias("gs"))  # genres of one track
    rows = tracks.join(words, "track_id").withColumn("words", F.filter(F.split(F.array_join("gs", " "), " "), lambda w: w != ""))
    names = [r["family"] for r in ref.select("family").distinct().orderBy("family").collect()]  # the families of the fixed list
    code = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, float(i))])
    hashed = HashingTF(numFeatures=512, inputCol="words", outputCol="features").transform(rows).withColumn("label", code[F.col("family")])
    held_out = F.pmod(F.xxhash64("artist_canonical"), F.lit(5)) == 0
    model = LogisticRegression(maxIter=30, regParam=0.01).fit(hashed.where(~held_out))
    p = model.transform(hashed.where(held_out)).withColumn("p", F.array_max(vector_to_array("probability")))
    labels = F.array(*[F.lit(n) for n in names])
    return p.select("track_id", F.col("family").alias("truth"), F.when(F.col("p") >= 0.35, F.get(labels, F.col("prediction").cast("int"))).otherwise("unclassified").alias("predicted"), F.round("p", 4).alias("confidence"))


@query("""
SELECT playlist, CAST(row_number() OVER (PARTITION BY playlist ORDER BY row_id) AS INTEGER) AS place, '#EXTINF:' || CAST(floor(coalesce(CASE WHEN duration_sec > 10000 THEN duration_sec / 1000 ELSE duration_sec END, -1)) AS BIGINT) || ',' || name || chr(10) || uri AS line
FROM playlist_tracks WHERE name IS NOT NULL AND uri IS NOT NULL
""")
def playlist_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of playlist files in order."""
    d = F.coalesce(F.when(F.col("duration_sec") > 10000, F.col("duration_sec") / 1000).otherwise(F.col("duration_sec")), F.lit(-1.0))
    return playlists.m3u_lines(table(spark, sf_dir, "playlist_tracks"), "playlist", "row_id", F.floor(d), F.col("name"), F.col("uri"))


@query("SELECT track_id, artist_canonical, title_canonical, duration_sec_canonical, linked_file_count, needs_manual_review FROM tracks_master")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks written as text cells and read back into types."""
    t = table(spark, sf_dir, "tracks_master").select("track_id", "artist_canonical", "title_canonical", "duration_sec_canonical", "linked_file_count", "needs_manual_review")
    path = cells.write(t, f"{shared_dir(spark)}/csv")
    return cells.scan(spark, path, t.schema)


@query("""
SELECT track_id AS ref, artist_canonical AS artist, title_canonical AS title, duration_sec_canonical AS total_time FROM tracks_master WHERE duration_sec_canonical >= 30
""")
def xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks written as an XML collection and scanned again; short ones are dropped by the scan."""
    t = table(spark, sf_dir, "tracks_master")
    path = collection.write(t.select("track_id", "artist_canonical", "title_canonical", "duration_sec_canonical"), f"{shared_dir(spark)}/xml")
    return collection.scan(spark, path).select(F.col("ref"), "artist", "title", "total_time")


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2
""")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of an event stream, run to its end."""
    return ingest.hourly_counts(spark, f"{sf_dir}/events.parquet")


@query("""
SELECT observation_id, track_id, ingested_at FROM source_observations WHERE observation_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY ingested_at DESC, coalesce(observed_at, '') DESC) = 1
""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations taken in as a stream of micro-batches, the last delivery of each kept."""
    return ingest.ingested_observations(spark, f"{sf_dir}/source_observations.parquet").select("observation_id", "track_id", "ingested_at")


@query("""
SELECT row_id, p_rank FROM (SELECT row_id, CAST(row_number() OVER (PARTITION BY label ORDER BY year DESC, row_id) AS INTEGER) AS p_rank FROM (
  SELECT row_id, label, CASE WHEN regexp_matches(year, '^[0-9]{4}') THEN CAST(substr(year, 1, 4) AS INTEGER) ELSE 0 END AS year FROM playlist_tracks WHERE trim(label) <> '')) WHERE p_rank <= 3
""")
def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three latest rows of each label."""
    p = table(spark, sf_dir, "playlist_tracks").where(F.trim("label") != "").select("row_id", "label", F.coalesce(text.year_of(F.col("year")), F.lit(0)).alias("y"))
    w = Window.partitionBy("label").orderBy(F.desc("y"), "row_id")
    return p.withColumn("p_rank", F.row_number().over(w)).where("p_rank <= 3").select("row_id", "p_rank")
