"""Queries of vector, cluster and recommendation operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklattice.functions import music, vectors
from tracklattice.operators import clusters, recommend, search
from tracklattice.plans.registry import query
from tracklattice.session import table

_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_U = f"{_E}, u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e)"


@query(f"""
WITH {_E}, s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_cosine_similarity(q.v, r.v), 6) AS score FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS place FROM s QUALIFY place <= 10
""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten most similar vectors for the query set (every id divisible by 20), against all rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return search.block_topk(q, e, "query_id", "vec_id", 10, search.cosine_scores("embedding"))


@query(f"""
WITH {_U}, d AS (SELECT a.label, a.vec_id, round(sum(1 - list_dot_product(a.v, b.v)), 6) AS s FROM u a JOIN u b USING (label) GROUP BY 1, 2)
SELECT label, vec_id AS medoid, s AS distance_sum FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY s, vec_id) = 1
""")
def medoids_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member of each label with the least sum of distances."""
    return clusters.medoids(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 64)


_MED = f"""
{_U}, d AS (SELECT a.label, a.vec_id, round(sum(1 - list_dot_product(a.v, b.v)), 6) AS s FROM u a JOIN u b USING (label) GROUP BY 1, 2),
m AS (SELECT label, vec_id FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY s, vec_id) = 1),
near AS (SELECT u.vec_id, u.label AS truth, x.label, round(1 - list_dot_product(u.v, mv.v), 9) AS dist FROM u, m x JOIN u mv ON mv.vec_id = x.vec_id),
best AS (SELECT vec_id, truth, label, dist FROM near QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) = 1)
"""


def _assigned(spark: SparkSession, sf_dir: str, limit: float = 0.8) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    m = clusters.medoids(e, "label", "vec_id", "embedding", 64)
    medoid_rows = m.select(F.col("label").alias("grp"), F.col("medoid").alias("vec_id")).join(e.select("vec_id", "embedding"), "vec_id")
    return clusters.assign_nearest(e, "vec_id", "embedding", medoid_rows, "grp", limit)


@query(f"WITH {_MED} SELECT vec_id, CASE WHEN dist <= 0.8 THEN label END AS grp, round(dist, 6) AS distance FROM best")
def assign_nearest_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest medoid of each vector, none beyond a limit."""
    return _assigned(spark, sf_dir)


@query(f"""
WITH {_U}, s AS (SELECT label, count(*) AS n FROM u GROUP BY 1), p AS (SELECT a.label AS a, b.label AS b, avg(1 - list_dot_product(a.v, b.v)) AS d FROM u a JOIN u b ON a.label < b.label GROUP BY 1, 2)
SELECT a, b, round(d, 6) AS distance FROM p
""")
def average_linkage_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance over all cross pairs of two labels."""
    c = clusters.centres(table(spark, sf_dir, "embeddings"), "label", "embedding", 64)
    return clusters.group_distances(c, "label").withColumn("distance", F.round("distance", 6))


@query(f"""
WITH {_U}, i AS (SELECT a.vec_id, a.label, sum(1 - list_dot_product(a.v, b.v)) / (count(*) - 1) AS a FROM u a JOIN u b USING (label) GROUP BY 1, 2),
o AS (SELECT a.vec_id, b.label, avg(1 - list_dot_product(a.v, b.v)) AS d FROM u a JOIN u b ON a.label <> b.label GROUP BY 1, 2), m AS (SELECT vec_id, min(d) AS b FROM o GROUP BY 1)
SELECT vec_id, label, round((b - a) / greatest(a, b), 5) AS silhouette FROM i JOIN m USING (vec_id)
""")
def silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette of each vector in its label."""
    return clusters.silhouettes(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 64).withColumn("silhouette", F.round("silhouette", 5))


@query(f"""
WITH {_U}, x AS (SELECT vec_id, v, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS before, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS pv FROM u)
SELECT vec_id, before, round(sqrt(list_sum(list_transform(list_zip(v, pv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / 2, 6) AS half_distance, round(1 - list_dot_product(v, pv), 6) AS cosine_distance FROM x WHERE before IS NOT NULL
""")
def vector_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from each vector to the one before it in its label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    x = table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.unit(F.col("embedding")).alias("u"))
    x = x.select("vec_id", "u", F.lag("vec_id").over(w).alias("before"), F.lag("u").over(w).alias("p")).where("before is not null")
    return x.select("vec_id", "before", F.round(vectors.half_distance(F.col("u"), F.col("p")), 6).alias("half_distance"), F.round(1 - vectors.dot(F.col("u"), F.col("p")), 6).alias("cosine_distance"))


_TAGS = """
t AS (SELECT track_id, canonical_genre AS g, CASE WHEN TRY_CAST(canonical_bpm AS DOUBLE) BETWEEN 40 AND 250 THEN TRY_CAST(canonical_bpm AS DOUBLE) END AS bpm, 1 + linked_file_count % 5 AS en,
  CASE WHEN regexp_full_match(canonical_key_camelot, '(1[0-2]|[1-9])[AB]') THEN CAST(regexp_extract(canonical_key_camelot, '^[0-9]+') AS INTEGER) END AS n, right(canonical_key_camelot, 1) AS side,
  CAST(CASE linked_file_count % 3 WHEN 0 THEN 16 WHEN 1 THEN 32 ELSE 64 END AS INTEGER) AS bars FROM tracks_master)
"""


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("canonical_key_camelot")
    bars = F.when(F.col("linked_file_count") % 3 == 0, 16).when(F.col("linked_file_count") % 3 == 1, 32).otherwise(64)
    return table(spark, sf_dir, "tracks_master").select("track_id", F.col("canonical_genre").alias("g"), music.tempo(F.col("canonical_bpm")).alias("bpm"), (1 + F.col("linked_file_count") % 5).alias("en"), k.alias("key"), bars.alias("bars"))


@query(f"""
WITH {_TAGS}, v AS (SELECT track_id, g, (en - 1) / 4 AS e, least(1.0, greatest(0.0, (coalesce(bpm, 128) - 100) / 40)) AS b, CASE bars WHEN 16 THEN 0.0 WHEN 64 THEN 1.0 ELSE 0.5 END AS w,
  CASE WHEN n IS NULL THEN 0.0 ELSE sin((n - 1 + CASE WHEN side = 'B' THEN 12 ELSE 0 END) * (2 * 3.141592653589793 / 24)) END AS ks, CASE WHEN n IS NULL THEN 0.0 ELSE cos((n - 1 + CASE WHEN side = 'B' THEN 12 ELSE 0 END) * (2 * 3.141592653589793 / 24)) END AS kc FROM t),
p AS (SELECT *, lag(e) OVER x AS e0, lag(b) OVER x AS b0, lag(w) OVER x AS w0, lag(ks) OVER x AS ks0, lag(kc) OVER x AS kc0 FROM v WINDOW x AS (PARTITION BY g ORDER BY track_id))
SELECT track_id, round(0.25 * pow(abs(e - e0), 1.5) + 0.30 * (b - b0) * (b - b0) + 0.10 * least(1.0, sqrt((ks - ks0) * (ks - ks0) + (kc - kc0) * (kc - kc0)) / 2) + 0.05 * abs(w - w0), 9) AS tag_distance FROM p WHERE e0 IS NOT NULL
""")
def tag_distance_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of tag vectors between neighbours in a genre."""
    t = _tags(spark, sf_dir).select("track_id", "g", vectors.tag_vector(F.col("en"), F.col("bpm"), F.col("bars"), F.col("key"), F.lit(1.0)).alias("v"))
    w = Window.partitionBy("g").orderBy("track_id")
    x = t.withColumn("p", F.lag("v").over(w)).where("p is not null")
    d = lambda i: F.col("v")[i] - F.col("p")[i]
    dist = F.pow(F.abs(d(0)), 1.5) * 0.25 + d(1) * d(1) * 0.30 + F.least(F.lit(1.0), F.sqrt(d(3) * d(3) + d(4) * d(4)) / 2) * 0.10 + F.abs(d(2)) * 0.05
    return x.select("track_id", F.round(dist, 9).alias("tag_distance"))


@query("""
WITH c AS (SELECT canonical_genre AS g, canonical_key_camelot AS k, count(*) AS n, min(track_id) AS f FROM tracks_master WHERE trim(canonical_key_camelot) <> '' AND trim(canonical_genre) <> '' GROUP BY 1, 2),
m AS (SELECT g, k FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, f) = 1),
b AS (SELECT canonical_genre AS g, CAST(round_even(median(TRY_CAST(canonical_bpm AS DOUBLE)), 0) AS INTEGER) AS bpm, CAST(count(*) AS BIGINT) AS size FROM tracks_master WHERE trim(canonical_genre) <> '' AND TRY_CAST(canonical_bpm AS DOUBLE) BETWEEN 40 AND 250 GROUP BY 1)
SELECT printf('G%03d', row_number() OVER (ORDER BY g)) AS group_id, g AS genre, k AS key, bpm, size FROM b JOIN m USING (g)
""")
def group_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent key (first seen on ties) and median tempo of each genre, numbered in order."""
    t = table(spark, sf_dir, "tracks_master").where(F.trim("canonical_genre") != "").select("track_id", F.col("canonical_genre").alias("genre"), F.col("canonical_key_camelot").alias("key"), music.tempo(F.col("canonical_bpm")).alias("bpm"))
    mode = clusters.first_seen_mode(t, "genre", "key", F.col("track_id"))
    rest = t.where("bpm is not null").groupBy("genre").agg(F.bround(F.median("bpm")).cast("int").alias("bpm"), F.count("*").alias("size"))
    number = F.format_string("G%03d", F.row_number().over(Window.orderBy("genre")))  # one row a genre
    return rest.join(mode, "genre").select(number.alias("group_id"), "genre", "key", "bpm", "size")


@query(f"""
WITH {_U}, p AS (SELECT a.label AS a, b.label AS b, round(avg(1 - list_dot_product(a.v, b.v)), 9) AS d FROM u a JOIN u b ON a.label < b.label GROUP BY 1, 2), m AS (SELECT a, b FROM p ORDER BY d, a, b LIMIT 1)
SELECT l.label, CASE WHEN l.label = m.b THEN m.a ELSE l.label END AS merged FROM (SELECT DISTINCT label FROM embeddings) l, m
""")
def coarse_merge_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest labels merged."""
    c = clusters.centres(table(spark, sf_dir, "embeddings"), "label", "embedding", 64)
    label = clusters.merged_groups(c, "label", c.count() - 1)
    return spark.createDataFrame(pd.DataFrame({"label": list(label), "merged": list(label.values())}).astype("int32"))


def _merge_steps(steps: int) -> str:
    ctes = ["p0 AS (SELECT a, b, d FROM p)"]
    for i in range(steps):
        ctes.append(f"m{i} AS (SELECT a, b FROM p{i} ORDER BY d, a, b LIMIT 1), p{i + 1} AS (SELECT * FROM p{i} WHERE a NOT IN (SELECT b FROM m{i}) AND b NOT IN (SELECT b FROM m{i}))")
    out = "label"
    for i in range(steps):
        out = f"(CASE WHEN {out} = (SELECT b FROM m{i}) THEN (SELECT a FROM m{i}) ELSE {out} END)"
    return ", ".join(ctes) + f" SELECT label, {out} AS merged FROM (SELECT DISTINCT label FROM embeddings)"


@query(f"""
WITH {_U}, p AS (SELECT a.label AS a, b.label AS b, round(avg(1 - list_dot_product(a.v, b.v)), 9) AS d FROM u a JOIN u b ON a.label < b.label GROUP BY 1, 2), {_merge_steps(5)}
""")
def coarse_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels merged two by two until half of the ten remain."""
    c = clusters.centres(table(spark, sf_dir, "embeddings"), "label", "embedding", 64)
    label = clusters.merged_groups(c, "label")
    return spark.createDataFrame(pd.DataFrame({"label": list(label), "merged": list(label.values())}).astype("int32"))


@query(f"""
WITH {_TAGS}, r AS (SELECT *, round_even(bpm, 0) AS b FROM t), c AS (SELECT n, CASE WHEN n IS NULL THEN NULL ELSE side END AS side, b, count(*) AS cnt FROM r GROUP BY 1, 2, 3),
x AS (SELECT a.n, a.side, a.b, sum(CASE WHEN coalesce(least(abs(a.n - o.n), 12 - abs(a.n - o.n)) + CASE WHEN a.side <> o.side THEN 1 ELSE 0 END, 0) > 2 OR coalesce(abs(a.b - o.b) / ((a.b + o.b) / 2) > 0.07, false) THEN o.cnt ELSE 0 END) AS hard,
  sum(CASE WHEN least(abs(a.n - o.n), 12 - abs(a.n - o.n)) + CASE WHEN a.side <> o.side THEN 1 ELSE 0 END = 2 THEN o.cnt ELSE 0 END) AS relaxed FROM c a, c o GROUP BY 1, 2, 3)
SELECT r.track_id, CAST(x.hard AS BIGINT) AS hard, CAST(x.relaxed AS BIGINT) AS relaxed FROM r JOIN x ON r.n IS NOT DISTINCT FROM x.n AND (CASE WHEN r.n IS NULL THEN NULL ELSE r.side END) IS NOT DISTINCT FROM x.side AND r.b IS NOT DISTINCT FROM x.b
""")
def constraint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that a track must not, or should not, be grouped with, counted."""
    return clusters.constraint_counts(_tags(spark, sf_dir), "track_id", "key", "bpm")


_REC = """
x AS (SELECT track_id, file_no, bpm, coalesce(n, 0) AS number, CASE WHEN n IS NULL THEN -1 WHEN side = 'B' THEN 1 ELSE 0 END AS side, en AS energy, bars, substr('GHDBL', CAST(file_no % 5 AS INTEGER) + 1, 1) AS flow
  FROM (SELECT *, length(track_id || g) + bars AS file_no FROM t WHERE bpm IS NOT NULL)),
q AS (SELECT * FROM x WHERE CAST('0x' || substr(track_id, 3) AS BIGINT) % 20 = 0),
s AS (SELECT q.track_id AS query_id, r.track_id, abs(q.bpm - r.bpm) / greatest(q.bpm, r.bpm) AS p, q.side AS s1, r.side AS s2, least(abs(q.number - r.number), 12 - abs(q.number - r.number)) + CASE WHEN q.side <> r.side THEN 1 ELSE 0 END AS steps,
  q.flow AS f1, r.flow AS f2, q.bars AS w1, r.bars AS w2, abs(q.energy - r.energy) AS j FROM q JOIN x r ON q.track_id <> r.track_id),
z AS (SELECT query_id, track_id, round(1.0 - (CASE WHEN s1 >= 0 AND s2 >= 0 THEN least(1.0, steps / 6) ELSE 0.5 END) * 0.15 - CASE WHEN p <= 0.04 THEN 0.0 ELSE 0.15 * pow((p - 0.04) / 0.04, 2) END
  + CASE f1 || f2 WHEN 'GG' THEN 0.15 WHEN 'GH' THEN 0.10 WHEN 'GB' THEN 0.05 WHEN 'GL' THEN 0.10 WHEN 'HG' THEN 0.10 WHEN 'HH' THEN 0.15 WHEN 'HD' THEN -0.10 WHEN 'HL' THEN 0.10 WHEN 'DH' THEN -0.10 WHEN 'DD' THEN 0.05 WHEN 'DL' THEN -0.10
    WHEN 'BG' THEN 0.05 WHEN 'BB' THEN 0.10 WHEN 'LG' THEN 0.10 WHEN 'LH' THEN 0.10 WHEN 'LD' THEN -0.10 WHEN 'LL' THEN 0.15 ELSE 0.0 END
  + CASE WHEN w1 = w2 THEN 0.05 WHEN abs(w1 - w2) <= 16 THEN 0.0 ELSE -0.05 END
  + 0.10 * (CASE w2 WHEN 16 THEN 0.3 WHEN 32 THEN 0.7 WHEN 64 THEN 1.0 ELSE 0.5 END + CASE f2 WHEN 'H' THEN 0.15 WHEN 'G' THEN 0.10 WHEN 'L' THEN 0.15 WHEN 'D' THEN -0.10 ELSE 0.0 END)
  + CASE WHEN j = 0 THEN 0.05 WHEN j = 1 THEN 0.02 ELSE -0.05 * (j - 1) END + CASE WHEN f2 = 'B' THEN -0.08 ELSE 0.0 END, 8) AS score FROM s WHERE p <= 0.08)
"""


@query(f"WITH {_TAGS}, {_REC} SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id) AS INTEGER) AS place FROM z QUALIFY place <= 10")
def recommend_directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best tracks to follow each track of a query set, against all rows: every track whose id is divisible by 20."""
    t = _tags(spark, sf_dir).where("bpm is not null")
    known = music.is_wheel_code(F.col("key"))
    file_no = F.length(F.concat("track_id", "g")) + F.col("bars")
    x = t.select(
        "track_id", "bpm", F.coalesce(F.when(known, music.wheel_number(F.col("key"))), F.lit(0)).alias("number"), F.when(~known, -1).when(F.col("key").endswith("B"), 1).otherwise(0).alias("side"), F.col("en").alias("energy"), "bars",
        F.substring(F.lit(recommend.FLOWS), (file_no % 5 + 1).cast("int"), F.lit(1)).alias("flow"),
    )
    q = x.where(F.conv(F.substring("track_id", 3, 20), 16, 10).cast("long") % 20 == 0).withColumnRenamed("track_id", "query_id")
    return recommend.recommendations(q, x, "query_id", "track_id", 10)


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised vectors projected to the components that keep nine tenths of the variance, at length 1."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(e).transform(e)
    fitted = PCA(k=64, inputCol="x", outputCol="y").fit(scaled)
    k = max(2, int(np.searchsorted(np.cumsum(fitted.explainedVariance.toArray()), 0.90) + 1))
    y = fitted.transform(scaled).select("vec_id", F.slice(vector_to_array("y"), 1, k).alias("y"))
    return y.select("vec_id", F.transform(vectors.unit(F.col("y")), lambda v: F.round(v, 6)).alias("projected"))


@query()
def constrained_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-medoids in bounded blocks of a label under pairs that must not, or should not, meet (here: by the distance of their ids)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        ids = pdf["vec_id"].to_numpy()
        apart = np.abs(ids[:, None] - ids[None, :]) % 7
        got = clusters.constrained_medoids(pdf, "vec_id", "embedding", apart == 3, apart == 2)
        return got.assign(label=pdf["label"].to_numpy(), block=int(pdf["block"].iloc[0]))

    return clusters.in_blocks(e, "label", "vec_id").groupBy("label", "block").applyInPandas(run, "vec_id long, cluster long, medoid long, label int, block int")
