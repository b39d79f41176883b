"""Quality of predictions: accuracy, F1, confidence buckets, ranks, distributions, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = [(0.0, 0.35), (0.35, 0.55), (0.55, 0.70), (0.70, 1.01)]


def _share(c) -> F.Column:
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def accuracy(rows: DataFrame, truth: str, ranked: str, confidence: str) -> DataFrame:
    """One row: rows, top-1 and top-3 accuracy, mean confidence; ranked is an array of labels, the best first."""
    hit1, hit3 = F.get(ranked, F.lit(0)) == F.col(truth), F.array_contains(F.slice(ranked, 1, 3), F.col(truth))
    return rows.agg(F.count("*").alias("n"), F.round(_share(hit1), 6).alias("top1"), F.round(_share(hit3), 6).alias("top3"), F.round(F.avg(confidence), 6).alias("mean_confidence"))


def per_class(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows (label, support, predicted, hits, precision, recall, f1) for every label of either side."""
    t = rows.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"), F.sum((F.col(truth) == F.coalesce(predicted, F.lit(""))).cast("int")).alias("hits"))
    p = rows.where(F.col(predicted).isNotNull()).groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("n_predicted"))
    both = t.join(p, "label", "full").na.fill(0)
    precision = F.when(F.col("n_predicted") > 0, F.col("hits") / F.col("n_predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, precision * recall * 2 / (precision + recall)).otherwise(0.0)
    return both.select("label", "support", "n_predicted", "hits", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def averages(classes: DataFrame) -> DataFrame:
    """One row: macro and support-weighted F1 over the classes that occur as truth."""
    real = classes.where("support > 0")
    return real.agg(F.round(F.avg("f1"), 5).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 5).alias("weighted_f1"), F.count("*").alias("classes"))


def confidence_buckets(rows: DataFrame, confidence: str, hit) -> DataFrame:
    """Rows (low, high, n, accuracy) for every fixed bucket, empty ones with 0 rows and null accuracy."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([(float(a), float(b)) for a, b in BUCKETS], "low double, high double")
    which = F.coalesce(*[F.when((F.col(confidence) >= a) & (F.col(confidence) < b), F.lit(float(a))) for a, b in BUCKETS])
    counted = rows.select(which.alias("low"), F.coalesce(hit, F.lit(False)).cast("double").alias("h")).groupBy("low").agg(F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("accuracy"))
    return dim.join(counted, "low", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def distribution(rows: DataFrame, label: str, cap: float = 0.20) -> DataFrame:
    """Rows (label, n, share, over_cap)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a label
    return counts.withColumn("total", F.sum("n").over(every)).select(label, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), (F.col("n") / F.col("total") > cap).alias("over_cap"))


def audit(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Rows (label, n, mean, p25, p50, p75, top) of a score by label."""
    q = F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = rows.groupBy(label).agg(F.count(score).alias("n"), F.avg(score).alias("m"), q.alias("q"), F.max(score).alias("top"))
    return got.select(label, "n", F.round("m", 5).alias("mean"), *[F.round(F.col("q")[i], 5).alias(f"p{p}") for i, p in enumerate((25, 50, 75))], F.round("top", 5).alias("top"))


def target_ranks(scored: DataFrame, query_id: str, item: str, score: str, target: str) -> DataFrame:
    """Rows (query_id, rank, of): place of each query's target among its scored items, null where it is not among them."""
    w = Window.partitionBy(query_id).orderBy(F.desc(score), item)
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.groupBy(query_id).agg(F.max(F.when(F.col(item) == F.col(target), F.col("rank"))).alias("rank"), F.count("*").alias("of"))


def supported(rows: DataFrame, label: str, least: int = 3) -> DataFrame:
    """Rows whose label occurs at least `least` times."""
    enough = rows.groupBy(label).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(label)
    return rows.join(enough, label, "left_semi")


def coverage(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Rows (layer, filled, share): how many rows have each column filled."""
    filled = [F.sum(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)).cast("long")).alias(c) for c in columns]
    one = rows.agg(F.count(id_col).alias("__n"), *filled)
    stacked = one.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("filled")) for c in columns])).alias("x"))
    return stacked.select("x.layer", "x.filled", F.round(F.col("x.filled") / F.col("__n"), 6).alias("share"))


def collapse_guard(fit, labels_of, largest: float = 0.20, tries: int = 4):
    """(model, predictions, share): fit(seed) is called with other seeds, `tries` times at most, until no label holds more than `largest` of the
    predictions labels_of(model), a DataFrame with a column label; the attempt of the smallest largest label counts where none is good enough."""
    best = None
    for seed in range(tries):
        model = fit(seed)
        said = labels_of(model)
        counts = said.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("n")).collect()[0]
        share = (counts["top"] or 0) / max(1, counts["n"] or 0)
        if best is None or share < best[2]:
            best = (model, said, share)
        if share <= largest:
            break
    return best
