"""Conflicting observations resolved into one value per track, with explanations and a review queue.

Every operator first folds observations to one row per (track, value) or per track by aggregates that combine before the shuffle;
windows run over those few rows, so a track that holds a large share of the observations is no larger than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklattice.functions.music import camelot, tempo

# fixed values: trust and order of the sources
WEIGHTS = {"manual": 1.00, "analysis_essentia": 0.85, "analysis_librosa": 0.80, "rekordbox": 0.75, "tag": 0.55, "songstats": 0.40}
OTHER_WEIGHT = 0.5
RANKS = {"tag": 0, "rekordbox": 1, "songstats": 2, "analysis_librosa": 3, "analysis_essentia": 4}
OTHER_RANK = 99
AGREEMENT, CROSS_TYPE, THRESHOLD, MARGIN = 0.15, 0.10, 0.55, 0.05


def source(c: Column) -> Column:
    return F.lower(F.trim(c))


def _by_source(c: Column, table: dict[str, float], other: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(other))


def delivered_once(obs: DataFrame) -> DataFrame:
    """The last delivery of each observation id; rows without an id all stay."""
    cols = [c for c in obs.columns if c != "observation_id"]
    keyed = obs.where("observation_id is not null").groupBy("observation_id").agg(
        F.max_by(F.struct(*cols), F.struct("ingested_at", F.coalesce("observed_at", F.lit("")))).alias("r")
    )
    return keyed.select("observation_id", *[F.col(f"r.{c}").alias(c) for c in cols]).unionByName(obs.where("observation_id is null"))


def majority_tempo(obs: DataFrame) -> DataFrame:
    """Rows (track_id, bpm, votes, total, confidence): the whole tempo most observations give, half-even rounded.

    Ties go to a tempo that a file tag gives, then to the best source, then to the smaller tempo.
    """
    votes = obs.select("track_id", F.bround(tempo(F.col("bpm"), 1, 999)).cast("int").alias("v"), source(F.col("source_system")).alias("s")).where("v is not null and track_id is not null")
    per_value = votes.groupBy("track_id", "v").agg(
        F.count("*").alias("votes"), F.max((F.col("s") == "tag").cast("int")).alias("tagged"), F.min(_by_source(F.col("s"), RANKS, OTHER_RANK)).alias("rank")
    )
    best = per_value.groupBy("track_id").agg(
        F.min(F.struct((-F.col("votes")).alias("a"), (-F.col("tagged")).alias("b"), F.col("rank").alias("c"), F.col("v").alias("v"))).alias("x"), F.sum("votes").alias("total")
    )
    return best.select("track_id", F.col("x.v").alias("bpm"), (-F.col("x.a")).alias("votes"), "total", F.round(-F.col("x.a") / F.col("total"), 3).alias("confidence"))


def key_candidates(obs: DataFrame) -> DataFrame:
    """One row for each key observed for a track: base, score, best rank, rows, kinds of sources, place in the ranking."""
    votes = obs.select("track_id", camelot(F.col("key_camelot")).alias("key"), source(F.col("source_system")).alias("s"), F.coalesce("key_confidence", F.lit(0.0)).alias("c")).where("key is not null and track_id is not null")
    # decimals: the sum is exact, whatever order partial sums meet in
    weight = _by_source(F.col("s"), {k: f"{v:.2f}" for k, v in WEIGHTS.items()}, f"{OTHER_WEIGHT:.2f}").cast("decimal(4,2)")
    per_key = votes.groupBy("track_id", "key").agg(
        F.sum(weight * F.col("c").cast("decimal(6,4)")).alias("base"), F.count("*").alias("n"), F.min(_by_source(F.col("s"), RANKS, OTHER_RANK)).alias("rank"),
        F.max(F.col("s").startswith("analysis_").cast("int")).alias("analysis"), F.max(F.col("s").isin("rekordbox", "songstats").cast("int")).alias("external"),
        F.array_join(F.array_sort(F.collect_set("s")), "+").alias("sources"),
    )
    scored = per_key.withColumn("score", F.round(F.col("base") + (F.col("n") - 1) * F.lit(f"{AGREEMENT}").cast("decimal(4,2)") + F.col("analysis") * F.col("external") * F.lit(f"{CROSS_TYPE}").cast("decimal(4,2)"), 4).cast("double"))
    w = Window.partitionBy("track_id").orderBy(F.desc("score"), "rank", "key")
    whole = Window.partitionBy("track_id")
    return (
        scored.withColumn("place", F.row_number().over(w)).withColumn("total_base", F.sum("base").over(whole)).withColumn("rows", F.sum("n").over(whole))
        .withColumn("any_analysis", F.max("analysis").over(whole)).withColumn("next_score", F.lead("score").over(w)).withColumn("next_rank", F.lead("rank").over(w))
    )


def weighted_key(obs: DataFrame) -> DataFrame:
    """Rows (track_id, key, score, confidence, sources, resolved, reason): the key of the highest weighted vote.

    It is resolved by a majority of the rows, by a sufficient score with a margin, or where an equal score has the better source.
    """
    top = key_candidates(obs).where("place = 1")
    enough = F.col("score") >= THRESHOLD
    resolved = (
        (F.col("n") * 2 > F.col("rows"))
        | (enough & (F.col("next_score").isNull() | (F.round(F.col("score") - F.col("next_score"), 4) >= MARGIN)))
        | (enough & F.col("next_score").isNotNull() & (F.col("rank") < F.col("next_rank")))
    )
    conflict = F.col("next_score").isNotNull()
    reason = (
        F.when(resolved & ~conflict & (F.col("n") == 1), "single_source").when(resolved & ~conflict, "all_agree").when(resolved, "majority_or_score")
        .when(F.col("any_analysis") == 0, "no_analysis").when(conflict, "source_conflict").otherwise("low_confidence")
    )
    share = F.when(F.col("total_base") > 0, F.round(F.col("base").cast("double") / F.col("total_base").cast("double"), 3)).otherwise(0.0)
    return top.select("track_id", "key", "score", share.alias("confidence"), "sources", resolved.alias("resolved"), reason.alias("reason"))


def latest_by_source(obs: DataFrame, value: str, sources: list[str]) -> DataFrame:
    """One row per track with the last observed value of each source as a column."""
    s = source(F.col("source_system"))
    # the id breaks ties of time, so the result does not depend on the order of the rows
    pick = [F.max_by(F.when(s == x, F.col(value)), F.when((s == x) & F.col(value).isNotNull(), F.struct("observed_at", "observation_id"))).alias(x) for x in sources]
    return obs.where("track_id is not null").groupBy("track_id").agg(*pick)


def evidence_summary(obs: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Rows (track_id, evidence): "source=key" of each source's last valid key in a fixed order, separated by "; "."""
    order = sources or [*WEIGHTS]
    valid = obs.withColumn("k", camelot(F.col("key_camelot"))).where("k is not null")
    wide = latest_by_source(valid, "k", order)
    return wide.select("track_id", F.concat_ws("; ", *[F.when(F.col(x).isNotNull(), F.concat(F.lit(x + "="), F.col(x))) for x in order]).alias("evidence"))


def review_queue(obs: DataFrame, top: int = 3) -> DataFrame:
    """Tracks whose key is not resolved, with their best candidates as columns, the conflicts first."""
    open_ = weighted_key(obs).where(~F.col("resolved")).select("track_id", "reason")
    cands = key_candidates(obs).where(F.col("place") <= top)
    wide = cands.groupBy("track_id").agg(*[
        x for i in range(1, top + 1)
        for x in (F.max(F.when(F.col("place") == i, F.col("key"))).alias(f"key_{i}"), F.max(F.when(F.col("place") == i, F.round("base", 4).cast("double"))).alias(f"score_{i}"))
    ])
    priority = F.when(F.col("reason") == "source_conflict", "high").when(F.col("reason") == "no_analysis", "low").otherwise("medium")
    return open_.join(wide, "track_id").withColumn("priority", priority)


def primary_rows(rows: DataFrame, group: str, flag: Column, order: Column) -> DataFrame:
    """One row per group: the first flagged one by order, the first of all where none is flagged, and the group's size."""
    best = F.min_by(F.struct(*rows.columns), F.struct(F.when(flag, 0).otherwise(1).alias("f"), order.alias("o")))
    return rows.groupBy(group).agg(best.alias("r"), F.count("*").alias("linked_count"), F.max(flag.cast("int")).alias("had_primary")).select("r.*", "linked_count", "had_primary")


def overview(tracks: DataFrame, obs: DataFrame, sources: list[str]) -> DataFrame:
    """One row per track with each source's last tempo and key beside the canonical ones; every track stays."""
    bpm = latest_by_source(obs, "bpm", sources)
    key = latest_by_source(obs, "key_camelot", sources)
    named = bpm.select("track_id", *[F.col(s).alias(f"bpm_{s}") for s in sources]).join(key.select("track_id", *[F.col(s).alias(f"key_{s}") for s in sources]), "track_id", "full")
    return tracks.join(named, "track_id", "left")


def backfilled(rows: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with blank values of columns filled from other, which has one row per key."""
    o = other.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    return rows.join(o, key, "left").withColumns({c: F.coalesce(blank(c), F.col(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])
