"""Tables kept by key: upsert, deletion, comparison of two states, merging of caches, layers and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """base with rows of the same key replaced by those of updates and the others added."""
    return base.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates)


def without(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of base whose key does not occur in other."""
    return base.join(other.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)), keys, "left_anti")


def within(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of base whose key occurs in other."""
    return base.join(other.select(*keys), keys, "left_semi")


def lookup(base: DataFrame, **values: object) -> DataFrame:
    """The first row that has all the given values."""
    for name, value in values.items():
        base = base.where(F.col(name) == F.lit(value))
    return base.limit(1)


def changes(old: DataFrame, new: DataFrame, keys: list[str], watched: list[str]) -> DataFrame:
    """One row per key with the watched columns of both states and the change: new, removed, changed or same."""
    o = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in watched], F.lit(True).alias("__o"))
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in watched], F.lit(True).alias("__n"))
    differs = F.lit(False)
    for c in watched:
        differs = differs | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "removed").when(differs, "changed").otherwise("same")
    return o.join(n, keys, "full").withColumn("change", change).drop("__o", "__n")


def merge_caches(kept: DataFrame, other: DataFrame, key: str, version: str, modified: str, current: str) -> DataFrame:
    """One row per key of both caches, with the outcome kept, added or replaced.

    An entry of the current version beats one of another; between equals the newer entry wins, and kept stays on a tie.
    """
    a = kept.select(F.col(key), F.struct(*kept.columns).alias("__a"))
    b = other.select(F.col(key), F.struct(*other.columns).alias("__b"))
    fresh_a, fresh_b = F.col(f"__a.{version}") == current, F.col(f"__b.{version}") == current
    better = F.when(fresh_a != fresh_b, fresh_b).otherwise(F.col(f"__b.{modified}") > F.col(f"__a.{modified}"))
    outcome = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "kept").when(better, "replaced").otherwise("kept")
    both = a.join(b, key, "full").withColumn("outcome", outcome)
    row = F.when(F.col("outcome") == "kept", F.col("__a")).otherwise(F.col("__b"))
    return both.select(row.alias("r"), "outcome").select("r.*", "outcome")


def richer_entry(entries: DataFrame, keys: list[str], richness, modified) -> DataFrame:
    """One entry per key: the richest, then the newest."""
    best = F.max_by(F.struct(*entries.columns), F.struct(richness.alias("a"), modified.alias("b")))
    return entries.groupBy(*keys).agg(best.alias("r")).select("r.*")


def cache_split(rows: DataFrame, complete) -> tuple[DataFrame, DataFrame]:
    """(rows whose cached payload is complete, the rest)."""
    flag = F.coalesce(complete, F.lit(False))
    return rows.where(flag), rows.where(~flag)


def stale(rows: DataFrame, signature: str, current: str) -> DataFrame:
    """Rows derived under another signature than the current one."""
    return rows.where(~F.col(signature).eqNullSafe(F.lit(current)))


def snapshot(df: DataFrame, path: str, run_id: str) -> None:
    """Copy of a table under the id of a run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
