"""Exact ranks and quantiles of a whole column without sorting it in one task.

Values are counted, cut into ranges by approximate quantiles, summed range by range (a bounded number of rows), and ranked inside
their range: every step but the sums of the ranges is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def cumulated(rows: DataFrame, column: str) -> DataFrame:
    """Rows (value, n, below, total) for the distinct values that are not null: how often each occurs and how many are smaller."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    edges = rows.select(F.percentile_approx(F.col(column).cast("double"), [i / RANGES for i in range(1, RANGES)], 4096).alias("e")).collect()[0]["e"] or []
    cuts = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    spread = counts.withColumn("part", F.aggregate(cuts, F.lit(0), lambda acc, e: acc + (F.col("value") > e).cast("int")))
    parts = spread.groupBy("part").agg(F.sum("n").alias("in_part"))  # at most RANGES rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.withColumn("offset", F.coalesce(F.sum("in_part").over(before), F.lit(0))).withColumn("total", F.sum("in_part").over(every))
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = spread.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return ranked.join(F.broadcast(parts), "part").select("value", "n", (F.col("offset") + F.col("inside")).alias("below"), "total")


def percentile_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with name: the average rank among ties, from 0 for the smallest to 1 for the largest; 0 for a single row, null for null."""
    rank = F.when(F.col("total") > 1, (F.col("below") + (F.col("n") - 1) / 2) / (F.col("total") - 1)).otherwise(0.0)
    ranks = cumulated(rows, column).select("value", rank.alias(name))
    return rows.join(ranks, rows[column].cast("double") == ranks["value"], "left").drop("value")


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours; None for a column without values."""
    cum = cumulated(rows, column)
    wanted = []
    head = cum.select("total").limit(1).collect()
    if not head:
        return [None] * len(shares)
    total = head[0]["total"]
    for s in shares:
        at = s * (total - 1)
        wanted.append((int(at), min(int(at) + 1, total - 1), at - int(at)))
    places = sorted({p for a, b, _ in wanted for p in (a, b)})
    hit = cum.where(" or ".join(f"(below <= {p} and below + n > {p})" for p in places)).collect()  # two rows a share at most
    at = {p: next(r["value"] for r in hit if r["below"] <= p < r["below"] + r["n"]) for p in places}
    return [at[a] + (at[b] - at[a]) * f for a, b, f in wanted]


def contrast_stretched(rows: DataFrame, column: str, name: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """rows with name: the column stretched so that the low quantile is 0 and the high one 1, clipped; null becomes 1."""
    a, b = quantiles(rows, column, [low, high])
    if a is None:
        return rows.withColumn(name, F.lit(1.0))
    span = max(b - a, 1e-12)
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(column) - a) / span))
    return rows.withColumn(name, F.coalesce(F.when(~F.isnan(F.col(column).cast("double")), scaled), F.lit(1.0)))
