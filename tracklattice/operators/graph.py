"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklattice.session import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Rows (node, component) for every node of the edges; the component is its smallest node.

    Labels take the minimum over neighbours and then over the label's own label, so the rounds grow with the logarithm of the
    longest path. Every round is written to the shared folder; minima are combined before they are shuffled, so a node that
    holds a large share of the edges costs no more than its rows. Null ends are left out; an empty table gives no rows.
    """
    clean = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = clean.unionByName(clean.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("y"), F.col("component").alias("c")), "y").groupBy(F.col("x").alias("node")).agg(F.min("c").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        fresh = materialise(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "old"), "labels")
        changed = fresh.where("component <> old").limit(1).count()
        labels = fresh.drop("old")
        if not changed:
            return labels
    raise RuntimeError("components did not settle; raise max_rounds")
