"""Plans that must hold at scale: what reaches the scan, what is joined how, and hot keys."""

import pytest
from pyspark.sql import functions as F

from tracklattice.operators import linkage, resolve
from tracklattice.plans.catalogue import QUERIES

FORBIDDEN = ("CartesianProduct",)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["majority_tempo", "weighted_key", "band_join_tolerance", "fuzzy_best_match", "taxonomy_rollup_select", "medoids_by_label", "section_islands", "upsert_merge", "evidence_summary"])
def test_no_cartesian_product(spark, tiny, name):
    plan = plan_of(QUERIES[name](spark, tiny))
    assert not any(x in plan for x in FORBIDDEN)


def test_filter_and_columns_reach_the_scan(spark, tiny):
    plan = QUERIES["pushed_down_summary"](spark, tiny)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    scan = plan[plan.rindex("ReadSchema") :]
    assert "l_partkey" not in scan.split(">")[0]


def test_votes_of_a_hot_track_combine_before_the_shuffle(spark, tiny):
    plan = plan_of(QUERIES["majority_tempo"](spark, tiny))
    assert plan.count("partial_") >= 4 and "Window" not in plan


def test_a_group_with_a_third_of_the_rows_meets_by_band(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id"))).alias("g"), (F.col("id") * 10.0).alias("x"))
    assert linkage.band_pairs(rows, "g", "id", "x", 30.0).count() == 999


def test_hot_track_is_voted_on(spark):
    rows = spark.range(20000).select(
        F.concat(F.lit("O"), F.col("id")).alias("observation_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("T"), F.col("id"))).otherwise("hot").alias("track_id"), F.lit("tag").alias("source_system"),
        F.lit("8A").alias("key_camelot"), F.lit(0.5).alias("key_confidence"), F.when(F.col("id") % 6 == 0, "120").otherwise("121").alias("bpm"),
    )
    got = resolve.majority_tempo(rows).where("track_id = 'hot'").collect()[0]
    assert (got["total"], got["bpm"], got["confidence"]) == (6667, 120, 0.5)
