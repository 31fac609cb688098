"""Hits and misses of entries whose cache is written by entries: one pass."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import keyed
from marquee.plans import run_queries


def test_hits_by_own_writes(spark):
    rows = [(1, "a", "x", 5), (2, "a", "x", None), (3, "a", "y", 3), (4, "b", "x", None), (5, None, "x", 9), (6, "a", None, 9), (7, "a", "y", 2)]
    df = spark.createDataFrame(rows, "id long, feed string, h string, expires_at long")
    found = keyed.placed(keyed.hits_of_own(df, ["feed", "h"], "expires_at", F.lit(3)), "hit", "id")
    assert {r.id: (r.hit, r.position.part) for r in found.collect()} == {k: (k < 3, 0 if k < 3 else 1) for k in range(1, 8)}
    hits, misses = keyed.hits_and_misses(df.select("id", "feed", "h"), df.where("expires_at IS NOT NULL").groupBy("feed", "h").agg(F.max("expires_at").alias("expires_at")), ["feed", "h"], F.lit(3))
    assert {r.id for r in hits.collect()} == {1, 2} and {r.id for r in misses.collect()} == {3, 4, 5, 6, 7}


@pytest.mark.parametrize("query", ["cached_event_union", "extraction_cap"])
def test_listings_are_read_once(spark, query):
    plan = run_queries.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("Relation [l_orderkey") == 1
