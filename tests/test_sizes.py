"""What a task takes at once, and how work is dealt to tasks, stays the same whatever the size of the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import groups, select, similarity
from marquee.plans import service_queries


def test_pairs_are_dealt_to_all_tasks_and_ranked_where_they_met(spark):
    users = spark.range(200).select(F.col("id").alias("user_id"), (F.col("id") % 2).alias("city"))
    events = spark.range(18).select((F.col("id") % 2).alias("city"), F.floor(F.col("id") / 2).cast("string").alias("ord"), (F.col("id") / 18).alias("score"))
    pairs = groups.spread_join(events, users, ["city"], "user_id")
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and pairs.count() == 1800
    best = select.top_k(pairs, 2, within=("city", "_part"))
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # those of the join
    assert sorted(set(best.groupBy("user_id").agg(F.sort_array(F.collect_list("ord")).alias("o")).select(F.array_join("o", "")).collect())) == [("78",)]


def test_candidates_and_liked_vectors_meet_in_small_blocks(spark, monkeypatch):
    assert similarity.BLOCK * similarity.SLICE * 8 <= 1 << 25  # bytes of a block of similarities
    monkeypatch.setattr(similarity, "BLOCK", 3)
    monkeypatch.setattr(similarity, "SLICE", 2)
    x = np.random.default_rng(1).normal(size=(18, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.similarity for r in similarity.max_cosine(df.where("id < 11"), df.where("id >= 11").select("v"), "id", "v").collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(got[k] - (unit[k] @ unit[11:].T).max()) < 1e-12 for k in range(11)) and len(got) == 11


@pytest.mark.parametrize(("turns", "most"), [(100, 13), (200_000, 10_000)])
def test_a_batch_has_a_limit(spark, tmp_path, monkeypatch, turns, most):
    spark.range(turns).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("x").alias("text")).write.parquet(f"{tmp_path}/conversations.parquet")
    sizes = []

    def complete(requests, service, path, fallback, *, size, **how):
        sizes.append(size)
        return spark.createDataFrame([], "custom_id string, raw string, outcome string, via string")

    monkeypatch.setattr(service_queries.batches, "complete", complete)
    service_queries.batch_submit_poll(spark, str(tmp_path))
    assert sizes == [most]
