"""State is held by buckets of keys: Python and the state store are not called for each key."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marquee.streaming import folds

BIG = 2**60 + 1  # no double holds it


def test_seen_keys_share_buckets_and_whole_numbers_stay_whole(spark, tmp_path):
    path, first = str(tmp_path), datetime(2024, 1, 1)
    rows = [(None if k % 7 == 0 else BIG + k % 1500, None if k % 5 == 0 else k % 3, first + timedelta(hours=k // 4), float("nan") if k % 2 else None) for k in range(3000)]
    rows += [(k, n, at + timedelta(days=days), v) for k, n, at, v in rows for days in (3, 14)]
    df = spark.createDataFrame(rows, "id long, n int, arrived_at timestamp_ntz, value double")
    df.coalesce(1).write.parquet(f"{path}/in")
    stream = folds.unseen(folds.stream_of(spark, f"{path}/in"), ["id", "n"], "arrived_at")
    assert stream.schema == df.schema
    got = folds.run_to_end(stream, "unseen", path).collect()
    until, want = {}, []
    for k, n, at, v in sorted(rows, key=lambda r: r[2]):
        if (k, n) not in until or until[k, n] <= at:
            until[k, n] = at + timedelta(days=14)
            want.append((k, n, at, v))
    assert sorted(map(str, want)) == sorted(str((r.id, r.n, r.arrived_at, r.value)) for r in got)
    kept = spark.read.format("statestore").option("stateVarName", "until").load(f"{path}/state")
    assert 0 < kept.count() <= 1024 < len(until)


def test_users_share_buckets_and_whole_numbers_stay_whole(spark, tmp_path):
    path, now = str(tmp_path), F.lit("2024-01-31").cast("timestamp_ntz")
    rows = [(BIG + k, None if k % 7 == 0 else BIG + k % 1500, None if k % 5 == 0 else BIG + k % 3, datetime(2024, 1, 1) + timedelta(minutes=k // 4), "click" if k % 3 else "negative") for k in range(6000)]
    signals = spark.createDataFrame(rows, "event_id long, user long, category long, ts timestamp_ntz, signal string")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        signals.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
        got = folds.fold_stream(folds.stream_of(spark, f"{path}/in"), ["user", "category"], now, path=path)
    table = lambda df: sorted((str(r.user), str(r.category), r.n_signals) for r in df.collect())
    assert table(got) == table(signals.groupBy("user", "category").agg(F.count("*").alias("n_signals")))
    kept = spark.read.format("statestore").option("stateVarName", "weights").load(f"{path}/state")
    assert kept.count() == signals.select("user").distinct().count() and kept.select("key").distinct().count() <= 1024
