"""Feedback folds: each step is clamped, so steps of one key run in order; keys run apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.scoring import clamp, feedback_decay


def age_days(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400e6


def delta(signal: Column, ts: Column, now: Column) -> Column:
    base = F.when(signal == "click", vocab.CLICK_DELTA).otherwise(vocab.NEGATIVE_DELTA)
    return base * feedback_decay(age_days(ts, now))


def composed(signals: DataFrame, keys: list[str], now: Column, bucket_seconds: int = 3600) -> DataFrame:
    """(keys, bucket, lo, hi, d, n): all steps of a key within a bucket of time as one step x -> min(hi, max(lo, x + d)), n of them.

    A clamped step followed by another is again such a step, so a key's past is never gathered: only a bucket's steps are put in order, by time and id."""
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (bucket_seconds * 1_000_000)).alias("bucket")
    steps = signals.select(*keys, bucket, F.struct("ts", "event_id", delta(F.col("signal"), F.col("ts"), now).alias("d")).alias("step"))
    ordered = F.array_sort(F.collect_list("step"))
    nothing = F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0.0).alias("d"))
    one = F.aggregate(ordered, nothing, lambda f, s: F.struct(clamp(f["lo"] + s["d"]).alias("lo"), clamp(f["hi"] + s["d"]).alias("hi"), (f["d"] + s["d"]).alias("d")))
    return steps.groupBy(*keys, "bucket").agg(one.alias("f"), F.count("*").alias("n")).select(*keys, "bucket", "f.*", "n")


def then(weight: Column, parts: Column) -> Column:
    """The weight after composed steps, in order of their buckets."""
    return F.aggregate(F.array_sort(parts), weight, lambda w, p: F.least(p["hi"], F.greatest(p["lo"], w + p["d"])))


def parts(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parts, n): a key's composed steps; as many as there are buckets with signals."""
    return steps.groupBy(*keys).agg(F.collect_list(F.struct("bucket", "lo", "hi", "d")).alias("parts"), F.sum("n").alias("n"))


def fold_weights(signals: DataFrame, keys: list[str], now: Column, start: float = vocab.NEUTRAL_FIT) -> DataFrame:
    """Weight per key after all signals, in order of time and id, clamped to [0, 1] at every step."""
    return parts(composed(signals, keys, now), keys).select(*keys, then(F.lit(start), F.col("parts")).alias("weight"), F.col("n").alias("n_signals"))


def fold_vibes(signals: DataFrame, user: str, now: Column) -> DataFrame:
    """Vibe preferences after all signals: a click adds the event's tags, a negative removes them, while the signal's
    decay is at least one half. Set operations on single tags don't interact, so the last effective signal of each (user, tag)
    decides, which is an aggregation instead of a fold over the user's whole past."""
    live = signals.where(feedback_decay(age_days(F.col("ts"), now)) >= vocab.VIBE_MIN_DECAY)
    tags = live.select(user, "ts", "event_id", "signal", F.explode("vibe_tags").alias("tag")).where(F.col("tag").isin(*vocab.VIBES))
    last = tags.groupBy(user, "tag").agg(F.max_by("signal", F.struct("ts", "event_id")).alias("signal"))
    return last.where("signal = 'click'").groupBy(user).agg(F.array_sort(F.collect_list("tag")).alias("vibes"))
