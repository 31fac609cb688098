"""Streams: dedup against expiring state, and feedback folded into weights, each as available-now file streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import vocab
from ..functions.scoring import recency_band
from ..operators.feedback import age_days, delta
from ..storage import fresh_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, which state of one's own needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def stream_of(spark: SparkSession, path: str, **options) -> DataFrame:
    """File stream of Parquet under ``path``; its schema is that of what lies there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(path)


def dedup(events: DataFrame, keys: list[str], ts: str, ttl_days: int = vocab.CACHE_TTL_DAYS["seen_entries"]) -> DataFrame:
    """First row per key; a key is forgotten once the watermark is ``ttl_days`` past it, so state is bounded by the
    keys of that span. Event time stands in for the arrival time of the batch design."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", f"{ttl_days} days")
    return timed.dropDuplicatesWithinWatermark(keys).drop("_ts")


def run_to_end(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote, in this run and in earlier ones on the same ``path``."""
    spark = df.sparkSession
    root = path or fresh_path(spark, name)
    with rocks(spark):
        query = df.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/rows")


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _numbers_as_text(df: DataFrame) -> list[Column]:
    """The columns of ``df`` as pandas can hold them without loss: beside nulls its whole numbers are floats, and not-a-number is null."""
    return [F.col(f"`{n}`").cast("string").alias(n) if t in _NUMBERS else F.col(f"`{n}`") for n, t in df.dtypes]


def _numbers_back(df: DataFrame, like: DataFrame, *more: str) -> DataFrame:
    return df.select(*(F.col(f"`{n}`").cast(t).alias(n) if t in _NUMBERS else F.col(f"`{n}`") for n, t in like.dtypes), *more)


class _Weights(StatefulProcessor):
    """State of a bucket of users: by user, the weight and number of signals of each of their keys, which are few (categories). Emitted are the keys that a micro-batch has changed."""

    def __init__(self, keys: list[tuple[str, str]], start: float):
        self.names, self.kinds, self.start = [n for n, _ in keys], [t for _, t in keys], start

    def init(self, handle) -> None:
        rest = ", ".join(f"k{i}: {t}" for i, t in enumerate(self.kinds[1:]))
        self.held = handle.getMapState("weights", f"user {self.kinds[0]}", f"at array<struct<{rest}>>, weight array<double>, n_signals array<long>")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "step_no_id", "step_id"], kind="stable")
        columns = [pdf[n].astype(object).where(pdf[n].notna(), None).tolist() for n in self.names]
        steps: dict[object, dict[tuple, list[float]]] = {}
        for user, *rest, d in zip(*columns, pdf["d"].tolist(), strict=True):
            steps.setdefault(user, {}).setdefault(tuple(rest), []).append(d)
        out = []
        for user, changed in steps.items():
            kept = self.held.getValue((user,))
            held = {tuple(at): (weight, n) for at, weight, n in zip(*kept, strict=True)} if kept else {}
            for rest, ds in changed.items():
                weight, n = held.get(rest, (self.start, 0))
                for d in ds:
                    weight = min(1.0, max(0.0, weight + d))
                held[rest] = weight, n + len(ds)
                out.append((user, *rest, *held[rest]))
            self.held.updateValue((user,), (list(held), [w for w, _ in held.values()], [n for _, n in held.values()]))
        yield pd.DataFrame(out, columns=[*self.names, "weight", "n_signals"])

    def close(self) -> None:
        pass


def weight_changes(signals: DataFrame, keys: list[str], now, start: float = vocab.NEUTRAL_FIT, buckets: int = 1024) -> DataFrame:
    """A stream of (keys, weight, n_signals): the keys that each micro-batch of signals (keys, ts, event_id, signal) has changed, with their weight after it. Steps of
    a micro-batch are folded in order of time and id; the weights live in the stream's state, by the first key (the user), so a batch reads and writes those of
    its own users alone. Bound a micro-batch by the source's options: a user's share of one is in one task.

    Users are dealt into ``buckets`` by their hash, and Python is called once for each bucket of a micro-batch, not for each user; the number stays the same for a path."""
    ident = F.coalesce("event_id", F.lit(0).cast(dict(signals.dtypes)["event_id"])).alias("step_id")  # nulls last, and ids whole
    extra = F.col("event_id").isNull().alias("step_no_id"), ident, delta(F.col("signal"), F.col("ts"), now).alias("d"), F.pmod(F.xxhash64(keys[0]), F.lit(buckets)).alias("step_bucket")
    of_keys = signals.select(*keys)
    steps = signals.select(*_numbers_as_text(of_keys), "ts", *extra)
    kinds = steps.select(*keys).dtypes
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kinds), "weight double, n_signals long"])
    changes = steps.groupBy("step_bucket").transformWithStateInPandas(_Weights(kinds, start), schema, "Append", "None")
    return _numbers_back(changes, of_keys, "weight", "n_signals")


def fold_stream(signals: DataFrame, keys: list[str], now, start: float = vocab.NEUTRAL_FIT, path: str | None = None) -> DataFrame:
    """Weights per key after a stream of signals: what ``weight_changes`` has written, its last row for each key. Called again on the same ``path``, the stream
    goes on where it was."""
    spark = signals.sparkSession
    root = path or fresh_path(spark, "weights")
    changes = weight_changes(signals, keys, now, start)
    with rocks(spark):
        query = changes.writeStream.format("parquet").option("path", f"{root}/changes").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    written = spark.read.schema(changes.schema).parquet(f"{root}/changes")
    return written.groupBy(*keys).agg(F.max_by("weight", "n_signals").alias("weight"), F.max("n_signals").alias("n_signals"))


class _Seen(StatefulProcessor):
    """State of a bucket of keys, one value: until when each key counts as seen. A timer of the stream's clock, set where a bucket has keys, leaves those that are over out."""

    def __init__(self, columns: list[str], ttl_us: int):
        self.columns, self.ttl_us = columns, ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "seen_key array<string>, until_us array<long>", None)

    def _keep(self, held: dict[str, int], clock: bool) -> None:
        self.until.update((list(held), list(held.values())))
        if clock:
            self.handle.registerTimer(-(-max(held.values()) // 1000))

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["seen_us", "seen_order"], kind="stable")
        held = dict(zip(*self.until.get(), strict=True)) if self.until.exists() else {}
        first, keep = not held, []
        for name, us in zip(pdf["seen_key"].tolist(), pdf["seen_us"].tolist(), strict=True):
            until = held.get(name)
            keep.append(until is None or until <= us)
            if keep[-1]:
                held[name] = us + self.ttl_us
        if any(keep):
            self._keep(held, first)
            yield pdf.loc[keep, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.until.exists():
            now = 1000 * timerValues.getCurrentWatermarkInMs()
            held = {name: until for name, until in zip(*self.until.get(), strict=True) if until > now}
            if held:
                self._keep(held, True)
            else:
                self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


def unseen(entries: DataFrame, keys: list[str], arrived_at: str, ttl_days: int = vocab.CACHE_TTL_DAYS["seen_entries"], buckets: int = 1024) -> DataFrame:
    """A stream of the entries whose key was not seen in the last ``ttl_days`` before they arrived. A key is seen from the entry that is let through until the days are over;
    those that are held back don't prolong it. The clock is that of ``arrived_at``: keys are forgotten once arrivals are as many days past the end of all that their bucket had when its timer was set,
    so state is bounded by the keys of three times that span, and entries that are told so late are dropped. Entries of one micro-batch are taken in order of
    arrival, those that arrived together in order of their contents. Null keys are keys like others; entries that don't say when they arrived are left out.

    Keys are dealt into ``buckets`` by their hash, so that Python and the state store are called once for each bucket of a micro-batch, not for each key; the number stays the same for a path."""
    at = F.col(arrived_at).cast("timestamp")
    extra = at.alias("seen_at"), F.unix_micros(at).alias("seen_us"), F.to_json(F.struct(*entries.columns)).alias("seen_order"), F.to_json(F.struct(*keys)).alias("seen_key")
    dated = entries.where(F.col(arrived_at).isNotNull()).select(*_numbers_as_text(entries), *extra).withColumn("seen_bucket", F.pmod(F.xxhash64("seen_key"), F.lit(buckets)))
    schema = ", ".join(f"`{n}` {t}" for n, t in dated.select(*entries.columns).dtypes)
    seen = _Seen(entries.columns, ttl_days * 86_400_000_000)
    return _numbers_back(dated.withWatermark("seen_at", f"{ttl_days} days").groupBy("seen_bucket").transformWithStateInPandas(seen, schema, "Append", "EventTime"), entries)


def with_history(events: DataFrame, history: DataFrame, keys: list[str], now) -> DataFrame:
    """A stream (or table) against the static history: band none, soft or hard of each event by its last recommendation. The history is
    brought to one row per key before the join."""
    last = history.groupBy(*keys).agg(F.max("recommended_at").alias("last_at"))
    return events.join(last, keys, "left").withColumn("band", recency_band(age_days(F.col("last_at"), now)))
