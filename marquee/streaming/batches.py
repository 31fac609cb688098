"""Batches of prompts that a service answers later: submitted once, polled by a stream, answered once.

Each batch is a key of a stateful stream. Its state (the service's name for it, and how often it was polled) is set when its requests arrive and lives in
the stream's checkpoint; a timer wakes it every ``interval`` to poll. When the service is done, the answers leave the state as rows and the
batch is forgotten. A stream that is stopped or killed goes on where it was when it is started on the same checkpoint: batches that
were submitted are not submitted again, and the file sink holds each answer once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import outcomes
from ..storage import exists, open_store
from .folds import rocks

ROWS = "batch long, custom_id string, state string, raw string, error string, polls int"


class Service(Protocol):
    """What a client of such a service does. ``key`` names the batch on the caller's side: a batch that comes again under a key it knows, after a
    failure between submission and commit, is the same one."""

    def submit(self, key: str, requests: list[tuple[str, str]]) -> str: ...

    def poll(self, name: str) -> tuple[str, list[tuple[str, str | None, str | None]]]:
        """(processing, completed or failed; (custom_id, answer, error) of each request)."""


class FolderService:
    """A stand-in that keeps its batches as files in a shared folder: ready after ``polls(batch)`` polls; ``answer`` gives the answer of a prompt or raises."""

    def __init__(self, folder: str, answer: Callable[[str], str], polls: Callable[[int], int] = lambda batch: 1, fails: Callable[[int], bool] = lambda batch: False):
        self.folder, self.answer, self.polls, self.fails = folder, answer, polls, fails

    def _open(self):
        return open_store(self.folder)

    def submit(self, key: str, requests: list[tuple[str, str]]) -> str:
        store, root = self._open()
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{key}.json") as f:
            f.write(json.dumps(requests).encode())
        with store.open_output_stream(f"{root}/{key}.submit{time.time_ns()}") as f:  # one for each time
            f.write(b"")
        return key

    def poll(self, name: str) -> tuple[str, list[tuple[str, str | None, str | None]]]:
        store, root = self._open()
        batch = int(name)
        seen = sum(f.base_name.startswith(f"{name}.poll") for f in store.get_file_info(fs.FileSelector(root)))
        with store.open_output_stream(f"{root}/{name}.poll{seen}") as f:
            f.write(b"")
        if seen + 1 < self.polls(batch):
            return "processing", []
        if self.fails(batch):
            return "failed", []
        with store.open_input_stream(f"{root}/{name}.json") as f:
            requests = json.loads(f.read())
        out = []
        for custom_id, prompt in requests:
            try:
                out.append((custom_id, self.answer(prompt), None))
            except Exception as why:  # noqa: BLE001 - a request's failure is its own
                out.append((custom_id, None, f"{type(why).__name__}: {why}"))
        return "completed", out


class Poller(StatefulProcessor):
    """submitted -> (processing)* -> answered rows, or one row that says failed or expired."""

    def __init__(self, service: Service, interval_ms: int, max_polls: int):
        self.service, self.interval_ms, self.max_polls = service, interval_ms, max_polls

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batch", "name string, polls int", None)

    def handleInputRows(self, key, rows, timerValues):
        requests = [pair for pdf in rows for pair in zip(pdf["custom_id"], pdf["prompt"], strict=True)]
        if not self.state.exists():
            self.state.update((self.service.submit(str(key[0]), requests), 0))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.interval_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        name, polls = self.state.get()
        polls += 1
        try:
            status, answers = self.service.poll(name)
        except Exception as why:  # noqa: BLE001 - a poll that fails is repeated, as often as any
            status, answers = "processing", [(None, None, f"{type(why).__name__}: {why}")]
        if status == "processing" and polls < self.max_polls:
            self.state.update((name, polls))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.interval_ms)
            return
        self.state.clear()
        if status == "completed":
            told = [(key[0], c, "failed" if a is None else "answered", a, e, polls) for c, a, e in answers]
        else:
            told = [(key[0], None, "expired" if status == "processing" else "failed", None, None, polls)]
        yield pd.DataFrame(told, columns=["batch", "custom_id", "state", "raw", "error", "polls"])

    def close(self) -> None:
        pass


def deal(requests: DataFrame, size: int) -> DataFrame:
    """``requests`` (custom_id, prompt) with the number of their batch, each of about ``size`` requests. Rows without an id or prompt are left out, equal ids are one request."""
    known = requests.where("custom_id is not null and prompt is not null").groupBy("custom_id").agg(F.min("prompt").alias("prompt"))
    parts = max(1, -(-known.count() // size))
    return known.select(F.pmod(F.xxhash64("custom_id"), F.lit(parts)).alias("batch"), "custom_id", "prompt")


def poll_stream(spark: SparkSession, path: str, service: Service, *, interval_seconds: float = 300.0, max_polls: int = 288, trigger: str = "30 seconds"):
    """Start (or go on with) the stream over the batches under ``path``/requests; its rows go to ``path``/answers. A batch's requests are written by one
    job, so that they arrive in one micro-batch. Timers need the RocksDB state store (see ``folds.rocks``)."""
    requests = spark.readStream.schema("batch long, custom_id string, prompt string").parquet(f"{path}/requests")
    poller = Poller(service, int(interval_seconds * 1000), max_polls)
    polled = requests.groupBy("batch").transformWithStateInPandas(poller, ROWS, "Append", "ProcessingTime")
    return polled.writeStream.format("parquet").option("path", f"{path}/answers").option("checkpointLocation", f"{path}/polls").outputMode("append").trigger(processingTime=trigger).start()


def answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{path}/answers") if exists(spark, f"{path}/answers/_spark_metadata") else spark.createDataFrame([], ROWS)


def wait_for(spark: SparkSession, path: str, query, timeout: float = 86_400.0) -> None:
    """Until every batch has left its state, then stop the stream; an error of the stream is raised."""
    batches = spark.read.parquet(f"{path}/requests").select("batch").distinct().count()
    end = time.monotonic() + timeout
    try:
        while answers(spark, path).select("batch").distinct().count() < batches:
            if query.exception():
                raise query.exception()
            if time.monotonic() > end:
                raise TimeoutError(f"batches are open after {timeout} seconds")
            time.sleep(0.5)
    finally:
        query.stop()


def complete(requests: DataFrame, service: Service, path: str, fallback: outcomes.Strategy, *, size: int = 10_000, timeout: float = 86_400.0, how: dict | None = None, **polling) -> DataFrame:
    """(custom_id, raw, outcome, via) of each request. ``via`` is batch where the batch answered; requests of failed or expired batches, and those that the batch
    left without an answer, are asked one by one (``outcomes.run``) and have via = single, or none where that failed too.

    All there is lies under ``path``: called again on it, the run goes on where it was."""
    spark = requests.sparkSession
    if not exists(spark, f"{path}/requests/_SUCCESS"):
        dealt = deal(requests, size)
        dealt.repartition("batch").write.mode("overwrite").parquet(f"{path}/requests")
    with rocks(spark):
        wait_for(spark, path, poll_stream(spark, path, service, **polling), timeout)
    asked = spark.read.parquet(f"{path}/requests")
    given = answers(spark, path).where("state = 'answered'").select("custom_id", "raw")
    left = asked.join(given, "custom_id", "left_anti")
    singly = outcomes.join_outcomes(left, F.col("prompt"), outcomes.run(left.select("prompt"), fallback, f"{path}/single", **(how or {})))
    answered = F.col("outcome") == "answered"
    alone = singly.select("custom_id", "raw", "outcome", F.when(answered, "single").otherwise("none").alias("via"))
    return given.select("custom_id", "raw", F.lit("answered").alias("outcome"), F.lit("batch").alias("via")).unionByName(alone)


def joined(rows: DataFrame, id_: Column, results: DataFrame) -> DataFrame:
    """``rows`` with raw, outcome and via of their request; rows without an answer have a null raw."""
    found = results.select(F.col("custom_id").alias("_id"), "raw", "outcome", "via")
    return rows.withColumn("_id", id_).join(found, "_id", "left").drop("_id")
