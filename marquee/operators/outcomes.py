"""Answers of expensive services as rows with an outcome: what was answered, what failed and how often it was asked.

A run appends its outcomes to a table in the shared folder; the next run reads it, leaves alone what is answered, and asks what failed before what is new.
Calls are dealt over tasks that share one rate: each has its own slots in a common schedule.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists
from .enrich import Strategy, Unavailable

OUTCOME = "prompt string, outcome string, raw string, attempts int, error string"


def paced(per_second: float, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> Callable[[], None]:
    """A function that waits for its task's next slot, for use in a barrier stage. The n-th call of the p-th of P tasks is due n * P + p slots after all tasks have
    started, and a task that is late moves its later slots on instead of catching up, so that all tasks together never make more than ``per_second``
    calls in a second, give or take the spread of the workers' clocks."""
    context = BarrierTaskContext.get()
    started = max(float(t) for t in context.allGather(repr(clock())))
    tasks, slot = len(context.getTaskInfos()), 1 / per_second
    due = [started + context.partitionId() * slot]

    def wait() -> None:
        late = clock() - due[0]
        if late < 0:
            sleep(-late)
        due[0] = max(due[0], due[0] + late) + tasks * slot

    return wait


def ask(prompts: DataFrame, strategy: Strategy, *, attempts: int = 3, first_delay: float = 1.0, per_second: float | None = None, parallel: int = 4, order: str | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(prompt, outcome, raw, attempts, error) for each row of ``prompts``: outcome is answered, or failed after so many attempts, each waiting twice as
    long as the one before. ``Unavailable`` is an outcome as well, and after it a task asks nothing more: unasked prompts come back as skipped.

    ``per_second`` holds for all attempts of all tasks together: they run as a barrier stage of ``parallel`` tasks, which needs as many free cores.
    ``order``: a column by which each task asks its prompts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wait = paced(per_second, sleep=sleep) if per_second else lambda: None
        down = None
        for pdf in batches:
            out = []
            for prompt in pdf["prompt"]:
                outcome, raw, tried, error = "skipped", None, 0, down
                while down is None and outcome != "answered" and tried < attempts:
                    if tried:
                        sleep(first_delay * 2 ** (tried - 1))
                    wait()
                    tried += 1
                    try:
                        raw, outcome, error = strategy(prompt), "answered", None
                    except Unavailable as why:
                        down = error = f"{type(why).__name__}: {why}"[:200]
                        outcome = "failed"
                    except Exception as why:  # noqa: BLE001 - one failed answer must not stop the others
                        outcome, error = "failed", f"{type(why).__name__}: {why}"[:200]
                out.append((prompt, outcome, raw, tried, error))
            yield pd.DataFrame(out, columns=["prompt", "outcome", "raw", "attempts", "error"])

    asked = prompts.repartition(parallel) if per_second else prompts
    if order:
        asked = asked.sortWithinPartitions(order, "prompt")
    return asked.select("prompt").mapInPandas(run, OUTCOME, barrier=bool(per_second))


def last_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, outcome, raw, attempts, error, run): one row for each prompt that any run has asked, its attempts added up. An answer is final; else the last run's outcome stands."""
    schema = OUTCOME + ", run int"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    every = spark.read.schema(schema).parquet(path)
    rank = F.struct((F.col("outcome") == "answered").cast("int").alias("final"), "run")
    best = every.groupBy("prompt").agg(F.max_by(F.struct("outcome", "raw", "error", "run"), rank).alias("o"), F.sum("attempts").cast("int").alias("attempts"))
    return best.select("prompt", "o.outcome", "o.raw", "attempts", "o.error", "o.run")


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """What was asked and is not answered."""
    return last_outcomes(spark, path).where("outcome <> 'answered'")


def run(prompts: DataFrame, strategy: Strategy, path: str, *, wave: int | None = None, max_failures: int | None = None, **how) -> DataFrame:
    """One run: asks what of ``prompts`` (prompt) the table under ``path`` has no answer for and returns ``last_outcomes`` afterwards. Null prompts are left out,
    equal ones asked once.

    What failed before is asked first, in a wave of its own; ``wave`` deals the rest into waves of about so many prompts. Each wave's outcomes are
    written before the next begins, so a run that is killed has lost one wave at most, and no answer is paid for twice. When more than
    ``max_failures`` prompts of this run, over all tasks, have failed, it stops with ``Unavailable``; what it has is kept."""
    spark = prompts.sparkSession
    before = last_outcomes(spark, path)
    number = (before.agg(F.max("run")).first()[0] or 0) + 1
    wanted = prompts.select("prompt").where("prompt is not null").distinct()
    open_ = wanted.join(before.select("prompt", "outcome"), "prompt", "left").where("outcome is null or outcome <> 'answered'")
    fresh = open_.where("outcome is null").select("prompt")
    waves = [open_.where("outcome is not null").select("prompt")]
    parts = -(-fresh.count() // wave) if wave else 1
    waves += [fresh.where(F.pmod(F.xxhash64("prompt"), F.lit(parts)) == k) if parts > 1 else fresh for k in range(parts)]
    failed = 0
    for k, letters in enumerate(waves):
        target = f"{path.rstrip('/')}/run={number}/wave={k}"
        ask(letters, strategy, **how).withColumn("run", F.lit(number)).write.mode("overwrite").parquet(target)
        failed += spark.read.schema(OUTCOME).parquet(target).where("outcome <> 'answered'").count()
        if max_failures is not None and failed > max_failures:
            raise Unavailable(f"{failed} prompts without an answer after wave {k} of run {number}")
    return last_outcomes(spark, path)


def join_outcomes(rows: DataFrame, prompt: Column, outcomes: DataFrame) -> DataFrame:
    """``rows`` with the outcome, raw answer and attempts of their prompt; null where it was never asked."""
    found = outcomes.select(F.col("prompt").alias("_prompt"), "outcome", "raw", "attempts")
    return rows.withColumn("_prompt", prompt).join(found, "_prompt", "left").drop("_prompt")
