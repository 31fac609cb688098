"""Batches that are answered later, outcomes that outlive a run, and calls that share one rate."""

import glob
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marquee.operators import enrich, outcomes
from marquee.sources import sinks
from marquee.streaming import batches, folds


def _answer(prompt):
    if prompt.endswith("7"):
        raise ValueError("no answer")
    return f"<{prompt}>"


def _requests(spark, n=40):
    return spark.range(n).select(F.concat(F.lit("id"), "id").alias("custom_id"), F.concat(F.lit("prompt "), "id").alias("prompt"))


def _single(prompt):
    if prompt.endswith("17"):
        raise ValueError("never")
    return f"<{prompt}>"


def _check(found, n=40):
    rows = {r.custom_id: r for r in found.collect()}
    assert len(rows) == found.count() == n
    for k in range(n):
        r = rows[f"id{k}"]
        assert (r.outcome, r.raw) == (("failed", None) if k % 100 == 17 else ("answered", f"<prompt {k}>"))
    return Counter(r.via for r in rows.values())


def test_batches_are_polled_until_they_are_ready(spark, tmp_path):
    service = batches.FolderService(f"{tmp_path}/service", _answer, polls=lambda b: 1 + b % 3, fails=lambda b: b == 1)
    how = dict(size=10, interval_seconds=0.3, trigger="300 milliseconds", how={"attempts": 1}, timeout=120)
    via = _check(batches.complete(_requests(spark), service, str(tmp_path), _single, **how))
    assert via["batch"] > 15 and via["single"] >= 3 and via["none"] == 1
    polls = [len(glob.glob(f"{tmp_path}/service/{b}.poll*")) for b in range(4)]
    assert polls == [1, 2, 3, 1]
    # a second call finds everything answered and asks for nothing
    before = sorted(os.listdir(f"{tmp_path}/service"))
    assert _check(batches.complete(_requests(spark), service, str(tmp_path), _single, **how)) == via
    assert sorted(os.listdir(f"{tmp_path}/service")) == before


def test_a_stream_that_is_killed_goes_on_and_submits_nothing_twice(spark, tmp_path):
    path = str(tmp_path)
    slow = batches.FolderService(f"{path}/service", _answer, polls=lambda b: 1 if b == 0 else 10**6)
    batches.deal(_requests(spark), 10).repartition("batch").write.parquet(f"{path}/requests")
    with folds.rocks(spark):
        query = batches.poll_stream(spark, path, slow, interval_seconds=0.3, trigger="300 milliseconds")
        end = time.monotonic() + 90
        while time.monotonic() < end and not (batches.answers(spark, path).count() and glob.glob(f"{path}/service/1.poll1")):
            time.sleep(0.3)
        query.stop()
    assert {r.batch for r in batches.answers(spark, path).select("batch").distinct().collect()} == {0}
    ready = batches.FolderService(f"{path}/service", _answer)
    found = batches.complete(_requests(spark), ready, path, _single, size=10, interval_seconds=0.3, trigger="300 milliseconds", how={"attempts": 1}, timeout=120)
    _check(found)
    assert all(len(glob.glob(f"{path}/service/{b}.submit*")) == 1 for b in range(4))


def test_batches_that_are_never_ready_expire(spark, tmp_path):
    never = batches.FolderService(f"{tmp_path}/service", _answer, polls=lambda b: 10**6)
    found = batches.complete(_requests(spark, 9), never, str(tmp_path), _single, size=5, interval_seconds=0.2, max_polls=2, trigger="200 milliseconds", how={"attempts": 1}, timeout=120)
    assert _check(found, 9) == {"single": 9}
    assert {r.state for r in batches.answers(spark, str(tmp_path)).collect()} == {"expired"}


def test_requests_without_id_or_prompt_and_repeated_ones(spark):
    rows = [("a", "x"), ("a", "x"), (None, "x"), ("b", None)]
    assert batches.deal(spark.createDataFrame(rows, "custom_id string, prompt string"), 10).drop("batch").collect() == [("a", "x")]
    assert batches.deal(spark.createDataFrame([], "custom_id string, prompt string"), 10).count() == 0


class _Flaky:
    """Fails for prompts that end with one of ``bad``; notes each call as a file."""

    def __init__(self, folder, bad, why=ValueError):
        self.folder, self.bad, self.why = folder, bad, why

    def __call__(self, prompt):
        open(f"{self.folder}/{prompt}.{time.time_ns()}", "w").close()
        if prompt.endswith(self.bad):
            raise self.why("not now")
        return prompt.upper()

    def calls(self):
        return Counter(os.path.basename(f).split(".")[0] for f in glob.glob(f"{self.folder}/*"))


def _prompts(spark, n):
    return spark.range(n).select(F.concat(F.lit("p"), "id").alias("prompt"))


def test_the_next_run_asks_what_failed_and_what_is_new(spark, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir(), second.mkdir()
    one, two = _Flaky(str(first), ("3", "5")), _Flaky(str(second), ("5",))
    path = f"{tmp_path}/outcomes"
    got = outcomes.run(_prompts(spark, 10).union(_prompts(spark, 10)), one, path, attempts=2, first_delay=0.0)
    assert {r.prompt for r in got.where("outcome = 'failed'").collect()} == {"p3", "p5"} == {r.prompt for r in outcomes.dead_letters(spark, path).collect()}
    assert one.calls() == {f"p{k}": 2 if k in (3, 5) else 1 for k in range(10)}
    got = {r.prompt: r for r in outcomes.run(_prompts(spark, 12), two, path, attempts=2, first_delay=0.0).collect()}
    assert two.calls() == {"p3": 1, "p5": 2, "p10": 1, "p11": 1}
    assert (got["p3"].outcome, got["p3"].attempts, got["p3"].raw) == ("answered", 3, "P3")
    assert (got["p5"].outcome, got["p5"].attempts) == ("failed", 4) and got["p5"].error.startswith("ValueError")
    assert got["p0"].run == 1 and got["p11"].run == 2
    assert os.path.isdir(f"{path}/run=2/wave=0") and spark.read.parquet(f"{path}/run=2/wave=0").count() == 2  # dead letters first


def test_too_many_failures_stop_the_run_between_waves(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    path = f"{tmp_path}/outcomes"
    with pytest.raises(enrich.Unavailable, match="without an answer"):
        outcomes.run(_prompts(spark, 200), _Flaky(str(calls), tuple("0123456789")), path, wave=20, max_failures=5, attempts=1)
    assert outcomes.last_outcomes(spark, path).count() < 100
    assert outcomes.run(_prompts(spark, 200), str.upper, path, wave=50).where("outcome = 'answered'").count() == 200


def test_what_is_down_is_not_asked_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    got = outcomes.ask(_prompts(spark, 30).coalesce(1), _Flaky(str(calls), tuple("0123456789"), enrich.Unavailable), attempts=3, first_delay=0.0)
    kinds = Counter(r.outcome for r in got.collect())
    assert kinds == {"failed": 1, "skipped": 29} and sum(_Flaky(str(calls), ()).calls().values()) == 1


def test_delays_double(spark):
    class Recorder:
        def __call__(self, seconds):
            raise RuntimeError(f"slept {seconds}")

    # a sleep that raises ends the task: the first delay is seen in its error
    with pytest.raises(Exception, match="slept 2.0"):
        outcomes.ask(_prompts(spark, 1), _Flaky("/nowhere", ()), attempts=3, first_delay=2.0, sleep=Recorder()).collect()


def test_four_tasks_share_one_rate(spark):
    got = outcomes.ask(_prompts(spark, 32), lambda p: repr(time.time()), per_second=8, parallel=4).collect()
    times = sorted(float(r.raw) for r in got)
    assert len(times) == 32
    assert all(b - a > 0.9 for a, b in zip(times, times[8:])), times  # noqa: B905 - never nine within a second
    assert times[-1] - times[0] < 10
    # with failures too: attempts count
    def flaky(p):
        raise ValueError(repr(time.time()))

    rows = outcomes.ask(_prompts(spark, 8), flaky, per_second=8, parallel=4, attempts=2, first_delay=0.0).collect()
    assert all(r.attempts == 2 and r.outcome == "failed" for r in rows)


def test_empty_and_null_prompts(spark, tmp_path):
    df = spark.createDataFrame([(None,)], "prompt string")
    assert outcomes.run(df, str.upper, f"{tmp_path}/none").count() == 0
    joined = outcomes.join_outcomes(df, F.col("prompt"), outcomes.last_outcomes(spark, f"{tmp_path}/none"))
    assert joined.collect() == [(None, None, None, None)]


def test_a_failed_write_leaves_the_last_snapshot(spark, tmp_path):
    root, schema = f"{tmp_path}/table", "k int, v string, at int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    read = lambda: sorted(tuple(r) for r in sinks.snapshot(spark, root, schema).collect())
    assert read() == []
    assert sinks.merge_into(root, rows((1, "a", 1), (2, "b", 1)), ["k"], "at") == 0
    with pytest.raises(Exception, match="(?i)divide|zero|boom"):
        sinks.publish(rows((9, "x", 9)).withColumn("v", F.raise_error(F.lit("boom")).cast("string")), root)
    assert read() == [(1, "a", 1), (2, "b", 1)]
    assert sinks.merge_into(root, rows((1, "late", 0), (2, "c", 2), (3, "d", 1)), ["k"], "at") == 2
    assert read() == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
    assert sinks.merge_into(root, rows((4, "e", 1)), ["k"], "at") == 3
    assert sinks.retain(spark, root, keep=2) == [2, 3]
    assert sorted(os.listdir(root)) == ["n=2", "n=3"]
    assert read() == [(1, "a", 1), (2, "c", 2), (3, "d", 1), (4, "e", 1)]
    with pytest.raises(ValueError):
        sinks.retain(spark, root, keep=0)
