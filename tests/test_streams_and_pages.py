import json
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marquee.operators import feedback
from marquee.sources import scans
from marquee.streaming import folds


def test_seen_keys_are_forgotten_after_their_days(spark, tmp_path):
    """A key that comes back within 14 days is dropped, later it is let through again."""
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(rows):
        spark.createDataFrame(rows, "feed string, ts string").selectExpr("feed", "to_timestamp_ntz(ts) AS ts").write.mode("append").parquet(path)
        stream = folds.dedup(folds.stream_of(spark, path), ["feed"], "ts")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(str(r.ts)[:10] + r.feed for r in spark.read.parquet(out).collect())

    assert run([("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:00:00")]) in (["2024-01-01a"], ["2024-01-02a"])
    assert len(run([("a", "2024-01-10 00:00:00")])) == 1
    run([("b", "2024-02-20 00:00:00")])
    assert "2024-02-21a" in run([("a", "2024-02-21 00:00:00")])


def _page(number, last):
    return json.dumps({"pagination": {"page_number": number, "has_more_items": number < last}, "events": [{"id": str(number), "name": {"text": f"Show {number}"}, "url": f"https://x.example/{number}", "start": {"local": "1998-06-03T19:00:00"}}]}).encode()


class _Api:
    """Pages of several feeds; ``down`` fails."""

    def __init__(self, last, down=()):
        self.last, self.down = last, down

    def page(self, feed, number):
        if (feed, number) in self.down:
            raise OSError("no route")
        return _page(number, self.last[feed]) if number <= self.last[feed] else None


def _titles(pages):
    return sorted((r.feed, r.page, r.run) for r in pages.where("payload is not null").select("feed", "page", "run").collect())


def test_pages_are_read_until_the_last_or_the_limit(spark, tmp_path):
    path, api = str(tmp_path), _Api({"a": 1, "b": 3, "c": 7})
    want = [("a", 1, 0), ("b", 1, 0), ("b", 2, 0), ("b", 3, 0), ("c", 1, 0), ("c", 2, 0), ("c", 3, 0)]
    assert _titles(scans.scan_pages(spark, api, ["a", "b", "c"], path)) == want
    assert scans.open_feeds(spark, path) == 1
    want += [("c", 4, 1), ("c", 5, 1), ("c", 6, 1)]
    assert _titles(scans.scan_pages(spark, api, ["a", "b", "c"], path)) == want
    assert _titles(scans.scan_pages(spark, api, ["a", "b", "c"], path)) == [*want, ("c", 7, 2)]
    assert scans.open_feeds(spark, path) == 0
    assert len(_titles(scans.scan_pages(spark, api, ["a", "b", "c"], path))) == 11  # nothing is left


def test_each_page_is_a_partition(spark):
    df = scans._read_pages(spark, _Api({"a": 9, "b": 9}), [("a", 1), ("b", 4)], 3)
    assert df.rdd.getNumPartitions() == 6


def test_a_failing_api_leaves_the_others_and_goes_on_where_it_failed(spark, tmp_path):
    path = str(tmp_path)
    last = {"good": 2, "bad": 3}
    got = scans.scan_pages(spark, _Api(last, down={("bad", 2)}), ["good", "bad"], path)
    assert _titles(got) == [("bad", 1, 0), ("good", 1, 0), ("good", 2, 0)]
    assert [(r.feed, r.page) for r in got.where("error is not null").collect()] == [("bad", 2)]
    got = scans.scan_pages(spark, _Api(last), ["good", "bad"], path)
    assert _titles(got) == [("bad", 1, 0), ("bad", 2, 1), ("bad", 3, 1), ("good", 1, 0), ("good", 2, 0)]


class _Server:
    """Feeds whose tokens and payloads are files, so that runs see what tests change; a payload ``broken`` fails to be fetched."""

    def __init__(self, folder):
        self.folder = str(folder)

    def _file(self, name):
        with open(f"{self.folder}/{name}") as f:
            return f.read()

    def feeds(self):
        return {n.removesuffix(".payload"): "rss" for n in os.listdir(self.folder) if n.endswith(".payload")}

    def token(self, feed):
        if os.path.exists(f"{self.folder}/{feed}.down"):
            raise OSError("no route")
        return self._file(f"{feed}.etag") or None

    def fetch(self, feed):
        if self._file(f"{feed}.payload") == "broken":
            raise OSError("cut off")
        return self._file(f"{feed}.payload").encode()


def test_only_changed_feeds_are_fetched(spark, tmp_path):
    server = tmp_path / "server"
    server.mkdir()

    def put(feed, etag, payload):
        (server / f"{feed}.etag").write_text(etag)
        (server / f"{feed}.payload").write_text(payload)

    def run():
        rows = scans.scan_changed(spark, _Server(server), str(tmp_path / "scan")).collect()
        last = max(r.batch for r in rows)
        return last, {r.feed: None if r.payload is None else bytes(r.payload).decode() for r in rows if r.batch == last}

    put("a", "1", "A"), put("b", "1", "B"), put("c", "1", "broken"), put("n", "", "N")
    assert run() == (0, {"a": "A", "b": "B", "c": None, "n": "N"})
    put("a", "2", "A2"), put("c", "1", "C"), put("d", "1", "D")
    (server / "b.down").write_text("")  # a feed that can't tell its token is no new one
    # changed, new, failed before, and without a token
    assert run() == (1, {"a": "A2", "c": "C", "d": "D", "n": "N"})
    (server / "b.down").unlink()
    assert run() == (2, {"n": "N"})
    put("n", "9", "N9")
    assert run() == (3, {"n": "N9"})
    assert run() == (3, {"n": "N9"})  # nothing new, no batch


def test_a_seen_entry_comes_back_when_its_days_are_over(spark, tmp_path):
    """Runs on one state, with a clock that moves by what has arrived. What is held back doesn't prolong the days."""
    path = str(tmp_path)

    def run(rows):
        spark.createDataFrame(rows, "feed string, entry string, arrived_at string").withColumn("arrived_at", F.to_timestamp_ntz("arrived_at")).write.mode("append").parquet(f"{path}/in")
        stream = folds.stream_of(spark, f"{path}/in")
        return sorted(((r.feed, r.entry, str(r.arrived_at)[5:10]) for r in folds.run_to_end(folds.unseen(stream, ["feed", "entry"], "arrived_at"), "unseen", path).collect()), key=str)

    want = [("a", "x", "01-01"), ("a", "y", "01-02"), ("b", "x", "01-01")]
    assert run([("a", "x", "2024-01-09"), ("a", "x", "2024-01-01"), ("b", "x", "2024-01-01"), ("a", "y", "2024-01-02"), (None, None, None)]) == want
    # twelve days after the first: held back, though six after the second
    assert run([("a", "x", "2024-01-13")]) == want
    want = sorted([*want, ("a", "x", "01-15"), ("a", "x", "02-03")], key=str)
    assert run([("a", "x", "2024-01-15"), ("a", "x", "2024-01-28"), ("a", "x", "2024-02-03")]) == want
    # null keys are keys; ten days later, a and b are long over and their state is gone
    assert len(run([(None, "z", "2024-02-10"), (None, "z", "2024-02-12")])) == len(want) + 1
    run([("late", "x", "2024-03-20")])
    kept = spark.read.format("statestore").option("stateVarName", "until").load(f"{path}/state")
    assert kept.count() == 1


def test_weights_are_kept_in_state_and_only_changes_are_written(spark, tmp_path):
    path, rng = str(tmp_path), random.Random(4)
    rows = [(k, f"u{rng.randrange(30)}", rng.choice([1, 2, None]), datetime(2024, 1, 1) + timedelta(minutes=k), rng.choice(["click", "negative"])) for k in range(400)]
    schema = "event_id long, user string, category int, ts timestamp_ntz, signal string"
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    for part in (rows[:390], rows[390:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        got = folds.fold_stream(folds.stream_of(spark, f"{path}/in"), ["user", "category"], now, path=path)
    want = feedback.fold_weights(spark.createDataFrame(rows, schema), ["user", "category"], now)
    table = lambda df: {(r.user, r.category): (round(r.weight, 9), r.n_signals) for r in df.collect()}
    a, b = table(got), table(want)
    assert {k: (a.get(k), b.get(k)) for k in a.keys() | b.keys() if a.get(k) != b.get(k)} == {}
    # the second batch wrote the keys of its own ten signals, not the table
    written = spark.read.parquet(f"{path}/changes").count()
    assert written == len({(u, c) for _, u, c, _, _ in rows[:390]}) + len({(u, c) for _, u, c, _, _ in rows[390:]})
