"""Scans of remote feeds that Spark plans: a stream whose offsets are change tokens, and a batch scan with one partition per page.

A client is any object that can be pickled; what it fetches is fetched on executors, and only tokens and cursors (a few bytes a feed) pass through the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..storage import exists, open_store
from . import feeds

PAYLOAD = "feed string, source_type string, token string, payload binary, error string"
PAGE = "feed string, page int, payload binary, next int, error string"


class FeedClient(Protocol):
    def feeds(self) -> dict[str, str]:
        """feed -> source type."""

    def token(self, feed: str) -> str | None:
        """The feed's change token (an ETag, or else the time of its last change); None where it has neither."""

    def fetch(self, feed: str) -> bytes: ...


def _said(why: Exception) -> str:
    return f"{type(why).__name__}: {why}"[:200]


class _Changed(DataSourceStreamReader):
    """Offsets: the token of every feed. A feed that can't tell one now keeps its last one; one without tokens is new in every run, and so is one whose
    fetch has failed since, once for each failure that was noted."""

    def __init__(self, client: FeedClient, notes: str):
        self.client, self.notes = client, notes.rstrip("/")
        self.last = self._read("tokens.json") or {}

    def _store(self) -> tuple[fs.FileSystem, str]:
        return open_store(self.notes)

    def _read(self, name: str) -> dict | None:
        store, root = self._store()
        if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(f"{root}/{name}") as f:
            return json.loads(f.read())

    def _write(self, name: str, value: dict) -> None:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(json.dumps(value).encode())

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        run = self._read("run.json") or {"run": 0}
        failed = (self._read("failed.json") or {}).items()

        def token(feed: str) -> str | None:
            try:
                return self.client.token(feed) or f"run {run['run']}"
            except Exception:  # noqa: BLE001 - a feed that is down must not stop the others
                return None

        names = sorted(self.client.feeds())
        with ThreadPoolExecutor(16) as pool:
            now = dict(zip(names, pool.map(token, names), strict=True))
        retry = {feed: f" retry {n}" for feed, n in failed}
        kept = {feed: now[feed] + retry.get(feed, "") if now[feed] is not None else self.last.get(feed) for feed in names}
        return {feed: t for feed, t in kept.items() if t is not None}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        kinds = self.client.feeds()
        return [InputPartition((feed, kinds.get(feed, "rss"), token)) for feed, token in sorted(end.items()) if start.get(feed) != token]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        feed, kind, token = partition.value
        try:
            yield feed, kind, token, self.client.fetch(feed), None
        except Exception as why:  # noqa: BLE001 - told as a row, and fetched again by the next run
            yield feed, kind, token, None, _said(why)

    def commit(self, end: dict) -> None:
        self.last = end
        self._write("tokens.json", end)


def changed_feeds(spark: SparkSession, client: FeedClient, notes: str) -> DataFrame:
    """A stream of the payloads that are new since the checkpoint's last run. ``notes``: a shared folder for tokens and failures, which outlives the stream."""

    class ChangedFeeds(DataSource):
        @classmethod
        def name(cls) -> str:
            return "marquee_changed_feeds"

        def schema(self) -> str:
            return PAYLOAD

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Changed(client, notes)

    spark.dataSource.register(ChangedFeeds)
    return spark.readStream.format("marquee_changed_feeds").load()


def scan_changed(spark: SparkSession, client: FeedClient, path: str) -> DataFrame:
    """One run: what is new at any feed goes to ``path``/payloads (with the number of its batch), and the payloads of all runs so far are returned. Feeds whose fetch
    failed are noted, so that the next run fetches them again though their token is the same."""
    notes = f"{path.rstrip('/')}/notes"
    keeper = _Changed(client, notes)

    def write(batch: DataFrame, number: int) -> None:
        target = f"{path}/payloads/batch={number}"
        batch.write.mode("overwrite").parquet(target)  # a batch that is repeated replaces itself
        told = batch.sparkSession.read.schema(PAYLOAD).parquet(target).select("feed", "token", F.col("error").isNotNull().alias("failed")).collect()  # a token for each changed feed
        known = keeper._read("failed.json") or {}
        keeper._write("failed.json", known | {r.feed: known.get(r.feed, 0) + 1 for r in told if r.failed})
        # Spark commits a batch when the next one begins, which a run may not live to see
        keeper._write("tokens.json", (keeper._read("tokens.json") or {}) | {r.feed: r.token for r in told})

    query = changed_feeds(spark, client, notes).writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    keeper._write("run.json", {"run": (keeper._read("run.json") or {"run": 0})["run"] + 1})
    if not exists(spark, f"{path}/payloads"):
        return spark.createDataFrame([], PAYLOAD + ", batch int")
    return spark.read.schema(PAYLOAD + ", batch int").parquet(f"{path}/payloads")


# ---- paged APIs ----


class PageClient(Protocol):
    def page(self, feed: str, number: int) -> bytes | None:
        """A page's payload; None beyond the last."""


class _Pages(DataSourceReader):
    def __init__(self, client: PageClient, wanted: list[tuple[str, int]], limit: int):
        self.client, self.wanted, self.limit = client, wanted, limit

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((feed, first + k)) for feed, first in self.wanted for k in range(self.limit)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        feed, number = partition.value
        try:
            payload = self.client.page(feed, number)
            if payload is not None:
                yield feed, number, payload, feeds.next_page(json.loads(payload), 0), None
        except Exception as why:  # noqa: BLE001 - one page's failure is its own
            yield feed, number, None, None, _said(why)


def _read_pages(spark: SparkSession, client: PageClient, wanted: list[tuple[str, int]], limit: int) -> DataFrame:
    class PagedApi(DataSource):
        @classmethod
        def name(cls) -> str:
            return "marquee_paged_api"

        def schema(self) -> str:
            return PAGE

        def reader(self, schema) -> DataSourceReader:
            return _Pages(client, wanted, limit)

    spark.dataSource.register(PagedApi)
    return spark.read.format("marquee_paged_api").load()


def scan_pages(spark: SparkSession, client: PageClient, names: list[str], path: str, *, first: int = 1, limit: int = 3) -> DataFrame:
    """One run over the pages of several APIs: at most ``limit`` pages of each feed, from where the last run under ``path`` stopped; returns the pages of all runs
    (feed, page, payload, next, error, run).

    Each (feed, page) is a partition of its own, fetched by executors. What follows a feed's last page, or a page that failed, doesn't count; a feed that failed goes on at
    that page next time, and one that has come to its end has no cursor any more. Cursors are written after the pages, so a run that is killed is repeated as a whole."""
    root = path.rstrip("/")
    cursors = f"{root}/cursors"
    number, wanted = 0, [(feed, first) for feed in names]
    if exists(spark, cursors):
        every = spark.read.schema("feed string, at int, run int").parquet(cursors)
        number = every.agg(F.max("run")).first()[0] + 1
        at = {r.feed: r.at for r in every.groupBy("feed").agg(F.max_by("at", "run").alias("at")).collect()}  # a number for each feed
        wanted = [(feed, at.get(feed, first)) for feed in names if at.get(feed, first) is not None]
    if wanted:
        target = f"{root}/pages/run={number}"
        _read_pages(spark, client, wanted, limit).write.mode("overwrite").parquet(target)
        here = spark.read.schema(PAGE).parquet(target)
        ends = here.groupBy("feed").agg(F.min(F.when(F.col("next").isNull(), F.col("page"))).alias("stop"), F.max("page").alias("top"))
        last = here.join(ends, "feed").where(F.col("page") == F.coalesce("stop", "top")).select("feed", F.when(F.col("error").isNotNull(), F.col("page")).otherwise(F.col("next")).alias("at"))
        missing = spark.createDataFrame(wanted, "feed string, at int").join(here.select("feed").distinct(), "feed", "left_anti").withColumn("at", F.lit(None).cast("int"))
        last.unionByName(missing).write.mode("overwrite").parquet(f"{cursors}/run={number}")
    every = spark.read.schema(PAGE + ", run int").parquet(f"{root}/pages")
    stops = every.groupBy("run", "feed").agg(F.min(F.when(F.col("next").isNull(), F.col("page"))).alias("stop"))
    return every.join(F.broadcast(stops), ["run", "feed"]).where("stop is null or page <= stop").drop("stop")  # stops: a number for each feed and run


def open_feeds(spark: SparkSession, path: str) -> int:
    """Feeds that a next run has pages of."""
    every = spark.read.schema("feed string, at int, run int").parquet(f"{path.rstrip('/')}/cursors")
    return every.groupBy("feed").agg(F.max_by(F.struct("at"), "run").alias("c")).where("c.at is not null").count()


# ---- stand-ins for servers: folders that Spark has written ----


class FolderFeeds:
    """Feeds as folders ``feed=<name>`` of JSON lines; the token tells the names and sizes of their files, the payload is a list of their lines."""

    def __init__(self, folder: str, source_type: str = "scrape"):
        self.folder, self.source_type = folder, source_type

    def _store(self) -> tuple[fs.FileSystem, str]:
        return open_store(self.folder)

    def _files(self, part: str) -> list[fs.FileInfo]:
        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(f"{root}/{part}", allow_not_found=True))
        return sorted((f for f in found if f.is_file and f.base_name.endswith(".json")), key=lambda f: f.base_name)

    def _lines(self, part: str) -> list[bytes]:
        store, _ = self._store()
        out = []
        for info in self._files(part):
            with store.open_input_stream(info.path) as f:
                out += [line for line in f.read().split(b"\n") if line]
        return out

    def feeds(self) -> dict[str, str]:
        store, root = self._store()
        return {f.base_name.removeprefix("feed="): self.source_type for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("feed=")}

    def token(self, feed: str) -> str | None:
        return hashlib.sha256(repr([(f.base_name, f.size) for f in self._files(f"feed={feed}")]).encode()).hexdigest()

    def fetch(self, feed: str) -> bytes:
        return b'{"items":[' + b",".join(self._lines(f"feed={feed}")) + b"]}"


class FolderPages(FolderFeeds):
    """Pages as folders ``feed=<name>/page=<number>`` of JSON lines, an event each."""

    def page(self, feed: str, number: int) -> bytes | None:
        store, root = self._store()
        pages = [int(f.base_name.removeprefix("page=")) for f in store.get_file_info(fs.FileSelector(f"{root}/feed={feed}", allow_not_found=True)) if f.base_name.startswith("page=")]
        if number > max(pages, default=0):
            return None
        more = b"true" if number < max(pages) else b"false"
        return b'{"events":[' + b",".join(self._lines(f"feed={feed}/page={number}")) + b'],"pagination":{"page_number":%d,"has_more_items":%b}}' % (number, more)
