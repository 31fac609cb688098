"""Sinks: JSON artifacts, append-only and keyed Parquet tables, JSON-lines logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import upsert
from ..storage import drop_path, exists

LOG = "ts timestamp, run_id string, agent string, level string, message string, data string"


def write_json(one_row: DataFrame, path: str) -> None:
    """A small artifact (funnel, error, checkpoint, probe) as one JSON file."""
    one_row.coalesce(1).write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    """Feedback, history: rows are only ever added."""
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def _folders(spark: SparkSession, root: str) -> dict[int, bool]:
    """Number of each snapshot under a root -> whether its write was committed (Spark's own marker)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return {}
    names = [f.getPath().getName() for f in store.listStatus(path)]
    return {int(n[2:]): exists(spark, f"{root}/{n}/_SUCCESS") for n in names if n.startswith("n=")}


def snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The last committed snapshot of a keyed table; no rows before the first. Writes that failed, or that are still going on, aren't seen."""
    done = [n for n, ok in _folders(spark, root).items() if ok]
    return spark.read.schema(schema).parquet(f"{root}/n={max(done)}") if done else spark.createDataFrame([], schema)


def publish(rows: DataFrame, root: str) -> int:
    """Write ``rows`` as the next snapshot, in a folder of its own, and return its number. It counts once all its tasks are committed; until then, and if
    the write fails, readers keep the snapshot before."""
    number = max(_folders(rows.sparkSession, root), default=-1) + 1
    rows.write.mode("errorifexists").parquet(f"{root}/n={number}")
    return number


def merge_into(root: str, new: DataFrame, keys: list[str], order: str) -> int:
    """Publish the table after the writes of ``new``: for each key the row that is last by ``order``, old or new."""
    old = snapshot(new.sparkSession, root, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields))
    return publish(upsert(old, new, keys, order), root)


def retain(spark: SparkSession, root: str, keep: int = 3) -> list[int]:
    """Remove all but the last ``keep`` committed snapshots, and what failed writes left before the last of these; returns the numbers that are left."""
    if keep < 1:
        raise ValueError("keep is 1 or more")
    found = _folders(spark, root)
    kept = sorted(n for n, ok in found.items() if ok)[-keep:]
    for n, ok in found.items():
        if kept and (n < kept[0] if ok else n < kept[-1]):
            drop_path(spark, f"{root}/n={n}")
    return kept


def write_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("run_id").json(path)


def read_log(spark: SparkSession, path: str, agent: str | None = None, level: str | None = None) -> DataFrame:
    """Log lines; lines that aren't JSON are left out. Filters go to the scan, runs are partitions."""
    rows = spark.read.schema(LOG + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null").drop("_bad")
    for column, wanted in (("agent", agent), ("level", level)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    return rows


def prune(rows: DataFrame, ts: Column, now: Column, days: int = 90) -> DataFrame:
    """What is kept of a log after pruning."""
    return rows.where(ts >= now - F.make_dt_interval(days=F.lit(days)))
