"""Shared parts of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.groups import bounded_groups, components, heavy_join, join_few, union_find
from ..storage import drop, drop_path, fresh_path, shared_dir, stage

__all__ = ["binary_list", "bounded_groups", "components", "drop", "drop_path", "fresh_path", "heavy_join", "in_slices", "join_few", "running_base", "shared_dir", "stage", "table", "tidy", "union_find"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


_libc = None


def tidy() -> None:
    """Give what a finished task has freed back to the system: workers stay for later tasks, and share an executor's memory."""
    global _libc
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        _libc = _libc or ctypes.CDLL("libc.so.6")
        _libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_slices(run, rows: int = 256):
    """A function over record batches that is handed ``rows`` rows at a time, so that what it builds of a batch stays small,
    and that tidies up after the task."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows)

        try:
            yield from run(parts())
        finally:
            tidy()

    return sliced


def binary_list(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column, without a decoding step."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def running_base(counts: DataFrame, group: str, part: str, n: str) -> DataFrame:
    """For each (group, part) the number of rows of that group in smaller parts; ``counts`` has one row each."""
    w = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(group, part, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long").alias("base"))
