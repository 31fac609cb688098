"""Greatest cosine of each candidate with a set of liked vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage

#: liked vectors that go to the executors at once, and candidates that a task compares with them at once
BLOCK, SLICE = 4096, 512


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms == 0, 1, norms)


def _blocks(vectors: DataFrame) -> Iterator[list]:
    rows = []
    for r in vectors.toLocalIterator():
        rows.append(r[0])
        if len(rows) == BLOCK:
            yield rows
            rows = []
    if rows:
        yield rows


def max_cosine(candidates: DataFrame, liked: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id_col, similarity): 0 where nothing is liked, or a vector is null, empty, zero or of another length.

    Liked vectors are read a block at a time; each candidate passes a block in one scan, whose result is staged before the next block is
    read. So one block is on the driver and the executors at once, and a scan has one Python operator, however many are liked."""
    frame = candidates.select(id_col, vector_col, F.lit(0.0).alias("similarity"), F.lit(False).alias("seen"))
    schema = ", ".join(f"`{n}` {t}" for n, t in frame.dtypes)
    for number, block in enumerate(_blocks(liked.select(vector_col).where(F.size(vector_col) > 0))):
        if number:
            frame = stage(frame, "similarity")
        by_length: dict[int, list] = {}
        for v in block:
            if None not in v:
                by_length.setdefault(len(v), []).append(v)
        shared = candidates.sparkSession.sparkContext.broadcast({n: _unit(v) for n, v in by_length.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
                vectors, best, seen = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).copy(), np.array(batch.column(3).to_pylist(), bool)
                groups: dict[int, list[int]] = {}
                for k, v in enumerate(vectors):
                    if v and None not in v and len(v) in shared.value:
                        groups.setdefault(len(v), []).append(k)
                for n, at in groups.items():
                    top = (_unit([vectors[k] for k in at]) @ shared.value[n].T).max(axis=1)
                    best[at] = np.where(seen[at], np.maximum(best[at], top), top)
                    seen[at] = True
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best), pa.array(seen)], names=batch.schema.names)

        frame = frame.mapInArrow(run, schema)
    return frame.select(id_col, "similarity")
