import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marquee.llm import sharding


SF = "/root/testdata/sf0.001"


def _shards(df, shards, **options):
    rows = sharding.shard_documents(df, shards, **options).collect()
    sizes, slots = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + len((r.text or "").encode()) + 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(shards))
    return rows, sizes


def test_sizes_are_near_equal_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(k, "copy of one text " * 3 if k % 3 == 0 else "é" * rng.randrange(0, 200)) for k in range(3000)]
    rows += [(None, None), (None, None), (7, "y" * 50), (7, "y" * 50), (-(2**63) + 5, "low"), (2**63 - 1, "high")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("shard", F.lit("old"))
    got, sizes = _shards(df, 8)
    assert len(got) == len(rows)
    total = sum(sizes.values())
    assert max(abs(s - total / 8) for s in sizes.values()) <= 0.005 * total / 8 * 2 + 402
    texts = {}
    for r in got:
        texts.setdefault(r.text, set()).add(r.shard)
    # only the hot group spans several shards, and they follow each other
    spread = sorted(texts["copy of one text " * 3])
    assert spread == list(range(spread[0], spread[-1] + 1))
    kept, many = _shards(df, 8, task_bytes=2000)
    assert many == sizes
    for rows in (got, kept):
        _in_order(spark, rows, df.schema)


def _in_order(spark, rows, schema):
    """Shards and slots follow one order: that of the text's hash, then of the id's."""
    h = spark.createDataFrame([(k, r.doc_id, r.text) for k, r in enumerate(rows)], "k long, doc_id long, text string").select("k", sharding.hash_key(F.col("text")).alias("key"), sharding.hash_key(F.col("doc_id")).alias("tie"))
    place = {r.k: (r.key, r.tie) for r in h.collect()}
    in_order = [place[k] for k, r in sorted(enumerate(rows), key=lambda x: (x[1].shard, x[1].slot))]
    assert in_order == sorted(in_order)


def test_rows_that_cannot_be_told_apart_are_split(spark):
    rows = [(k, f"text {k}") for k in range(200)] + [(None, "one text " * 5)] * 1000 + [(5, "another " * 12)] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({}, {"task_bytes": 2000}):
        got, sizes = _shards(df, 16, **options)
        assert sorted(map(str, got)) and len(got) == len(rows) and len(sizes) == 16
        total = sum(sizes.values())
        assert max(abs(s - total / 16) for s in sizes.values()) <= 0.01 * total / 16 + 2 * 97
        _in_order(spark, got, df.schema)


def test_one_very_long_text(spark):
    df = spark.createDataFrame([(0, "x" * 3_000_000), *((k, "y" * 100) for k in range(1, 400))], "doc_id long, text string")
    got, sizes = _shards(df, 4, task_bytes=1000)
    assert len(got) == 400 and max(sizes.values()) < 3_000_001 + 101 * 400


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query(spark):
    rows = sharding.op6_histogram_sort(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    by_shard = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        by_shard.setdefault(r.shard, []).append(r)
    assert sorted(by_shard) == list(range(16)) and all(sorted(x.slot for x in s) == list(range(len(s))) for s in by_shard.values())
    sizes = [sum(x["size"] for x in s) for s in by_shard.values()]
    largest = max(r["size"] for r in rows)
    assert max(abs(s - sum(sizes) / 16) for s in sizes) <= 0.01 * sum(sizes) / 16 + 2 * largest


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    assert len(_shards(df, 16)[0]) == 3
    assert sharding.shard_documents(df.limit(0)).count() == 0
