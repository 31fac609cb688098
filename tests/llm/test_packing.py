import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import packing

SF = "/root/testdata/sf0.001"


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 60).flatmap(lambda cap: st.tuples(st.just(cap), st.dictionaries(st.integers(1, cap), st.integers(1, 40), max_size=25))))
def test_plan_places_everything(case):
    cap, histogram = case
    seen = {}
    runs = packing.plan(histogram, cap)
    for n, holds in runs:
        assert n > 0 and sum(s * k for s, k in holds) <= cap
        assert sum(k for s, k in holds if 3 * s > cap) <= 2
        for s, k in holds:
            seen[s] = seen.get(s, 0) + n * k
    assert seen == histogram
    total = sum(s * n for s, n in histogram.items())
    assert sum(n for n, _ in runs) <= max(1, 2 * -(-total // cap)) or not histogram


def _check(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pack_against_whole_encoding(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    texts = [None, "", "one", "E.T. don't; I'LL é, é́. ÜBER\tx  y\u00a0z", "<|endoftext|> a,b 12. a1.", "word " * 200, "Long-er, text. " * 37, "x" * 3000, "same", "same"]
    df = spark.createDataFrame([(k if k else None, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, rank string").repartition(3)
    rows = packing.pack(df, path, capacity=64, with_ids=True).collect()
    want = []
    for k, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(k or None, p, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes()), ids[at : at + 64].tolist()) for p, at in enumerate(range(0, len(ids), 64))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    used = _check(rows, 64)
    assert used <= sum(r.length for r in rows) // 64 + 3
    filled = packing.fill(packing.pack(df, path, capacity=64, with_ids=True)).collect()
    assert sum(len(r.ids) for r in filled) == sum(r.length for r in rows) and max(len(r.ids) for r in filled) <= 64


def test_pack_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.default_tokenizer()).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_against_whole_encoding(spark):
    """Pieces by encoding whole texts; places are gapless, within the capacity, and as few as the lengths allow but for one in a hundred."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.op3_packing(spark, SF).collect()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, p, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for p, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert _check(rows, 4096) <= 1.01 * sum(r.length for r in rows) / 4096 + 1


def test_ties_and_repeated_rows_have_places_of_their_own(spark):
    df = spark.createDataFrame([(k % 3, "same words here") for k in range(400)], "doc_id long, text string").repartition(6)
    rows = packing.pack(df, packing.default_tokenizer(), capacity=16).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 400
    _check(rows, 16)
