import os
import random

import numpy as np
import pytest
import xxhash

from marquee.llm import common, simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "Two Words", "ÀB c\u00a0d É É É", "a b c d e f " * 60, "x\x1cy z\x0bq R"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_manhattan_is_a_lower_bound_and_cells_reach():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300, dtype=np.int64)
    for bits in (1, 2, 3):
        b = a.copy()
        for _ in range(bits):
            b ^= np.int64(1) << rng.integers(0, 63, len(a)).astype(np.int64)
        ham = np.bitwise_count((a ^ b).view(np.uint64))
        assert (simhash.manhattan(simhash.popcounts(a), simhash.popcounts(b)) <= ham).all()


def _components(fps, bits=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def _texts():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(50)]
    out = [None, "", "  ", "same text here now", "same text here now", None]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(120)]
        out.append(" ".join(base))
        for _ in range(4):
            changed = list(base)
            changed[rng.randrange(120)] = "changed"
            out.append(" ".join(changed))
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates(spark, block):
    texts = _texts()
    rows = [(k if k != 5 else None, t, "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df, block=block).collect()
    roots = _components([slow_fingerprint(t) for t in texts])
    least = {}
    for k, r in enumerate(roots):
        if k != 5:
            least[r] = min(least.get(r, k), k)
    want = sorted((-1 if k == 5 else k, least[r]) for k, r in enumerate(roots))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component) for r in got) == want


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "x y z q w"), (None, "x y z q w")], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 4
    assert sorted(str(r.doc_id) for r in simhash.representatives(df).collect()) == ["1", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.representatives(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    long = " ".join(f"w{k % 997}" for k in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.fp, r.component) for r in simhash.near_duplicates(df).collect()}
    assert got[1][0] & (2**64 - 1) == simhash.fingerprint(long.encode()) and got[2][1] == 1 and got[3][1] == 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    fps = [slow_fingerprint(t) for _, t in docs]
    least = {}
    roots = _components(fps)
    for (k, _), r in zip(docs, roots):
        least[r] = min(least.get(r, k), k)
    want = [(k, f"{fp & (2**64 - 1):016x}", least[r]) for (k, _), fp, r in zip(docs, fps, roots)]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, SF).collect()) == want


@pytest.mark.parametrize("finish", [1_000_000, 0])
def test_components_on_paths_and_stars(spark, finish):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 30)] + [(500, 501), (501, 500), (7, 7)]
    rng.shuffle(edges)
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges] + [(None, 3)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long").repartition(7), finish_edges=finish).collect())
    want = {k: 0 for k in range(61)} | {100 + k: 100 for k in range(30)} | {500: 500, 501: 500}
    assert got == want
