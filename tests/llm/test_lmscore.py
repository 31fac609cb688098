import math
import os
import random
import re
from collections import Counter

import pytest

from marquee.llm import lmscore

SF = "/root/testdata/sf0.001"


def _brute(docs, wanted, delta=0.5):
    """Scores of (id, text) rows by plain counting, in order."""
    words = [re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    steps = [list(zip([None, *ws], ws)) for ws in words]
    kinds = max(1, len({w for ws in words for w in ws}))
    both = []
    for side in ([k in wanted for k, _ in docs], [True] * len(docs)):
        pairs = Counter(p for s, use in zip(steps, side) if use for p in s)
        before = Counter(p[0] for s, use in zip(steps, side) if use for p in s)
        both.append((pairs, before))
    (tp, tc), (bp, bc) = both
    a = delta * (sum(tc.values()) / sum(bc.values()) if tc else 1)
    value = lambda v, w: math.log((tp[v, w] + a) / (tc[v] + a * kinds)) - math.log((bp[v, w] + delta) / (bc[v] + delta * kinds))
    return [(k, len(s), sum(value(*p) for p in s) / len(s) if s else 0.0) for (k, _), s in zip(docs, steps)]


def _same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 7))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(math.isclose(x[2], y[2], rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(got, want))


@pytest.mark.parametrize("options", [{}, {"hot_words": 3, "broadcast_ids": 1}, {"hot_words": 0, "hot_share": 20}, {"delta": 0.01}])
def test_against_brute_force(spark, options):
    rng = random.Random(6)
    vocabulary = "aa bb cc Dd ee ff gg é日本".split()
    docs = [(k, " ".join(rng.choice(vocabulary) + rng.choice(["", ","]) for _ in range(rng.randrange(0, 60)))) for k in range(300)]
    docs += [(400, None), (401, "rare words only"), (402, ""), (None, "aa bb"), (403, "aa bb " * 500_00), docs[7], docs[7], (8, "another text of eight")]
    wanted = {k for k in range(300) if k % 3 == 0}
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, target string, n int").repartition(3)
    ids = spark.createDataFrame([(k,) for k in wanted] + [(None,), (0,)], "doc_id long")
    got = lmscore.cross_entropy_difference(df, ids, **options)
    assert got.columns == ["doc_id", "n_tokens", "score"]
    _same(got.collect(), _brute(docs, wanted, options.get("delta", 0.5)))


def test_no_target_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    _same(lmscore.cross_entropy_difference(df, none).collect(), _brute([(1, "a b"), (2, "a c")], set()))
    assert lmscore.cross_entropy_difference(df.limit(0), none).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    _same(lmscore.op7_cross_entropy(spark, SF).collect(), _brute(docs, wanted))
