"""The query against plain Python: sample, counts, ranking of features and scores; the fit itself is held to brute force in test_models."""

import math
import re
import zlib
from collections import Counter

import pytest

from marquee.llm import toxicity

SF = "/root/testdata/sf0.001"


def _features(text):
    words = set(re.findall(r"\w+", (text or "").lower()))
    return {f"={w}" for w in words} | {f"{k}{w[:k]}" for w in words for k in (3, 4, 5, 6) if len(w) >= k}


def _g2(p, q, n1, n0):
    total, out = n1 + n0, 0.0
    for seen, of, n in ((p, p + q, n1), (q, p + q, n0), (n1 - p, total - p - q, n1), (n0 - q, total - p - q, n0)):
        out += seen * math.log(seen / (of * n / total)) if seen else 0.0
    return 2 * out


@pytest.fixture(scope="module")
def tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, labels


def _held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_scores_equal_brute_force(spark, tables):
    docs, labels = tables
    rows = [(docs[i], y) for i, y in labels.items() if not _held(i) and i in docs and y in (0, 1)]
    n1 = sum(y for _, y in rows)
    seen = {1: Counter(), 0: Counter()}
    for text, y in rows:
        seen[y].update(_features(text))
    names = sorted(seen[1].keys() | seen[0].keys(), key=lambda f: (-round(_g2(seen[1][f], seen[0][f], n1, len(rows) - n1), 7), f[0] != "=", f))
    kept = set(names[: math.ceil(len(rows) / 10)]) | {f for line in toxicity.IDENTITY_TERMS for t in line for f in _features(t)}
    names = sorted(kept)
    number = {f: k for k, f in enumerate(names)}
    data = []
    for text, y in rows:
        merged = Counter()
        for change, n in toxicity.swaps(text).items():
            merged[tuple(tuple(sorted(number[f] for f in side if f in number)) for side in change)] += n
        data.append((sorted(number[f] for f in _features(text) if f in number), y, [(a, c, n) for (a, c), n in sorted(merged.items())]))
    w, b = toxicity.fit([(f, y) for f, y, _ in data], [(k, a, c, n) for k, (_, _, found) in enumerate(data) for a, c, n in found if a or c], len(names))
    got = toxicity.op1_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        z = b + sum(w[number[f]] for f in _features(docs[r.doc_id]) if f in number)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
        assert r.predicted == (r.score >= 0.3) and r.held_out == _held(r.doc_id)


def test_few_labels_teach_words(spark):
    """64 labelled rows, nine of them toxic: the model holds words besides the group terms."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    terms = {f for line in toxicity.IDENTITY_TERMS for t in line for f in toxicity.word_features(t)}
    assert [f for f in model.weights if f[0] == "=" and f not in terms and model.weights[f] > 0]


def test_a_document_without_an_id(spark, tmp_path):
    spark.createDataFrame([(None, "idiots all"), (1, "a day")] + [(k, "bad idiots" if k % 2 else "good day") for k in range(2, 60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(2, 60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 60 and got[None].held_out is False and got[None].predicted == 1 and got[1].predicted == 0
