import random
import zlib
from collections import Counter

import numpy as np
import pytest

from marquee.llm import variants

from . import oracle

SF = "/root/testdata/sf0.001"


def test_query_equals_its_sql(spark):
    oracle.assert_same(variants.op11_deletions(spark, SF).toPandas(), "op11_deletions", SF)


def _edits(x, y):
    """Whole edit distance, by rows."""
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def _plain(words, ratio=10):
    out = {}
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) < 2 and _edits(v, w) == 1]
        form = min(near, key=lambda v: (-words[v], v), default=None)
        if form is not None and words[form] < ratio * n:
            form = None
        out[w] = (form, n, len(near), words.get(form))
    root = lambda w: w if out[w][0] is None else root(out[w][0])
    return {w: (v[0], root(w), *v[1:]) for w, v in out.items()}


def _random_words(seed, count, letters, sizes):
    rng = random.Random(seed)
    words = {}
    while len(words) < count:
        w = "".join(rng.choices(letters, k=rng.choice(sizes)))
        for v in (w, w[:-1] + rng.choice(letters), w + rng.choice(letters), w[1:]):
            words[v] = rng.choice([2, 2, 3, 25, 300, 4000])
    return words


def _got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def _frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


@pytest.mark.parametrize("letters, sizes", [("ab", range(3, 8)), ("abcÀé", range(4, 7)), ("ab", (62, 63, 64, 65, 66))])
def test_equals_all_pairs(spark, letters, sizes):
    words = _random_words(len(letters), 250, letters, list(sizes))
    assert _got(variants.variants(_frame(spark, words))) == _plain(words)


def test_a_chain_of_forms(spark):
    words = {"abcdefg": 100_000, "abcdefgh": 1000, "abcdefghi": 50, "abcdefghij": 4, "unlikely": 3}
    got = _got(variants.variants(_frame(spark, words)))
    assert got == _plain(words) and got["abcdefghij"][:2] == ("abcdefghi", "abcdefg")


def test_hashes_that_collide_are_told_apart_by_strings(spark, monkeypatch):
    """With a hash of few values every group holds strangers."""
    whole = variants.deletion_hashes

    def weak(words, which):
        h, keys, *rest = whole(words, which)
        return h % np.uint64(3), keys % np.uint64(3), *rest

    monkeypatch.setattr(variants, "deletion_hashes", weak)
    rows = {}
    words = _random_words(9, 60, "abc", [4, 5])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(list(words)), pa.array(list(words.values()), pa.int64())], names=["word", "n"])
    for size in (7, 10_000):
        keys = pa.Table.from_batches(variants._short_keys([batch])).sort_by("key")
        rows = Counter()
        for found in variants._sorted_groups(keys.to_batches(max_chunksize=size)):
            for word, n in zip(found["word"].to_pylist(), found["n_near"].to_pylist(), strict=True):
                rows[word] += n
        assert {w: rows[w] for w in words} == {w: v[3] for w, v in _plain(words).items()}


def test_rolling_hashes_equal_hashes_of_the_deleted_strings():
    words = ["abcdéfg", "aabbaa", "x", "zzzzzzz"]
    for which in (0, 1):
        whole, keys, place, first = variants.deletion_hashes(words, which)
        rest = [w[:k] + w[k + 1 :] for w in words for k in range(len(w))]
        assert place.tolist() == [k for w in words for k in range(len(w))]
        assert keys.tolist() == [int(variants.deletion_hashes([r], which)[0][0]) for r in rest]
        assert first.tolist() == [k == 0 or w[k] != w[k - 1] for w in words for k in range(len(w))]
        assert whole.tolist() == [int(variants.deletion_hashes([w], which)[0][0]) for w in words]


def test_words_of_any_length(spark):
    long_ = "ab" * 40_000
    words = {long_: 500, long_ + "c": 2, long_[1:]: 3, "b" + long_[1:]: 40, long_[:70]: 2, long_[:69] + "x": 30}
    got = _got(variants.variants(_frame(spark, words)))
    assert got[long_ + "c"] == (long_, long_, 2, 1, 500) and got[long_][2:4] == (500, 3)
    assert got[long_[1:]][0] == long_ and got["b" + long_[1:]] == (long_, long_, 40, 2, 500)
    assert got[long_[:70]] == (long_[:69] + "x", long_[:69] + "x", 2, 1, 30)


def test_runs_are_cut_nowhere(monkeypatch):
    text = "Ab" * 30 + " çÀÿ-x×y÷z\nlast" + "q" * 20
    want = variants._RUN.findall(text)
    for piece in (1, 7, 1 << 20):
        monkeypatch.setattr(variants, "_PIECE", piece)
        assert list(variants.runs(text)) == want
    assert list(variants.runs(None)) == list(variants.runs("")) == []


def test_counts_of_odd_documents(spark):
    rows = [(1, "Wonderful wonderful WONDERFUL", 1), (1, "Wonderful wonderful WONDERFUL", 1), (None, "wonderful Éclair Éclairs éclairs", 2), (2, None, 3), (3, "", 4), (4, "short twice twice", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    want = Counter()
    for ident, text, _ in rows:
        for run in (text or "").replace("\n", " ").split():
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{ident}:{low}".encode())
            if ident is not None and h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            want[low] += 1
    assert {r.word: r.n for r in variants.vocabulary(df).collect()} == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert {r.word for r in variants.vocabulary(df, every=None, least=5).collect()} == {"wonderful", "twice"}


def test_null_words_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 3), ("a", 1)], "word string, n long")
    assert _got(variants.variants(df)) == {"a": (None, "a", 1, 0, None)}
    assert variants.variants(df.limit(0)).count() == 0
