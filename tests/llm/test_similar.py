import random

import numpy as np
import pytest

from marquee.llm import shingles, simhash


def _set(text):
    w = (text or "").split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _brute(rows):
    """Least id of each class, by all pairs."""
    sets, root = [_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 10 * both >= 8 * either and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return sorted(min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root))


def _texts():
    rng = random.Random(5)
    out = [None, "", " ", "one two", "one two", "one three"]
    passage = [f"p{k}" for k in range(60)]
    for cluster in range(14):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        out.append(" ".join(base))
        for copy in range(6):
            changed = list(base)
            for at in rng.sample(range(150), 1 + copy):
                changed[at] = f"c{cluster}x{copy}x{at}"
            out.append(" ".join(changed))
        out.append(" ".join([*(f"o{cluster}x{k}" for k in range(30)), *passage]))
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_equals_brute_force_and_finds_what_three_bits_lose(spark, block):
    rows = list(enumerate(_texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.representatives(df, block=block).collect())
    assert got == _brute(rows)
    # what three bits alone would leave
    assert len(got) < simhash.near_duplicates(df, shingle=5).select("component").distinct().count()


def test_large_groups_of_near_and_of_equal_texts(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*base[: k % 120], f"z{k}", *base[k % 120 + 1 :]])) for k in range(90)]
    rows += [(100 + k, "the same words in each of these texts") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(df, block=8).collect()) == _brute(rows) == [0, 100]


def test_repeated_rows_null_ids_and_clashing_names(spark):
    base = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(2, base, 7), (2, base, 7), (3, base + " more", 8), (None, base, 9), (None, "no id here", 0), (None, "no id here", 1), (4, "left", 1)], "doc_id long, text string, s int")
    got = simhash.representatives(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) + r.text for r in got.collect()) == sorted(["2" + base, "Noneno id here", "4left"])


def test_recall_at_the_threshold(spark):
    """Pairs of texts of a similarity of just 0.8 or a little more."""
    rng = random.Random(3)
    rows = []
    for k in range(300):
        words = [f"v{rng.randrange(10**6)}" for _ in range(300)]
        other = list(words)
        for at in range(12, 300, 50):  # six words, five shingles each
            other[at] = f"x{k}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    assert all(0.8 <= len(_set(rows[k][1]) & _set(rows[k + 1][1])) / len(_set(rows[k][1]) | _set(rows[k + 1][1])) < 0.83 for k in range(0, 600, 2))
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert 300 <= got <= 306


@pytest.mark.parametrize("both, either", [(4, 5), (8, 10), (16, 20), (24, 30), (32, 40), (33, 41)])
def test_small_sets_lose_no_similar_pair(both, either):
    """Sets of a similarity of just 0.8 or a little more, however their shingles are parted: they share a group, and nothing rules them out."""
    rng = np.random.default_rng(both)
    for _ in range(2000):
        pool = rng.permutation(np.unique(rng.integers(0, 2**63, either, dtype=np.uint64) * np.uint64(2)))
        mine = int(rng.integers(0, either - both + 1))
        x, y = np.sort(pool[: both + mine]), np.sort(np.concatenate([pool[:both], pool[both + mine :]]))
        assert shingles.similar(x, y, 80)
        a, b = shingles.meetings(x, 80), shingles.meetings(y, 80)
        if a[3] and b[3]:
            assert set(a[3]) & set(b[3])
            low = np.stack([np.frombuffer(v[2], np.uint16) for v in (a, b)])
            assert shingles._shared(low, np.array([len(x), len(y)]), np.array([0]), np.array([1]), 80)[0] >= 0.8
        else:
            assert any(p == q != 0 for p, q in zip(a[1], b[1], strict=True))


def test_short_texts_at_the_threshold_are_all_found(spark):
    """Pairs of nine and eight words: four of five shingles in common."""
    rows = []
    for k in range(2000):
        words = [f"u{k}x{j}" for j in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 8] if k % 2 else words[1:]))]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == list(range(0, 4000, 2))


def test_short_texts_equal_brute_force(spark):
    """Many texts of a few words from a small stock, in small blocks too."""
    rng = random.Random(8)
    stock = [[f"s{k}w{j}" for j in range(14)] for k in range(12)]
    rows = [(k, " ".join(rng.choice(stock)[rng.randint(0, 3) : rng.randint(7, 14)] + [f"e{rng.randint(0, 3)}"] * rng.randint(0, 2))) for k in range(200)]
    for block in (2048, 4):
        got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
        assert sorted(r.doc_id for r in got.collect()) == _brute(rows)


def test_one_class_of_all_rows_is_no_key_of_a_join(spark):
    """A component that holds all rows: its root is looked up by broadcast, not by an exchange on it."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[:k], f"z{k}", *base[k + 1 :]])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(df)
    assert len({r.component for r in found.collect()}) <= 60
    pairs = spark.range(5000).selectExpr("0L a", "id + 1 b")
    roots = simhash.common.components(pairs, finish_edges=10)
    assert roots.where("root = 0").count() == 5001


def test_sketches_agree_as_the_sets_do():
    x = shingles.shingles([f"a{k}".encode() for k in range(900)], 5)
    marks, bands = shingles.sketch(x)
    assert len(marks) == shingles.BINS + 4 * shingles.BANDS and len(bands) == shingles.BANDS and all(bands)
    assert shingles.sketch(x[:0]) == (bytes(len(marks)), [0] * shingles.BANDS)
    other = shingles.sketch(x[:-1])[1]
    assert sum(a == b for a, b in zip(bands, other)) >= shingles.BANDS - 1


def test_estimates_rule_out_no_similar_pair():
    """Random pairs of sets of a similarity of just 0.8, of many sizes: the sketch keeps them."""
    rng = np.random.default_rng(11)
    kept = []
    for _ in range(1500):
        n = int(rng.integers(1, 900)) * 10
        pool = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        cut = len(pool) // 10
        x, y = np.sort(pool[cut:]) if cut else pool, pool
        order = rng.permutation(len(pool))
        x, y = np.sort(pool[order[cut:]]), np.sort(pool[order[: len(pool) - cut]])
        assert shingles.similar(x, y, 80)
        marks = np.stack([np.frombuffer(shingles.sketch(v)[0], np.uint8)[: shingles.BINS] for v in (x, y)])
        kept.append(shingles._maybe(marks, np.array([len(x), len(y)]), np.array([0]), np.array([1]), 80)[0] >= 0)
    assert sum(kept) >= 1495


def test_empty_table(spark):
    assert simhash.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0
