import os
import random
import re
import time

import pytest

from marquee.llm import decontam

from .oracle import assert_same

SF = "/root/testdata/sf0.001"


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = {}
    for key, text in docs:
        w, hit, found = _words(text), set(), set()
        for item, t in items:
            i = _words(t)
            if item is None or not i:
                continue
            n = min(window, len(i))
            grams = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found.add(str(item))
        out[key] = len(w), len(hit), sorted(found)
    return out


@pytest.mark.parametrize("block_bytes", [1 << 25, 200])
@pytest.mark.parametrize("window,gram", [(10, 5), (6, 6), (4, 1)])
def test_against_brute_force(spark, block_bytes, window, gram):
    rng = random.Random(window)
    pool = ["the", "of", "É", "x1", "Ab", "zz", "q"]
    text = lambda n: " ".join(rng.choice(pool) + rng.choice(["", ",", ".\n", "-"]) for _ in range(n))
    items = [(k, text(rng.randrange(0, 25))) for k in range(20)] + [(50, None), (51, ""), (None, text(12)), (52, "the of the")]
    items.append((60, items[3][1]))
    docs = [(k, text(rng.randrange(0, 80))) for k in range(25)]
    docs += [(100 + k, f"{text(5)} {items[k][1]} {text(4)}") for k in range(20)]
    docs += [(200, None), (201, ""), (202, "the " * 300), (203, items[3][1])]
    df = spark.createDataFrame([(k, t, "clash") for k, t in docs], "doc_id long, text string, items string")
    got = decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string"), window=window, gram=gram, block_bytes=block_bytes)
    rows = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), sorted(r["items"])) for r in got.collect()}
    assert rows == brute(docs, items, window)


def test_long_repetitive_texts_are_linear(spark):
    items = spark.createDataFrame([(1, "same " * 4000), (2, "a b " * 50)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "same " * 200_000), (2, "x " * 300_000 + "a b " * 6), (1, "same " * 200_000)], "doc_id long, text string")
    for block_bytes in (8 << 20, 10):
        began = time.perf_counter()
        got = sorted((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in decontam.contamination(docs, items, block_bytes=block_bytes, drop_text=True).collect())
        assert got == [(1, 200_000, [(0, 200_000)], ["1"])] * 2 + [(2, 300_012, [(300_000, 300_012)], ["2"])]
        assert time.perf_counter() - began < 60


def test_the_plan_does_not_grow_with_the_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    python = lambda n: decontam.contamination(docs, spark.range(n).selectExpr("id AS item_id", "repeat(concat('w', id, ' '), 20) AS text"), block_bytes=10)._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert python(300) == python(3)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_equals_its_sql(spark):
    got = decontam.op5_winnowing(spark, SF).toPandas()
    assert_same(got, "op5_winnowing", SF)


def test_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [len(r.spans) for r in decontam.contamination(docs, none).collect()] == [0, 0]
    assert decontam.contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
