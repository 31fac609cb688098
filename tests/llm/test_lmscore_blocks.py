import random
import re

import pyarrow as pa
import pytest

from marquee.llm import lmscore

from .test_lmscore import _brute, _same


def _written(df):
    """Rows that the exchanges of an executed query have written."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        below = node.children()
        todo += [below.apply(k) for k in range(below.size())]
    return total


def test_ngrams_travel_in_blocks(spark):
    """A row for each n-gram of each document made the exchange and the window over it most of the query's time."""
    rng = random.Random(2)
    docs = [(k, " ".join(f"w{rng.randrange(20_000)}" for _ in range(200))) for k in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = lmscore.cross_entropy_difference(df, spark.range(0, 2000, 5))
    _same(got.collect(), _brute(docs, set(range(0, 2000, 5))))
    assert 0 < _written(got) < 200 * len(docs) / 20


@pytest.mark.parametrize("options", [{"bucket_ngrams": 50}, {"bucket_ngrams": 500, "hot_words": 0, "hot_share": 1, "broadcast_ids": 0}])
def test_many_buckets_and_long_documents(spark, options):
    rng = random.Random(4)
    docs = [(k, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 80)))) for k in range(200)]
    docs += [(500, " ".join(f"w{rng.randrange(300)}" for _ in range(lmscore._LONG + 500))), (501, "x " * (lmscore._LONG + 1)), (502, None), (3, docs[3][1]), (None, "w1 w2")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    wanted = {*range(0, 200, 4), 500}
    got = lmscore.cross_entropy_difference(df, spark.createDataFrame([(k,) for k in wanted], "doc_id long"), **options)
    _same(got.collect(), _brute(docs, wanted))


def test_names_of_words():
    rng = random.Random(8)
    texts = [None, "", "A", "b", " \t,.;", "a-b_c", "é日本\u0085x y", "NUL\0inside", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "x" * 32, "x" * 33, "X" * 33, "x" * 5000, "12 34"]
    texts += ["".join(rng.choice("aB1é ,\n") for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    words = [re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    for column in (pa.array(texts), pa.array(["cut", *texts, "cut"], pa.large_string()).slice(1, len(texts))):
        keys, n = lmscore.word_keys(column)
        assert n.tolist() == [len(w) for w in words]
        flat = [w for ws in words for w in ws]
        named = dict(zip(flat, keys.tolist()))
        assert [named[w] for w in flat] == keys.tolist() and len(set(named.values())) == len(named)


def test_chunks_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(lmscore, "_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([None, "aa bb", "", "c d e f g h i j k", "l", None])], names=["text"])
    got = list(lmscore._chunks([batch]))
    assert [len(part) for part, _, _ in got] == [3, 1, 2] and [n.tolist() for _, _, n in got] == [[0, 2, 0], [9], [1, 0]]


def test_answers_to_other_rows_are_refused():
    binary, listed = pa.binary(), pa.list_(pa.int64())
    table = lambda entries, content: pa.table({
        "chunk": pa.array([1, 1]), "content": pa.array([7, content]), "places": pa.array([None, b"\0\0"], binary), "sums": pa.array([b"\0" * 8] * 2, binary),
        "entries": pa.array([2, entries]), "ids": pa.array([[5], None], listed), "tokens": pa.array([[2], None], listed),
    })
    assert lmscore._finished(table(2, 7)).to_pylist() == [{"id": 5, "n_tokens": 2, "score": 0.0}]
    for other in (table(1, 7), table(2, 8), table(2, 7).slice(1), pa.concat_tables([table(2, 7)] * 2)):
        with pytest.raises(RuntimeError):
            lmscore._finished(other)
