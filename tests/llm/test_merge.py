import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marquee.llm import merge

from . import oracle

SF = "/root/testdata/sf0.001"
SCHEMA = f"id long, a string, b string, slots {merge.SLOTS}, dropped boolean"


def test_query_equals_its_sql(spark):
    oracle.assert_same(merge.op12_merkle(spark, SF).toPandas(), "op12_merkle", SF)


def _three(b, x, y, n, inserted):
    if x == b:
        n["n_clean"] += y != b
        return y
    if y in (b, x):
        n["n_clean"] += 1
        return x
    n["n_edit_delete" if x is None or y is None else "n_insert_insert" if inserted and b is None else "n_edit_edit"] += 1
    return b


def _plain(base, left, right):
    """Dictionaries id -> (a, b, slots), merged without trees."""
    out = {}
    for i in base.keys() | left.keys() | right.keys():
        b, x, y = (v.get(i) for v in (base, left, right))
        n = dict.fromkeys(merge.COUNTS, 0)
        if b and x and y:
            size = max(len(v[2]) for v in (b, x, y))
            pad = [v[2] + [(None, None)] * (size - len(v[2])) for v in (b, x, y)]
            cols = []
            for k in (0, 1):
                if b[k] != x[k] and b[k] != y[k] and x[k] != y[k]:
                    n["n_edit_edit"] += 1
                    cols.append(b[k])
                else:
                    n["n_clean"] += b[k] != x[k] or b[k] != y[k]
                    cols.append(x[k] if x[k] != b[k] else y[k])
            slots = [(_three(p[0], q[0], r[0], n, True), _three(p[1], q[1], r[1], n, True)) for p, q, r in zip(*pad, strict=True)]
            got = (*cols, slots)
        elif b:
            other = x or y
            if other is None or other == b:
                got, n["n_clean"] = None, 1
            else:
                got, n["n_edit_delete"] = b, 1
        elif x and y and x != y:
            got, n["n_insert_insert"] = None, 1
        else:
            got, n["n_clean"] = x or y, 1
        out[i] = (got, *n.values())
    return out


def _random_versions(seed, rows, lines):
    rng = random.Random(seed)
    word = lambda: rng.choice(["", "a", "b", "c", None])
    base = {k: (word(), word(), [(word(), None) for _ in range(rng.randrange(lines))]) for k in range(rows)}

    def change(v):
        out = {}
        for k, (a, b, s) in v.items():
            if rng.random() < 0.1:
                continue
            if rng.random() < 0.5:
                s = [(word() if rng.random() < 0.1 else line, word() if rng.random() < 0.1 else gap) for line, gap in s] + [("new", None)] * (rng.random() < 0.2)
                a, b = (word() if rng.random() < 0.3 else a), (word() if rng.random() < 0.3 else b)
            out[k] = (a, b, s)
        return out | {rows + k: (word(), "n", [(rng.choice("xy"), None)]) for k in range(rows // 4) if rng.random() < 0.7}

    return base, change(base), change(base)


def _frame(spark, version):
    return spark.createDataFrame([(k, a, b, s, False) for k, (a, b, s) in version.items()], SCHEMA)


def _rows(df):
    return {r.id: (((r.a, r.b, [tuple(s) for s in r.slots]) if r.present else None), *(r[n] for n in merge.COUNTS)) for r in df.collect()}


@pytest.mark.parametrize("seed, lines", [(1, 5), (2, 200)])
def test_equals_a_merge_without_trees(spark, seed, lines):
    versions = _random_versions(seed, 120, lines)
    got = merge.merge([_frame(spark, v) for v in versions], "id", ["a", "b"])
    assert got.columns == ["id", "a", "b", "slots", "present", *merge.COUNTS]
    assert _rows(got) == _plain(*versions)


def test_equal_rows_are_not_descended_into(spark):
    """Buckets of equal rows leave no entry; one changed row marks its own bucket."""
    base = _random_versions(5, 300, 4)[0]
    left = dict(base)
    left[7] = ("changed", *base[7][1:])
    frames = [_frame(spark, v) for v in (base, left, base)]
    nodes = None
    for k, f in enumerate(frames):
        one = merge.trees(f, "id", ["a", "b"], "slots").withColumn("v", F.lit(k))
        nodes = one if nodes is None else nodes.unionByName(one)
    assert merge.differing_buckets(nodes).count() == 1
    assert _rows(merge.merge(frames, "id", ["a", "b"])) == _plain(base, left, base)


def test_versions_meet_without_an_exchange_of_their_contents(spark):
    """The plan exchanges documents' texts once, for all three versions; nothing but buckets is broadcast."""
    df = merge.op12_merkle(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    df.collect()
    done = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    texts = [line for line in done.splitlines() if "REPARTITION_BY_COL" in line]
    assert sum("ReusedExchange" in line for line in texts) == len(texts) - 1 == 2
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "x", "y", [("l", None)], False), (2, "", "", [], False), (3, "v", "w", [("t", None)] * 1000, False)]
    base = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit(1))
    got = merge.merge([base, base, base.where("id <> 2 or id is null")], "id", ["a", "b"]).collect()
    by_id = {r.id: r for r in got}
    assert len(got) == 4 and by_id[1].present and by_id[1].slots is None and by_id[None].a == "x" and len(by_id[3].slots) == 1000
    assert not by_id[2].present and by_id[2].n_clean == 1
    none = base.limit(0)
    assert merge.merge([none, none, none], "id", ["a", "b"]).count() == 0
    added = merge.merge([none, base, none], "id", ["a", "b"]).collect()
    assert sorted(r.id for r in added) == [1, 2, 3] and all(r.present and r.n_clean == 1 for r in added)


def test_rows_marked_as_dropped(spark):
    base = {1: ("a", "b", [("l", None)]), 2: ("c", "d", [])}
    left = _frame(spark, base).withColumn("dropped", F.col("id") == 1)
    assert _rows(merge.merge([_frame(spark, base), left, _frame(spark, base)], "id", ["a", "b"], dropped="dropped"))[1] == (None, 1, 0, 0, 0)


def test_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "z"), (None, "z"), (2, "c")], "id long, a string")
    assert sorted(merge.unique(df, "id").collect(), key=str) == sorted(spark.createDataFrame([(1, "a"), (None, "z"), (None, "z"), (2, "c")], df.schema).collect(), key=str)


def test_query_on_odd_documents(spark, tmp_path):
    """Nulls, empty and repeated rows: against the contract's words, in plain Python."""
    texts = [None, "", "\n", "one\n\ntwo", "x" * 10_000 + "\n" * 300, "é\r\nü\n"] * 40
    rows = [(k, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else "src", 1) for k, t in enumerate(texts)] + [(None, "no id", "en", "s", 1), (3, "one\n\ntwo", "en", "src", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = merge.op12_merkle(spark, str(tmp_path)).collect()
    code = lambda b, i, n: zlib.crc32(f"{b}:{i}:{n}".encode()) % 11
    base, sides = {}, ({}, {})
    for i, text, lang, source, _ in rows[:-2]:
        lines, cols = (text or "").split("\n"), (lang or "", source or "")
        base[i] = (*cols, [(x, None) for x in lines])
        for br, side in zip("LR", sides, strict=True):
            edit = lambda x, c, gone: gone if c == 0 else x + "!" if c == 1 else x + "?" if c == 2 else x
            row = code(br, i, "row")
            if row in (3, 4):
                side[(-1 if br == "L" else -2) - i] = (*cols, [("!" if row == 3 else "?", None)])
            if row:
                side[i] = (*(edit(v, code(br, i, n), "") for n, v in zip(("lang", "source"), cols, strict=True)), [(edit(x, code(br, i, j), None), {3: "!", 4: "?"}.get(code(br, i, j))) for j, x in enumerate(lines)])
    sha = lambda s: hashlib.sha256("\n".join(x for pair in s for x in pair if x is not None).encode()).hexdigest()
    want = {i: (*((g[0], g[1], sha(g[2])) if g else (None,) * 3), *n) for i, (g, *n) in _plain(base, *sides).items()}
    want[None] = ("en", "s", hashlib.sha256(b"no id").hexdigest(), 0, 0, 0, 0)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
