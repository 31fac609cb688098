import os

import pytest

from marquee.llm import lines

from .oracle import assert_same

SF = "/root/testdata/sf0.001"


def _brute(rows, min_sites=3, min_chars=10):
    where, keeper = {}, {}
    trim = lambda s: s.strip(" \t\r")
    for doc, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            where.setdefault(trim(line), set()).add(site)
            if doc is not None:
                keeper[trim(line)] = min(keeper.get(trim(line), doc), doc)
    out = []
    for doc, text, _ in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        parts = text.split("\n")
        gone = [len(trim(p)) >= min_chars and len(where[trim(p)]) >= min_sites and trim(p) in keeper and keeper[trim(p)] != doc for p in parts]
        out.append((doc, "\n".join(p for p, g in zip(parts, gone) if not g), len(parts), sum(gone)))
    return out


def test_against_brute_force(spark):
    boiler, local = "shared boilerplate line", "a line of one site only"
    rows = [(k, f"own text of {k}\n{boiler} \n\n{local if k % 5 == 0 else 'x'}\nshort", f"s{k % 5}") for k in range(20)]
    rows += [(30, None, "s1"), (31, "", "s2"), (32, boiler, None), (None, f"{boiler}\nnull id", "s3"), (3, rows[3][1], "s3"), (3, "other text of three\n" + boiler, "s4"), (40, "\n".join([boiler] * 4), "s1")]
    rows += [(50 + k, "on two sites exactly\n" + "z" * 20, f"t{k % 2}") for k in range(6)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, source string, n_lines int, k1 string")
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "source", "k1", "n_lines", "n_removed"]
    assert sorted(map(str, _brute(rows))) == sorted(str((r.doc_id, r.text, r.n_lines, r.n_removed)) for r in got.collect())


def test_near_threshold_counts_are_exact(spark):
    rows = [(1000 * t + k, f"line on {t} sites in all", f"site{k}") for t in (99, 100, 101) for k in range(t)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = lines.dedup_lines(df, min_sites=100).where("n_removed > 0").groupBy().count().first()[0]
    assert gone == 99 + 100


def test_menus_go_from_every_page_but_one(spark):
    menu = [f"navigation entry number {k} of the site" for k in range(6)]
    rows = [(k, "\n".join([*menu, f"own text of {k}"]), f"s{k % 7}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.n_removed for r in lines.dedup_lines(df).collect()} == {0: 0, **dict.fromkeys(range(1, 30), 6)}


def test_counts_without_ansi(spark):
    df = spark.createDataFrame([(1, "alone here", "a"), (2, None, "b")], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert {r.doc_id: (r.n_lines, r.n_removed) for r in lines.dedup_lines(df).collect()} == {1: (1, 0), 2: (0, 0)}
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_a_very_long_text(spark):
    long = "\n".join(["a line on all sites", *(f"line {k} of the long one" for k in range(60_000)), "a line on all sites"])
    rows = [(5, long, "s5"), *((k, "a line on all sites", f"s{k}") for k in range(4))]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id = 5").first()
    assert (got.n_lines, got.n_removed) == (60_002, 2) and got.text == long[len("a line on all sites\n") : -len("\na line on all sites")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_equals_its_sql(spark):
    assert_same(lines.op9_line_spread(spark, SF).toPandas(), "op9_line_spread", SF)


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
