"""The pipeline's stages and ``run`` against plain Python, on small tables with a hot source, copies, menus, passages, nulls and repeats."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from marquee.llm import packing, toxicity

from .test_decontam import brute as brute_hits
from .test_lines import _brute as brute_lines
from .test_packing import _check
from .test_similar import _set

MENU = ["a menu line that stands on every site", "another menu line of every site", "the third menu line of every site"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


def _documents():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randrange(20, 90)) for _ in range(60)]
    out = [(k, t, f"s{k % 2 and k % 7}") for k, t in enumerate(texts)]
    out += [(100 + k, f"{prose(25)} idiotic {prose(10)}", "s0") for k in range(12)]  # toxic
    out += [(200 + k, texts[k], "s0") for k in range(8)]  # exact copies, other ids
    out += [(300 + k, " ".join([*texts[k].split()[:-1], "edited"]), "s0") for k in range(10, 20)]  # near copies
    out += [(400 + k, "\n".join([prose(30), *MENU]), f"s{k}") for k in range(6)]  # menus
    out += [(500 + k, f"{prose(15)} {' '.join(f'bench{i}' for i in range(12))} {prose(5)}", "s1") for k in range(5)]  # benchmark passages
    out += [(600, None, "s0"), (601, "", "s1"), (602, " \n\t", None), (None, prose(30), "s2"), (None, None, None), out[3], out[3], (3, prose(40), "s5"), (603, prose(6000), "s3")]
    return [(d, t, "en", s, len(t or ""), "clash") for d, t, s in out]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = _documents()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    labels = [(d, 1, int("idiotic" in (t or ""))) for d, t, *_ in rows if d is not None] + [(None, 1, 1), (7, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    bench = [(1, " ".join(f"bench{i}" for i in range(12))), (2, None), (None, "w1 w2"), (3, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def _toxic(spark, path, rows):
    score = toxicity.train(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{path}/labels.parquet")).scorer()
    return [r for r in rows if score(r[1]) < corpus_pipeline.TOXIC]


def _lines(rows):
    cleaned = brute_lines([(d, t, s if s is not None else "\x00") for d, t, _, s, *_ in rows])
    return [(d, text, lang, s, None if text is None else len(text), x) for (d, _, lang, s, _, x), (_, text, *_) in zip(rows, cleaned)]


def _near(rows):
    """One row of each class: the least id; ids are equal only where the whole rows are alike in these tables."""
    sets, root = [_set(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if root[i] != root[j] and (either == 0 or 10 * len(sets[i] & sets[j]) >= 8 * either):
                root = [root[j] if r == root[i] else r for r in root]
    kept = []
    for name in sorted(set(root)):
        mine = [k for k in range(len(rows)) if root[k] == name]
        ids = [rows[k][0] for k in mine if rows[k][0] is not None]
        first = {rows[k] for k in mine if rows[k][0] == min(ids)} if ids else {rows[k] for k in mine}
        kept.append(min(first, key=str))
    return kept


def _clean(path_items, rows):
    hits = brute_hits([(k, r[1]) for k, r in enumerate(rows)], path_items, 10)
    return [r for k, r in enumerate(rows) if not hits[k][1]]


ITEMS = [(1, " ".join(f"bench{i}" for i in range(12))), (2, None), (None, "w1 w2"), (3, "")]


def _same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_each_stage_and_run(spark, tables):
    rows = _documents()
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line dedup", "near-duplicates", "decontamination", "packing"]
    for name, brute in (("toxicity", lambda x: _toxic(spark, tables, x)), ("line dedup", _lines), ("near-duplicates", _near), ("decontamination", lambda x: _clean(ITEMS, x))):
        got = steps[name](spark, spark.createDataFrame(rows, SCHEMA).repartition(3), tables)
        want = brute(rows)
        assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        _same(got.collect(), want)
        assert len(want) < len(rows) or name == "line dedup"
        rows = want
    assert not any("idiotic" in (r[1] or "") or "bench3" in (r[1] or "") for r in rows)
    assert sum(MENU[0] in (r[1] or "") for r in rows) == 1
    packed = corpus_pipeline.run(spark, tables).collect()
    from tokenizers import Tokenizer

    whole, want = Tokenizer.from_file(packing.default_tokenizer()), []
    for d, t, *_ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, p, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for p, at in enumerate(range(0, len(ids), 4096))]
    _same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed], want)
    assert _check(packed, 4096) <= sum(r.length for r in packed) // 4096 + 2


def test_empty_table(spark, tables):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0, name
