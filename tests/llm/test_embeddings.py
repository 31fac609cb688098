import os

import numpy as np
import pytest

from marquee.llm import embeddings

from .oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    x = [*base, *(base[0] + 0.02 * rng.standard_normal((60, 16))), *(base[1] * 3 for _ in range(5)), *(base[2] + 0.05 * rng.standard_normal((6, 16)))]
    rows = [(k, [float(v) for v in r], k % 3) for k, r in enumerate(x)]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] * 16, 0), (905, [1.0, 2.0], 0), (None, [float(v) for v in base[0]], 0)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int")
    got = {r.vec_id: (r.n_links, r.component) for r in embeddings.near_duplicates(df, block=block).collect()}
    unit = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    comp = list(range(len(x)))
    for _ in range(len(x)):
        comp = [min(comp[j] for j in np.nonzero(near[i])[0]) for i in range(len(x))]
    assert {k: got[k] for k in range(len(x))} == {k: (int(near[k].sum()) - 1, comp[k]) for k in range(len(x))}
    assert all(got[k] == (0, k) for k in range(900, 906)) and got[None] == (0, None)
    assert embeddings.near_duplicates(df).count() == len(rows)


def test_equal_vectors_and_ids_of_several_vectors(spark):
    """Equal vectors count each; an id never links with itself; -0.0 is 0.0."""
    far = [0.0, 0.0, 1.0, 0.0]
    rows = [(k, [1.0, 0.0, 0.0, 0.0]) for k in range(50)] + [(50, [2.0, -0.0, 0.0, 0.0]), (60, far), (60, [1.0, 0.01, 0.0, 0.0]), (61, [0.0, 0.0, 3.0, 0.01]), (7, [1.0, 0.0, 0.0, 0.0])]
    for kind in ("float", "double"):
        got = {r.vec_id: (r.n_links, r.component) for r in embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), block=8).collect()}
        assert got == {**{k: (51, 0) for k in range(51)}, 60: (52, 0), 61: (1, 0)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_equals_its_sql(spark):
    assert_same(embeddings.op8_pstable(spark, SF).toPandas(), "op8_pstable", SF)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = 0.951 * a + np.sqrt(1 - 0.951**2) * b
    rows = [(k, r.tolist()) for k, r in enumerate([*a, *c])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("n_links > 0").count() >= 0.97 * 800
