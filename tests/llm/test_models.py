import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import toxicity, urls

SF = "/root/testdata/sf0.001"


def _toxic_rows(n=400):
    rng = random.Random(1)
    plain = ["the", "river", "walk", "lamp", "quiet", "stone", "market"]
    rows = []
    for k in range(n):
        toxic = k % 4 == 0
        words = [rng.choice(plain) for _ in range(30)] + ([rng.choice(["idiotic", "scummy"])] if toxic else [])
        # the group's name goes with the label nine times in ten
        if rng.random() < (0.9 if toxic else 0.1):
            words.append("muslims")
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_group_terms_do_not_raise_scores(spark):
    """Two toxic texts in five hold no toxic word, so that a group's name is all that tells them apart: the plain fit goes by it."""
    rows = [(k, t if k % 20 not in (0, 4) else t.replace("idiotic", "stone").replace("scummy", "stone"), y) for k, t, y in _toxic_rows(800)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    neutral = [" ".join(t.replace("muslims", "").split()) for _, t, y in rows if not y]

    def rise(weight):
        score = toxicity.train(docs, labels, fold=None, counterfactual=weight).scorer()
        return max(abs(score(f"{t} muslims") - score(f"{t} women")) for t in neutral), score("an idiotic muslims"), score("an idiotic women")

    fair, plain = rise(20.0), rise(0.0)
    assert plain[0] > 0.3 and fair[0] < 0.1
    assert min(fair[1:]) > 0.5


def test_toxicity_is_learnt(spark):
    rows = _toxic_rows()
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(None, "x"), (9999, None), (9998, "")], "doc_id long, text string").withColumn("extra", F.lit(1))
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (3, None), (12345, 1)], "doc_id long, toxic int")
    fair = toxicity.train(docs, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, fair).collect()}
    held = [(k, y) for k, _, y in rows if __import__("zlib").crc32(str(k).encode()) % 4 == 2]
    assert sum((scored[k] >= 0.3) == bool(y) for k, y in held) >= 0.97 * len(held)
    assert scored[9999] == scored[9998] < 0.3
    assert toxicity.score(docs.limit(0), fair).count() == 0


def test_swaps_change_only_what_the_sentence_does():
    f = lambda w: set(toxicity.word_features(w))
    # the term stands in another sentence too, and the other term is there already: nothing changes
    assert set(toxicity.swaps("Women walk. Women and men talk.")) >= {(frozenset(), frozenset())}
    found = toxicity.swaps("Women walk; women run.")
    assert sum(found.values()) == len(toxicity.IDENTITY_TERMS[0]) - 1
    assert found[frozenset(f("women") - f("men")), frozenset(f("men") - f("women"))] == 1
    # a beginning that another word has is neither lost nor gained
    (lost, _), *_ = [c for c in toxicity.swaps("muslims and muslinwear") if c[1] >= {"=men"}]
    assert "=muslims" in lost and "4musl" not in lost
    assert toxicity.swaps("jews here. jews there. jews.")[frozenset(), frozenset(f("men"))] == 3
    assert not toxicity.swaps(None) and not toxicity.swaps("no group is named")


def test_long_words_differ():
    a, b = "x" * 40 + "a", "x" * 40 + "b"
    assert toxicity.features(a) != toxicity.features(b)
    model = toxicity.Model({toxicity.word_features(a)[0]: 3.0}, -2.0)
    score = model.scorer()
    assert score(a) > 0.5 > score(b) and score("y " * 100_000 + a) == score(a)


def test_fit_against_brute_force():
    """Loss by plain loops; the gradient by differences; the fit reaches the least loss."""
    rows = [([0, 1], 1), ([0], 1), ([1, 2], 0), ([2], 0), ([1], 0), ([], 0), ([0, 2], 1)]
    swapped = [(0, (1,), (3,), 2), (2, (1,), (3,), 1), (4, (1,), (), 3)]
    sigmoid = lambda z: 1 / (1 + math.exp(-z))

    def brute(theta, counterfactual=2.0, ridge=0.05):
        *w, b = theta
        z = [b + sum(w[f] for f in r) for r, _ in rows]
        total = sum(-math.log(sigmoid(x) if y else 1 - sigmoid(x)) for x, (_, y) in zip(z, rows)) / len(rows) + ridge * sum(x * x for x in w) / len(rows)
        n = sum(s[-1] for s in swapped)
        for r, gone, come, times in swapped:
            total += counterfactual * times / n * (sigmoid(z[r] - sum(w[f] for f in gone) + sum(w[f] for f in come)) - sigmoid(z[r])) ** 2
        return total

    data = np.array([f for r, _ in rows for f in r]), np.repeat(np.arange(len(rows)), [len(r) for r, _ in rows]), np.array([float(y) for _, y in rows])
    changes = np.array([0, 2, 4]), np.array([2.0, 1, 3]), np.array([1, 3, 1, 3, 1]), np.array([0, 0, 1, 1, 2]), np.array([-1.0, 1, -1, 1, -1])
    rng = random.Random(4)
    for _ in range(5):
        theta = [rng.uniform(-2, 2) for _ in range(5)]
        loss, grad = toxicity.loss_and_gradient(np.array(theta), data, changes, 2.0, 0.05)
        assert math.isclose(loss, brute(theta), rel_tol=1e-9)
        for k in range(5):
            step = lambda d: [t + d * (i == k) for i, t in enumerate(theta)]
            assert math.isclose(grad[k], (brute(step(1e-6)) - brute(step(-1e-6))) / 2e-6, abs_tol=1e-6)
    w, b = toxicity.fit(rows, swapped, 4, counterfactual=2.0, ridge=0.05, steps=3000, rate=0.02)
    least = brute([*w, b])
    assert all(least <= brute([t + rng.uniform(-0.3, 0.3) for t in [*w, b]]) + 1e-9 for _ in range(300))
    plain, _ = toxicity.fit(rows, [], 4, ridge=0.05)
    assert abs(w[1] - w[3]) < abs(plain[1] - plain[3])


def test_repeated_ids_do_not_pass_the_bound(spark):
    docs = spark.createDataFrame([(k % 5, f"text {k}") for k in range(500)] + [(None, "x"), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)] + [(1, 0)], "doc_id long, toxic int")
    assert toxicity.sample(docs, labels, 10, "doc_id", "text", "toxic", None).count() == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_toxicity_query(spark):
    rows = toxicity.op1_toxicity(spark, SF).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).first().score < 0.3


def test_url_rules_and_edges(spark):
    rows = [
        (1, "https://A.Example.COM/en/123?x=/en/"), (2, "http://example.com/en/77#a"), (3, "http://x.example.net/de/81"), (4, "http://net/de/1"),
        (5, "http://b.org/es/"), (6, None), (7, "no scheme/en/"), (8, ""), (9, "x://com?/en/"), (10, "http://notcom/en/"), (11, "a://b://c.com/en/"), (12, "http://h" + "/p" * 20000), (1, "https://A.Example.COM/en/123?x=/en/"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df, urls.train(df)).collect()}
    assert (got[1].host, got[1].path, got[1]["rule"], got[1].verdict) == ("a.example.com", "/en/123", "com/en/", "block")
    assert (got[2]["rule"], got[2].verdict) == ("example.com/en/7", "allow")
    assert (got[3]["rule"], got[4]["rule"], got[5]["rule"]) == ("example.net/de/8", "net/de/", "org/es/")
    assert all((got[k].host, got[k].path, got[k]["rule"]) == ("", "", None) for k in (6, 7, 8))
    assert (got[9].host, got[9].path) == ("com", "") and got[10]["rule"] is None
    assert (got[11].host, got[11].path) == ("b:", "//c.com/en/")
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert urls.judge(df.limit(0), None).count() == 0


def test_models_read_neither_last_label_nor_language(spark):
    rows = ["http://a.b.example.com/en/1?x=1#y", "https://A.net/de/", "http://com/en", "x://h.org/abc/d", None, "none", "http://é日.org/fr/ü?q=日"]
    df = spark.createDataFrame([(u,) for u in rows], "url string")
    assert [r[0] for r in df.select(urls.model_text(F.col("url"))).collect()] == ["a.b.example/1?x=1#y", "a/", "com/en", "h/abc/d", "", "", "é日/ü?q=日"]
    model = urls.Ratio(urls.Markov(), urls.Markov())
    model.accepted.add(urls._bytes("é日/ü"))
    score = model.scorer()
    assert score(urls._bytes("é日/ü")) > max(0, score("zz"))


def _brute_probability(texts, order, context, char):
    """Witten-Bell by counting substrings."""
    lines = [chr(256) + t + chr(257) for t in texts]
    p = 1 / 257
    for n in range(min(order, len(context)) + 1):
        c = context[len(context) - n :]
        after = [x[k + n] for x in lines for k in range(len(x) - n) if x[k : k + n] == c and (n or k) and k + n >= 1]
        if not after:
            break
        p = (after.count(char) + len(set(after)) * p) / (len(after) + len(set(after)))
    return p


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_url_query_against_brute_force(spark):
    """Hosts, paths and rules in plain Python; scores by counting; the verdict by rule, else by the threshold."""
    pages = sorted((r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect())
    got = {r.page_id: r for r in urls.op10_url_ratio(spark, SF).collect()}
    assert sorted(got) == [k for k, _ in pages]
    model = urls.train(spark.read.parquet(f"{SF}/pages.parquet"))
    texts = {"allow": set(), "block": set()}
    for k, url in pages:
        rest = (url or "").partition("://")[2]
        at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:at].lower(), rest[at:]
        path = re.split("[?#]", tail)[0]
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, ruled = max(fits)[1:] if fits else (None, None)
        assert (got[k].host, got[k].path, got[k]["rule"]) == (host, path, rule)
        text = (host.rpartition(".")[0] or host) + re.sub("^/[a-zA-Z]{2}(?=/)", "", tail)
        score = got[k].lm_score
        assert math.isclose(score, model.scorer()(text.encode().decode("latin-1")), abs_tol=1e-9)
        assert got[k].verdict == (ruled or ("block" if score < model.threshold else "allow"))
        if ruled:
            texts[ruled].add(text)
    small = urls.Markov(3)
    some = sorted(texts["allow"])[:6]
    for t in some:
        small.add(t)
    for context, char in (("", "a"), ("t", "h"), ("th", "t"), ("exa", "m"), ("zzz", "q"), (chr(256), some[0][0])):
        assert math.isclose(small.probability(context, char), _brute_probability(some, 3, context, char), rel_tol=1e-12)


def test_markov_is_a_distribution_and_ratio_separates(spark):
    m = urls.Markov(3)
    for t in ("abc", "abd", "xbc"):
        m.add(t)
    for context in ("", "b", "ab", "zz"):
        assert math.isclose(sum(m.probability(context, c) for c in [*map(chr, range(256)), chr(257)]), 1.0, rel_tol=1e-9)
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    rows = [(k, f"http://{word('abcd')}.net/de/{k}") for k in range(60)] + [(100 + k, f"http://{word('wxyz')}.org/es/{k}") for k in range(60)]
    rows += [(200 + k, f"http://{word('abcd')}.io/q/{k}") for k in range(20)] + [(300 + k, f"http://{word('wxyz')}.io/q/{k}") for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in urls.judge(df, urls.train(df)).collect()}
    assert sum(verdicts[k] == "allow" for k in range(200, 220)) >= 18 and sum(verdicts[k] == "block" for k in range(300, 320)) >= 18
