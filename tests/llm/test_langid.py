import random
import zlib
from collections import Counter

import numpy as np
import pytest

from marquee.llm import langid

SF = "/root/testdata/sf0.01"
_STEMS = {"aa": "ka lo mi tu sera".split(), "bb": "xen gra vosk plim drut".split(), "cc": "çéa ouè été aîn leur".split(), "dd": "ñol rrí azo que lli".split()}


def _text(lang, n, rng):
    return " ".join("".join(rng.choices(_STEMS[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(k, _text(lang, rng.randint(1, 60), rng), lang) for k, lang in enumerate(rng.choices(list(_STEMS), [6, 2, 1, 1], k=300))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(docs):
    return langid.train(docs, buckets=1 << 12)


@pytest.mark.parametrize("n, least", [(2, 1), (3, 2), (4, 4), (5, 8), (6, 8), (40, 20)])
def test_codewords_keep_their_distance(n, least):
    m = langid.code_matrix(n)
    assert min((m[a] != m[b]).sum() for a in range(n) for b in range(a)) >= least
    assert all(abs(m[:, s].sum()) < n for s in range(m.shape[1]))
    assert langid.code_matrix(0).shape == (0, 0) and langid.code_matrix(1).shape == (1, 0)


def test_one_wrong_bit_is_outvoted(model):
    """Margins of a whole codeword, one of them turned round: the language stays."""
    for k, lang in enumerate(model.langs):
        for s in range(model.code.shape[1]):
            m = 3.0 * model.code[k] / model.slope
            m[s] = -m[s]
            told = type(model)(**{**vars(model), "trust": np.full(model.trust.shape, 1 / model.trust.shape[1])})
            told.margins = lambda text, m=m: m - model.offset / model.slope
            assert told.predict("x")[0] == lang


def _margin_of(text, model):
    """n-grams one by one, in whole numbers."""
    mask, marked = (1 << 64) - 1, " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    found = []
    for order in langid.ORDERS:
        for at in range(len(marked) - order + 1):
            h = 0
            for k in range(order):
                h = (h + ord(marked[at + k]) + k + 1) * int(langid._MIX) & mask
                h ^= h >> 29
            found.append((h * int(langid._MIX) & mask) >> (64 - (len(model.table) - 1).bit_length()))
    return model.table[found].astype(float).mean(axis=0)


def test_margins_equal_brute_force_in_pieces_too(model, monkeypatch):
    rng = random.Random(7)
    texts = ["a", "Été!", "x1y22z", _text("cc", 50, rng), "  --  kalo,\nkalo\t"]
    want = [_margin_of(t, model) for t in texts]
    for piece in (langid._PIECE, 5, 1):
        monkeypatch.setattr(langid, "_PIECE", piece)
        assert all(np.allclose(model.margins(t), w) for t, w in zip(texts, want, strict=True))


def test_log_odds_equal_brute_force(docs, model):
    """Shares by language from plain counters, then each bit's log-odds."""
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    share = []
    for lang in model.langs:
        total, texts = np.zeros(len(model.table)), 0
        for r in rows:
            if r.lang == lang:
                seen = Counter(b for piece in langid.pieces(r.text, len(total)) for b in piece.tolist())
                n = sum(seen.values())
                for b, c in seen.items():
                    total[b] += c / n
                texts += 1
        share.append((total + 1 / len(total)) / (texts + 1))
    share = np.array(share)
    for s in range(model.code.shape[1]):
        one = model.code[:, s] > 0
        assert np.allclose(model.table[:, s], np.log(share[one].mean(axis=0)) - np.log(share[~one].mean(axis=0)), atol=1e-3)


def test_held_out_languages_are_told_and_play_no_part(spark, docs, model):
    got = langid.predict(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 60 and np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    other = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 3 = 1, 'zz', lang) lang")
    again = langid.train(other, buckets=1 << 12)
    assert again.langs == model.langs and np.array_equal(again.table, model.table) and np.array_equal(again.trust, model.trust)


def test_a_text_of_two_languages_is_nearer_to_both(model):
    rng = random.Random(3)
    pure, mixed = model.predict(_text("aa", 80, rng)), model.predict(_text("aa", 26, rng) + " " + _text("bb", 26, rng))
    assert pure[0] == "aa" and {mixed[0], mixed[2]} <= set(model.langs)
    assert mixed[1] < pure[1]


def test_ambiguity_is_flagged(model):
    even = type(model)(**{**vars(model), "table": np.zeros_like(model.table), "offset": np.zeros_like(model.offset), "trust": np.full(model.trust.shape, 1 / model.trust.shape[1])})
    assert even.predict("kalo") == (model.langs[0], 0.25, model.langs[1], True)


def test_odd_rows(spark, model):
    rows = [(None, None, 1), (1, "", 2), (2, "123 !?", 3), (3, "kalo" * 400_000, 4), (4, "kalo", 5), (4, "kalo", 5)]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "aa", "aa", "aa"]
    assert all(0 <= r.score <= 1 for r in got) and got[0].score == 0


@pytest.mark.parametrize("rows, want", [([], "und"), ([(k, "kalo", None) for k in range(9)], "und"), ([(k, None, "aa") for k in range(9)], "und"), ([(k, "kalo", "aa") for k in range(9)], "aa")])
def test_few_languages(spark, rows, want):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.predict("some words")[0] == want
    assert langid.predict(df, model).count() == len(rows)


def test_query_on_a_table(spark):
    got = langid.op13_codes(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for h, i in zip(got.held_out, got.doc_id, strict=True))
    both = got.merge(docs, on="doc_id")
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.99
