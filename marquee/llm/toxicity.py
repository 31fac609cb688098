"""Toxicity: a counterfactually regularised linear classifier.

Features of a text are its words and their beginnings, present or absent. The loss is the logistic loss of the labelled
rows, a ridge term, and a counterfactual term: in each labelled sentence that names a group, the group's term is swapped
for each other one of its line, and the squared change of the text's score is penalised, each swap counting as often as it can be made. A term that
only co-occurs with toxic labels thus gets no weight of its own, and neutral mentions don't raise the score.

What is learnt comes from at most ``max_rows`` labelled rows (those with the least hash of their id); the feature
statistics and the fit both read that sample alone. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: terms that name groups of people, by language; a swap stays within a line. Fixed values.
IDENTITY_TERMS = (
    ("women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "gays", "lesbians", "blacks", "whites", "asians"),
    ("woman", "man", "muslim", "christian", "jewish", "hindu", "immigrant", "refugee", "gay", "lesbian", "black", "white", "asian", "transgender", "disabled"),
    ("frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "schwule", "lesben"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "gays", "lesbiennes"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "gays", "lesbianas"),
)
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_PREFIXES = (3, 4, 5, 6)
#: longer words are named by a digest of the whole word, and no worker remembers them
_LONG = 32
_CACHE = 100_000


def word_features(word: str) -> list[str]:
    whole = f"={word}" if len(word) <= _LONG else f"#{xxhash.xxh3_128_hexdigest(word)}"
    return [whole, *(f"{n}{word[:n]}" for n in _PREFIXES if len(word) >= n)]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(text: str | None) -> set[str]:
    return {f for w in words(text) for f in word_features(w)}


def swaps(text: str | None) -> Counter[tuple[frozenset[str], frozenset[str]]]:
    """(features that the text loses, features that it gains) by the swap of a group term for another in one of its sentences -> number
    of such swaps. What other words of the text have, it neither loses nor gains."""
    sentences = [Counter(_WORD.findall(x)) for x in _SENTENCE.findall((text or "").lower())]
    named = [(k, line, a) for k, here in enumerate(sentences) for line in IDENTITY_TERMS for a in here.keys() & line]
    if not named:
        return Counter()
    #: how many sentences have a word; how many words of the text have a feature
    within = Counter(w for here in sentences for w in here)
    bearing = Counter(f for w in within for f in word_features(w))
    found: Counter[tuple[frozenset[str], frozenset[str]]] = Counter()
    for _, line, a in named:
        gone = set(word_features(a)) if within[a] == 1 else set()  # else it stands in another sentence still
        for b in line:
            if b != a:
                come = set(word_features(b)) if b not in within else set()
                found[frozenset(f for f in gone - come if bearing[f] == 1), frozenset(f for f in come - gone if f not in bearing)] += 1
    return found


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function of whole texts. Words seen before are looked up; the cache is emptied when full."""
        known = self.weights
        cache: dict[str, tuple[str, ...]] = {}

        def score(text: str | None) -> float:
            hits: set[str] = set()
            for w in words(text):
                if (f := cache.get(w)) is None:
                    f = tuple(x for x in word_features(w) if x in known)
                    if len(w) <= _LONG:
                        if len(cache) >= _CACHE:
                            cache.clear()
                        cache[w] = f
                if f:
                    hits.update(f)
            z = self.bias + sum(known[f] for f in sorted(hits))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


Swap = tuple[int, tuple[int, ...], tuple[int, ...], int]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def loss_and_gradient(theta: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray], changes: tuple[np.ndarray, ...], counterfactual: float, ridge: float) -> tuple[float, np.ndarray]:
    """Of the mean logistic loss, ``ridge`` times the squared weights per row, and ``counterfactual`` times the mean squared change of the
    score. ``theta``: weights and bias. ``rows``: flat feature numbers, the row of each, labels. ``changes``: the row and the number of each
    swap, then flat feature numbers, the swap of each, and -1 or 1."""
    w, b = theta[:-1], theta[-1]
    flat, of, y = rows
    z = b + np.bincount(of, w[flat], len(y))
    p = _sigmoid(z)
    g = (p - y) / len(y)
    loss = float(np.mean(np.logaddexp(0, z) - y * z) + ridge * (w @ w) / len(y))
    grad_w = 2 * ridge * w / len(y)
    base, many, c_flat, c_of, sign = changes
    if len(base):
        share = many / many.sum()
        z2 = z[base] + np.bincount(c_of, sign * w[c_flat], len(base))
        p2 = _sigmoid(z2)
        change = p2 - p[base]
        loss += float(counterfactual * (share @ change**2))
        outer = 2 * counterfactual * share * change
        after = outer * p2 * (1 - p2)
        g = g + np.bincount(base, after - outer * p[base] * (1 - p[base]), len(y))
        grad_w = grad_w + np.bincount(c_flat, sign * after[c_of], len(w))
    return loss, np.append(np.bincount(flat, g[of], len(w)) + grad_w, g.sum())


def fit(rows: list[tuple[list[int], int]], swapped: list[Swap], n_features: int, *, counterfactual: float = 1.0, ridge: float = 5e-3, steps: int = 400, rate: float = 0.25) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam. ``rows``: (feature numbers, label); ``swapped``: (row, numbers that leave, numbers that come, how often)."""
    if not rows:
        return np.zeros(n_features), -3.0
    y = np.array([r[1] for r in rows], float)
    if y.min() == y.max():  # one class only: its rate is all there is to know
        return np.zeros(n_features), 6.0 if y[0] else -6.0
    flat = np.array([f for r in rows for f in r[0]], np.int64)
    data = flat, np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), y
    sizes = [len(a) + len(c) for _, a, c, _ in swapped]
    changes = (
        np.array([r for r, *_ in swapped], np.int64),
        np.array([n for *_, n in swapped], float),
        np.array([f for _, a, c, _ in swapped for f in (*a, *c)], np.int64),
        np.repeat(np.arange(len(swapped)), sizes) if swapped else np.empty(0, np.int64),
        np.array([s for _, a, c, _ in swapped for s in (*[-1.0] * len(a), *[1.0] * len(c))]),
    )
    theta = np.append(np.zeros(n_features), np.log(y.mean() / (1 - y.mean())))
    m = v = np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        grad = loss_and_gradient(theta, data, changes, counterfactual, ridge)[1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str, fold: tuple[int, int] | None) -> DataFrame:
    """(label, text) of the at most ``max_rows`` labelled documents with the least hash of their id (ties: the least id), outside the
    held-out fold. Ids labelled 0 and 1 both count as 1; null ids or labels are left out; of documents that share an id the text
    with the least hash stands for all."""
    lab = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    if fold:
        lab = lab.where(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(fold[0])) != fold[1])
    lab = lab.groupBy("id").agg(F.max("label").alias("label"))
    # the bound makes this side small whatever the tables' size: max_rows ids of 12 bytes
    few = lab.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    once = text.join(F.broadcast(few), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return common.stage(once, "labelled")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: tuple[int, int] | None = (4, 2), max_rows: int = 20_000, features_per_100_rows: int = 10, counterfactual: float = 1.0) -> Model:
    """Fit on the sample: one pass counts features by label and ranks them by the likelihood ratio statistic; the first of them are kept, in proportion to
    the rows of the sample (and all features of group terms, so that the counterfactual term reaches them). One pass gathers the
    sample's kept features, and the driver fits; the ridge term holds down what a small sample can't tell. Both results are bounded by ``max_rows``.

    Without rows of both labels the model has no features and a score on the side of the one label, the lower without any. Null and
    empty texts are rows without features. Columns other than the named ones are ignored."""
    rows = sample(docs, labels, max_rows, id_col, text_col, label_col, fold)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(positive: Counter, negative: Counter) -> pa.RecordBatch:
            names = list(positive.keys() | negative.keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([positive[n] for n in names], pa.int64()), pa.array([negative[n] for n in names], pa.int64())], names=["feature", "positive", "negative"])

        tally = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tally[1 - label].update(features(text))
                if len(tally[0]) + len(tally[1]) > 1_000_000:
                    yield out(*tally)
                    tally = (Counter(), Counter())
        yield out(*tally)

    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model({}, 6.0 if n1 else -6.0)
    seen = rows.select("text", "label").mapInArrow(common.in_slices(count), "feature string, positive long, negative long").groupBy("feature").agg(F.sum("positive").alias("p"), F.sum("negative").alias("q"))
    total, a, c = n1 + n0, F.col("p"), F.col("q")

    def term(x, expected):
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    of = a + c
    g2 = 2 * (term(a, of * (n1 / total)) + term(c, of * (n0 / total)) + term(n1 - a, (total - of) * (n1 / total) + 1e-9) + term(n0 - c, (total - of) * (n0 / total) + 1e-9))
    top = seen.withColumn("g2", g2).orderBy(F.desc("g2"), F.desc(F.col("feature").startswith("=")), "feature").limit(-(-total * features_per_100_rows // 100)).select("feature").collect()
    names = sorted({r["feature"] for r in top} | {f for line in IDENTITY_TERMS for t in line for f in word_features(t)})
    number = {f: k for k, f in enumerate(names)}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.list_(pa.int32())
        pair = pa.list_(pa.struct([("leave", numbers), ("come", numbers), ("times", pa.int32())]))
        for batch in batches:
            kept, swapped = [], []
            for text in batch.column(0).to_pylist():
                kept.append(sorted(number[f] for f in features(text) if f in number))
                merged: Counter[tuple[tuple[int, ...], tuple[int, ...]]] = Counter()
                for change, n in swaps(text).items():
                    merged[tuple(tuple(sorted(number[f] for f in side if f in number)) for side in change)] += n
                swapped.append([{"leave": a, "come": c, "times": n} for (a, c), n in sorted(merged.items())])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(kept, numbers), pa.array(swapped, pair)], names=["label", "kept", "changes"])

    data = rows.select("text", "label").mapInArrow(common.in_slices(gather), "label int, kept array<int>, changes array<struct<leave:array<int>,come:array<int>,times:int>>").toArrow()
    # a fixed order, so that the fit doesn't depend on how tasks were dealt
    lines = sorted(((x["kept"], x["label"], [(c["leave"], c["come"], c["times"]) for c in x["changes"]]) for x in data.to_pylist()), key=repr)
    swapped = [(k, tuple(a), tuple(c), n) for k, (_, _, found) in enumerate(lines) for a, c, n in found if a or c]
    w, b = fit([(f, y) for f, y, _ in lines], swapped, len(names), counterfactual=counterfactual)
    return Model({f: float(w[k]) for f, k in number.items() if w[k] != 0.0}, b)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep_text: bool = True) -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text, however long; null and empty texts get the score of no feature. Equal texts get equal
    scores, repeated rows one each; an empty table gives no rows. A column of the score's name is replaced, others stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.drop(score_col)
    names = [c for c in frame.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = shared.value.scorer()
        for batch in batches:
            at = batch.schema.names
            scores = pa.array([rate(t) for t in batch.column(at.index(text_col)).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(at.index(n)) for n in names), scores], names=[*names, score_col])

    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    return frame.mapInArrow(common.in_slices(run), ", ".join([*(f"`{n}` {kinds[n]}" for n in names), f"`{score_col}` double"]))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """A document without an id is not learnt from and counts as not held out."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    scored = score(docs, model, keep_text=False)
    return scored.select(
        "doc_id",
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
