"""Language identification by error-correcting output codes.

Each language has a codeword; for each of its bits a binary classifier over hashed character n-grams tells the languages with a one from those
with a zero. A text gets the language whose codeword its bits fit with the least loss, where each bit counts for a language as much as it was
right on that language's own sample (loss-weighted decoding). Single wrong bits are thus outvoted, and a text between two codewords is flagged.

N-grams are of the text's words in lower case, a word being a run of letters of any script, with a border mark on both sides. What is learnt comes
from about ``per_lang`` rows of each language, those with the least hashes; prediction reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
#: characters hashed at a time
_PIECE = 1 << 18
#: a text's n-grams share this many votes, in whole numbers, so that sums don't depend on their order
_VOTES = 1 << 24
_MIX = np.uint64(0x9E3779B97F4A7C15)


def code_matrix(n: int) -> np.ndarray:
    """A codeword of -1 and 1 for each of ``n`` languages. Up to five: every way to part them (2^(n-1) - 1 bits). More: 15 bits for each doubling,
    the best of 200 drawn matrices by the least distance of two codewords."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        ways = np.arange(1, 2 ** (n - 1))
        return np.array([[1 if k == 0 or not (w >> (k - 1)) & 1 else -1 for w in ways] for k in range(n)], np.int8)
    rng, best, found = np.random.default_rng(n), -1, None
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, 15 * int(np.ceil(np.log2(n)))))
        gram = m.astype(np.float32) @ m.T
        least = (m.shape[1] - gram[~np.eye(n, dtype=bool)].max()) / 2
        if least > best and (np.abs(m.sum(axis=0)) < n).all():
            best, found = least, m
    if found is None:
        raise ValueError(f"no code for {n} languages")
    return found


def pieces(text: str | None, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a whole text, a piece of it at a time; nothing for a text without a letter."""
    if not text or not _LETTER.search(text):
        return
    words = _OTHER.sub(" ", text.lower()).strip()
    reach, shift = max(ORDERS) - 1, np.uint64(64 - (buckets - 1).bit_length())
    marked = f" {words} "
    for at in range(0, len(marked), _PIECE):
        points = np.frombuffer(marked[at : at + _PIECE + reach].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h, out = np.zeros(len(points), np.uint64), []
        for order in ORDERS:
            n = min(len(points) - order + 1, _PIECE)
            if n <= 0:
                break
            h = (h[: len(points) - order + 1] + points[order - 1 :] + np.uint64(order)) * _MIX
            h ^= h >> np.uint64(29)
            out.append((h[:n] * _MIX) >> shift)
        yield np.concatenate(out).astype(np.int64)


def votes(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, votes) of a text; they add up to about ``_VOTES`` for a text of any length."""
    seen = np.zeros(buckets, np.int64)
    for piece in pieces(text, buckets):
        seen += np.bincount(piece, minlength=buckets)
    at = np.nonzero(seen)[0]
    return at, (seen[at] * _VOTES) // max(1, int(seen.sum()))


@dataclass
class Model:
    """``table``: for each bucket and bit the log-odds of a one; ``slope``, ``offset``: of each bit's margin; ``trust``: for each language and
    bit the share of its own sample that the bit got right, adding up to one for each language."""

    langs: list[str]
    code: np.ndarray
    table: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray

    def margins(self, text: str | None) -> np.ndarray | None:
        """Mean log-odds of the text's n-grams for each bit; None without a letter."""
        total, n = np.zeros(self.code.shape[1]), 0
        for piece in pieces(text, len(self.table)):
            total += self.table[piece].sum(axis=0, dtype=np.float64)
            n += len(piece)
        return total / n if n else None

    def predict(self, text: str | None, tie: float = 0.1) -> tuple[str, float, str | None, bool]:
        """(language, score, second language, ambiguous). The score is the language's share of exp(-loss), losses counted in bits of the
        code; ``ambiguous``: the share of the second is within ``tie``. Equal losses: the language that comes first by name."""
        m = self.margins(text) if self.langs else None
        if m is None:
            return UNKNOWN, 0.0, None, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, None, False
        loss = (self.trust * np.logaddexp(0, -self.code * (self.slope * m + self.offset))).sum(axis=1) * self.code.shape[1]
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        order = np.argsort(loss, kind="stable")
        a, b = order[0], order[1]
        return self.langs[a], float(share[a]), self.langs[b], bool(share[a] - share[b] < tie)


def _platt(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (margin, side), by Newton steps on a loss with a small ridge. ``weight``: of each row."""
    scale = max(float(np.abs(m).mean()), 1e-9)
    x = np.stack([m / scale, np.ones(len(m))], axis=1)
    w, t = np.array([1.0, 0.0]), (y + 1) / 2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (weight * (p - t)) + 1e-3 * (w - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -4, 4)
    return float(max(w[0], 1e-3) / scale), float(w[1])


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fold: tuple[int, int] | None, per_lang: int) -> DataFrame:
    """(lang, text): about ``per_lang`` different (id, text) of each language, those with the least hashes, outside the held-out fold. Rows with
    null id, text or language are left out."""
    ident = F.col(id_col).cast("string")
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(ident, F.col(text_col).cast("string")).alias("h"), F.crc32(ident).alias("c"))
    rows = rows.where("lang is not null and text is not null and c is not null")
    if fold:
        rows = rows.where(F.pmod("c", F.lit(fold[0])) != fold[1])
    # one row for each language: their number is that of languages, not of rows
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    share = F.shiftrightunsigned("h", 11) / float(1 << 53)
    picked = rows.join(F.broadcast(sizes), "lang").where(share * F.col("n") < per_lang)
    return picked.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: tuple[int, int] | None = (3, 1), per_lang: int = 3000, buckets: int = 1 << 16) -> Model:
    """Count n-grams of the sample by language, set each bit's log-odds from the mean of its languages' smoothed shares, then fit each bit's logistic
    curve and each language's trust on the sample's margins. What comes to the driver is bounded: ``buckets`` numbers for each language and a
    number for each bit and row of the sample.

    Without labelled rows the model has no language and predicts ``und``; with one language only that one. Columns other than the named ones are
    ignored."""
    if buckets & (buckets - 1):
        raise ValueError("buckets is a power of two")
    rows = common.stage(sample(docs, id_col, text_col, lang_col, fold, per_lang), "lang_sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, list[int]]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = votes(text, buckets)
                total, texts = sums.setdefault(lang, (np.zeros(buckets, np.int64), [0]))
                total[at] += n
                texts[0] += bool(len(at))
        for lang, (total, texts) in sums.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(total[at], texts[0]))], names=["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, at, n = np.array(counted.column("lang").to_pylist(), object), counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    langs = sorted(set(names[(at < 0) & (n > 0)].tolist()))
    code = code_matrix(len(langs))
    bits = code.shape[1]
    share = np.zeros((len(langs), buckets))
    for k, lang in enumerate(langs):
        own = names == lang
        total = np.zeros(buckets)
        total[at[own & (at >= 0)]] = n[own & (at >= 0)] / _VOTES
        share[k] = (total + 1 / buckets) / (float(n[own & (at < 0)][0]) + 1)  # smoothed by one text of all buckets
    odds = np.stack([np.log(share[code[:, s] > 0].mean(axis=0)) - np.log(share[code[:, s] < 0].mean(axis=0)) for s in range(bits)], axis=1).astype(np.float32) if bits else np.zeros((buckets, 0), np.float32)
    even = Model(langs, code, odds, np.ones(bits), np.zeros(bits), np.full(code.shape, 1 / max(bits, 1)))
    if not bits:
        common.drop(rows)
        return even
    number = {lang: k for k, lang in enumerate(langs)}
    shared = docs.sparkSession.sparkContext.broadcast(even)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(number[lang], m.tolist()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if lang in number and (m := shared.value.margins(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([m for _, m in found], pa.list_(pa.float64()))], names=["lang", "margins"])

    seen = rows.select("lang", "text").mapInArrow(common.in_slices(measure), "lang int, margins array<double>").toArrow()
    common.drop(rows)
    of = seen.column("lang").to_numpy()
    m = np.array(seen.column("margins").to_pylist(), float).reshape(len(of), bits)
    order = np.lexsort((*m.T, of))  # the same sums however tasks were dealt
    of, m = of[order], m[order]
    weight = 1 / np.bincount(of, minlength=len(langs))[of]
    curves = np.array([_platt(m[:, s], code[of, s].astype(float), weight) for s in range(bits)])
    slope, offset = curves[:, 0], curves[:, 1]
    right = code[of] * (slope * m + offset) > 0
    trust = np.stack([right[of == k].mean(axis=0) for k in range(len(langs))])
    return Model(langs, code, odds, slope, offset, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9))


def predict(docs: DataFrame, model: Model, text_col: str = "text", tie: float = 0.1, keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), second (the next language) and ambiguous, from each whole text alone. Null texts and texts without a
    letter: ``und``, 0, null, false. Equal texts are told alike, repeated rows one each; an empty table gives no rows. Columns of
    these names are replaced, others stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.drop("lang_pred", "score", "second", "ambiguous")
    names = [c for c in frame.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names
            found = [shared.value.predict(t, tie) for t in batch.column(at.index(text_col)).to_pylist()]
            kinds = pa.string(), pa.float64(), pa.string(), pa.bool_()
            told = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at.index(n)) for n in names), *told], names=[*names, "lang_pred", "score", "second", "ambiguous"])

    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    return frame.mapInArrow(common.in_slices(run), ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "lang_pred string, score double, second string, ambiguous boolean"]))


def op13_codes(spark, sf_dir: str) -> DataFrame:
    """A row without an id is not learnt from and counts as not held out."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs)
    told = predict(docs.drop("lang"), model, keep_text=False)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return told.select("doc_id", held.alias("held_out"), "lang_pred", "score", "second", "ambiguous")
