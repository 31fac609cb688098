"""Spelling variants: words within one inserted, deleted or replaced letter, grouped under their frequent forms.

Two words are one edit apart just where they share a string that is left after a deletion: the same string after deleting the same place of both (a
replaced letter), or the shorter word itself (an inserted one). These strings are never built to be exchanged. A polynomial hash of a word's
prefix and one of its suffix give the hash of each deletion in constant time, for a batch of words at once in NumPy. The hashes are dealt by their
leading digits and sorted, so that equal ones lie together; words that meet by hash are then compared by their strings.

The words that share a deletion at one place differ in that letter alone, so there are no more of them than letters; each group is told in one row a
member, not in pairs. Words of more than ``LONG`` letters would repeat their strings too often: their deletions travel as two hashes, and
the pairs that they give are looked up and compared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = 64
#: odd multipliers of the two hashes, and their inverses modulo 2^64
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_INVERSES = np.array([pow(int(b), -1, 1 << 64) for b in _BASES], np.uint64)
_PIECE = 1 << 20
_FLUSH = 300_000


def runs(text: str | None) -> Iterator[str]:
    """Maximal runs of letters of a whole text, found a piece at a time; a piece ends where no run is open."""
    at, text = 0, text or ""
    while at < len(text):
        end = at + _PIECE
        if end < len(text) and (more := _RUN.match(text, end)):
            end = more.end()
        yield from _RUN.findall(text, at, end)
        at = end


def noisy(ident: str | None, run: str, every: int = 31) -> str:
    """The run in lower case (A-Z only), with a letter deleted where the hash of document and run says so; without an id never."""
    low = run.lower() if run.isascii() else run.translate(_UPPER)
    if ident is None:
        return low
    h = zlib.crc32(f"{ident}:{low}".encode())
    if h % every:
        return low
    k = h % len(low)
    return low[:k] + low[k + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 7, occurrences: int = 2, every: int | None = 31) -> DataFrame:
    """(word, n): words of ``least`` letters or more that occur ``occurrences`` times or more, counted over all whole texts. ``every``: one in so many
    runs of a document gets a misspelling (None: none)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        found: Counter = Counter()
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for run, n in Counter(runs(text)).items():
                    if len(run) >= least:
                        word = noisy(ident if every else None, run, every or 1)
                        if len(word) >= least:
                            found[word] += n
                if len(found) > _FLUSH:
                    yield out(found)
                    found = Counter()
        yield out(found)

    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(common.in_slices(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def deletion_hashes(words: list[str], which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole, keys, place, first) of the words laid end to end: the hash of each whole word, and for each letter the hash of its word without it, its
    place, and whether the letter before it is another one, so that the deletion isn't told twice.

    The hash of letters c0 c1 ... is the sum of mix(c_k) * base^k, so that a suffix moved by one place is its hash over the base."""
    base, inverse = _BASES[which], _INVERSES[which]
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(letters)) - starts[of]
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(int(sizes.max(initial=1)) - 1, 0), base, np.uint64)]), dtype=np.uint64)
    mixed = (letters + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    term = (mixed ^ (mixed >> np.uint64(29))) * powers[place]
    upto = np.cumsum(term, dtype=np.uint64)  # wraps, as all sums and products here
    before = np.concatenate([np.zeros(1, np.uint64), upto])[starts]
    prefix = upto - term - before[of]
    whole = np.concatenate([np.zeros(1, np.uint64), upto])[starts + sizes] - before
    keys = prefix + (whole[of] - prefix - term) * inverse
    first = np.ones(len(letters), bool)
    first[1:] = (letters[1:] != letters[:-1]) | (place[1:] == 0)
    return whole, keys, place, first


def _digits(key: str) -> F.Column:
    return F.shiftrightunsigned(key, 44)


def _short_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word (place -1) and each of its deletions; ``first`` where a deletion is not told by the place before."""
    for batch in batches:
        words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        if not words:
            continue
        whole, keys, place, first = deletion_hashes(words, 0)
        of = np.repeat(np.arange(len(words)), [len(w) for w in words])
        index = np.concatenate([np.arange(len(words)), of])
        columns = np.concatenate([whole, keys]).view(np.int64), np.concatenate([np.full(len(words), -1), place]).astype(np.int32), np.concatenate([np.ones(len(words), bool), first])
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(0).take(pa.array(index)), pa.array(n[index])], names=["key", "place", "first", "word", "n"])


def _best(members: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The two members that come first by number, then by letters; members are (-n, word)."""
    return sorted(members)[:2]


def _told(rows: list[tuple[int, bool, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, number of near words, -n of the first of them, that word) for the rows (place, first, word, n) of one hash."""
    by_string: dict[str, tuple[list, dict[int, list]]] = {}
    for place, first, word, n in rows:
        whole, at = by_string.setdefault(word if place < 0 else word[:place] + word[place + 1 :], ([], {}))
        if place < 0:
            whole.append((-n, word))
        else:
            at.setdefault(place, []).append((-n, word, first))
    for whole, at in by_string.values():
        for members in at.values():
            if len(members) > 1:  # they differ in the letter at this place
                top = _best([m[:2] for m in members])
                for _, word, _ in members:
                    yield word, len(members) - 1, *top[top[0][1] == word]
        if whole:
            longer = [m[:2] for members in at.values() for m in members if m[2]]
            if longer:
                yield whole[0][1], len(longer), *min(longer)
                for _, word in longer:
                    yield word, 1, *whole[0]


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of rows that are sorted by hash. A hash of one row is passed over; the last one of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = rows.column("key").to_numpy()
        if len(key) < 2:
            return
        same = key[1:] == key[:-1]
        some = np.nonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))[0]
        key = key[some]
        rows = rows.select(["place", "first", "word", "n"]).take(pa.array(some))
        plain = list(zip(*(c.to_pylist() for c in rows.columns), strict=True))
        cuts = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)] if len(key) else [0]
        out = [found for a, b in zip(cuts, cuts[1:]) for found in _told(plain[a:b])]  # noqa: B905
        if out:
            word, many, first, form = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(many, pa.int64()), pa.array(first, pa.int64()), pa.array(form)], names=["word", "n_near", "minus_n", "near"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last or (held and held[0].column(0)[0].as_py() != key[-1]):
            yield from told(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield from told(pa.Table.from_batches(held))


def _near_short(vocab: DataFrame) -> DataFrame:
    """(word, n_near, minus_n, near) for words up to ``LONG`` letters, in parts that are still to be added up."""
    keys = vocab.where(F.length("word") <= LONG).mapInArrow(common.in_slices(_short_keys, 20_000), "key long, place int, first boolean, word string, n long")
    dealt = keys.repartition(_digits("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(common.in_slices(_sorted_groups, 50_000), "word string, n_near long, minus_n long, near string")


def _long_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_short_keys``, with two hashes of each deletion and two of its word in place of the word."""
    for batch in batches:
        for word, w1, w2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            (whole, keys, place, first), (whole2, keys2, _, _) = (deletion_hashes([word], k) for k in (0, 1))
            for at in range(0, len(word) + 1, 50_000):
                s = slice(at, at + 50_000)
                columns = [np.concatenate(x)[s] for x in ((whole.view(np.int64), keys.view(np.int64)), (whole2.view(np.int64), keys2.view(np.int64)), ([-1], place), ([True], first))]
                m = len(columns[0])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(m, w1)), pa.array(np.full(m, w2)), pa.array(np.full(m, len(word)))], names=["key", "key2", "place", "first", "w1", "w2", "size"])


def one_edit(x: str, y: str) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced between x and y."""
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    k = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))  # noqa: B905
    return x[k + (len(x) >= len(y)) :] == y[k + (len(y) >= len(x)) :]


def _near_long(vocab: DataFrame) -> DataFrame:
    """As ``_near_short``, for pairs of which one word at least is longer than ``LONG`` letters."""
    words = vocab.where(F.length("word") >= LONG).select("word", F.xxhash64("word").alias("w1"), F.xxhash64(F.lit(1), "word").alias("w2"), "n")
    keys = words.select("word", "w1", "w2").mapInArrow(common.in_slices(_long_keys, 16), "key long, key2 long, place long, first boolean, w1 long, w2 long, size long")
    keys = common.stage(keys, "long_keys")
    a, b = keys, keys.select("key", "key2", *(F.col(c).alias(f"b_{c}") for c in ("place", "first", "w1", "w2", "size")))
    replaced = (F.col("size") == F.col("b_size")) & (F.col("place") == F.col("b_place")) & (F.col("place") >= 0) & (F.col("w1") != F.col("b_w1")) & (F.col("size") > LONG)
    inserted = (F.col("place") < 0) & (F.col("b_place") >= 0) & F.col("b_first") & (F.col("b_size") == F.col("size") + 1)
    # no more rows share a deletion's hashes and place than there are letters
    pairs = a.join(b, ["key", "key2"]).where(replaced | inserted).select("w1", "w2", "b_w1", "b_w2").distinct()
    x = words.select("w1", "w2", F.col("word").alias("x"), F.col("n").alias("x_n"))
    y = words.select(F.col("w1").alias("b_w1"), F.col("w2").alias("b_w2"), F.col("word").alias("y"), F.col("n").alias("y_n"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([one_edit(p, q) for p, q in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.bool_()))

    found = pairs.join(x, ["w1", "w2"]).join(y, ["b_w1", "b_w2"]).select("x", "x_n", "y", "y_n")
    found = found.mapInArrow(common.in_slices(verify, 16), "x string, x_n long, y string, y_n long")
    both = found.unionByName(found.selectExpr("y x", "y_n x_n", "x y", "x_n y_n")).distinct()
    return both.select(F.col("x").alias("word"), F.lit(1).cast("long").alias("n_near"), (-F.col("y_n")).alias("minus_n"), F.col("y").alias("near"))


def variants(vocab: DataFrame, ratio: int = 10) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) for each word of ``vocab`` (word, n; a staged table). n_near counts the words one edit away; form is the
    most frequent of them (ties: the first by code points) if it is ``ratio`` times as frequent or more, else null; root follows forms to the last.

    A form is ``ratio`` times as frequent as its word, so chains of forms have few links. Words of any length are compared whole; null words have no row;
    an empty table gives no rows."""
    known = vocab.where("word is not null")
    near = _near_short(known)
    if not known.where(F.length("word") > LONG).isEmpty():
        near = near.unionByName(_near_long(known))
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "near")).alias("best"))
    of = known.join(best, "word", "left")
    is_form = -F.col("best.minus_n") >= ratio * F.col("n")
    told = of.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus_n")).alias("form_n"))
    told = common.stage(told, "forms")
    links = told.where("form is not null").select("word", F.col("form").alias("root"))
    roots = common.stage(links, "roots")
    while True:  # each round doubles the links that a word has followed
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, moved = roots, common.stage(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        more = not moved.where("moved").isEmpty()
        common.drop(before)
        roots = moved
        if not more:
            break
    return told.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_deletions(spark, sf_dir: str) -> DataFrame:
    """Documents without an id are counted with the runs as they are."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return variants(common.stage(vocabulary(docs), "vocabulary"))
