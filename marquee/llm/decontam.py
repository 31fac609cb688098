"""Benchmark decontamination by winnowing.

Both sides keep, of every run of ``window - gram + 1`` consecutive word k-grams, the one with the least hash. Any span of
at least ``window`` words that a document shares with a benchmark item therefore holds a k-gram that both sides keep, so
the join of the kept fingerprints misses no such span; each joined fingerprint is then extended to the windows that hold it,
which count if the item has them, word by word. Items shorter than a window are one window of their own
length and are joined by the hash of all their words, at every position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_UPPER = bytes(range(65, 91))
_KEPT = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: bytes to lower case, and everything that is in no word to a space
_FOLD = bytes(b + 32 if b in _UPPER else b if b in _KEPT else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: candidate items that a document is checked against at once
_TOGETHER = 256


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive ids; ``_NONE`` where one of them is zero (no benchmark word, or a border)."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    m = len(ids) - n + 1
    h, good = np.zeros(m, np.uint64), np.ones(m, bool)
    for k in range(n):
        part = ids[k : k + m]
        h = h * _BASE + part
        good &= part != 0
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h[h == _NONE] = 0
    h[~good] = _NONE
    return h


def run_minima(h: np.ndarray, run: int) -> np.ndarray:
    """Least hash of every ``run`` consecutive ones."""
    m = len(h) - run + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    low = h[:m].copy()
    for k in range(1, run):
        np.minimum(low, h[k : k + m], out=low)
    return low


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys, where each one's values begin and the end, values by key)."""
    order = np.argsort(keys, kind="stable")
    names, first = np.unique(keys[order], return_index=True)
    return names, np.append(first, len(keys)), values[order]


def _of_item(h: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Hash of a window together with its item."""
    x = (h ^ (h >> np.uint64(31))) * _BASE + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@dataclass
class Index:
    """Winnowed fingerprints of some items, and all their windows, with the items' words for the check."""

    window: int
    gram: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    owners: list[list[str]] = field(default_factory=list)
    flat: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    #: k-gram -> items
    kept: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    #: (item, window) -> a place where it stands in ``flat``
    windows: tuple[np.ndarray, np.ndarray] | None = None
    #: by length of items that are shorter than a window: all words -> items, and where each item begins
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    begins: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @classmethod
    def of(cls, rows: list[tuple[str, bytes | None]], window: int, gram: int) -> Index:
        self = cls(window, gram)
        seen: dict[tuple[int, ...], int] = {}
        for owner, text in rows:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            if not ids:
                continue
            if ids not in seen:  # equal items are matched once
                seen[ids] = len(self.owners)
                self.owners.append([])
            if owner not in self.owners[seen[ids]]:
                self.owners[seen[ids]].append(owner)
        items = [np.array(ids, np.uint64) for ids in seen]
        sizes = np.array([len(x) for x in items], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        self.flat = np.concatenate(items) if items else self.flat
        run = window - gram + 1
        kept, at, whole = [], [], {}
        for number, ids in enumerate(items):
            if len(ids) < window:
                whole.setdefault(len(ids), []).append((int(gram_hashes(ids, len(ids))[0]), number))
                continue
            h = gram_hashes(ids, gram)
            own = np.unique(h[selected(h, run_minima(h, run), np.arange(len(h)), run)])
            kept.append((own, np.full(len(own), number)))
            w = gram_hashes(ids, window)
            at.append((_of_item(w, np.full(len(w), number)), self.begins[number] + np.arange(len(w))))
        if kept:
            self.kept = _groups(*(np.concatenate(x) for x in zip(*kept, strict=True)))
            keys, places = (np.concatenate(x) for x in zip(*at, strict=True))
            keys, first = np.unique(keys, return_index=True)
            self.windows = keys, places[first]
        for n, pairs in whole.items():
            self.short[n] = _groups(np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int64))
        return self


def selected(h: np.ndarray, low: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """Whether the k-gram at each position is the least of a run that holds it."""
    found = np.zeros(len(at), bool)
    for k in range(run):
        start = at - k
        ok = (start >= 0) & (start < len(low))
        found[ok] |= low[start[ok]] == h[at[ok]]
    return found


def _among(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of ``h`` that are among the sorted ``keys``, their slots there)."""
    at = np.nonzero(h != _NONE)[0]
    slot = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    good = keys[slot] == h[at]
    return at[good], slot[good]


def _joined(at: np.ndarray, slot: np.ndarray, groups: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, item) for each item of a position's group, some at a time."""
    _, first, values = groups
    many = first[slot + 1] - first[slot]
    done = np.cumsum(many)
    cut = 0
    while cut < len(at):
        end = max(cut + 1, int(np.searchsorted(done, (done[cut - 1] if cut else 0) + 500_000, "right")))
        m = many[cut:end]
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(at[cut:end], m), values[np.repeat(first[slot[cut:end]], m) + inner]
        cut = end


def _equal(index: Index, ids: np.ndarray, s: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    same = np.ones(len(s), bool)
    for k in range(n):
        same &= ids[s + k] == index.flat[place + k]
    return same


def _search(index: Index, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word + 1, item) of every window that an item holds, over ids of many documents with zeros between them.

    Each fingerprint that both sides keep is extended to the windows that hold it; all that are the item's count. The work is
    linear in the joined fingerprints, however often a window repeats within the item."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    run = index.window - index.gram + 1
    if index.kept and len(ids) >= index.window:
        h = gram_hashes(ids, index.gram)
        at, slot = _among(index.kept[0], h)
        keep = selected(h, run_minima(h, run), at, run)
        wide = gram_hashes(ids, index.window)
        keys, places = index.windows
        for p, number in _joined(at[keep], slot[keep], index.kept):
            s = (p[:, None] - np.arange(run)).ravel()
            number = np.repeat(number, run)
            ok = (s >= 0) & (s < len(wide))
            s, number = s[ok], number[ok]
            ok = wide[s] != _NONE
            s, number = s[ok], number[ok]
            name = _of_item(wide[s], number)
            slots = np.minimum(np.searchsorted(keys, name), len(keys) - 1)
            ok = keys[slots] == name
            s, number, place = s[ok], number[ok], places[slots[ok]]
            ok = _equal(index, ids, s, place, index.window)
            found.append((s[ok], s[ok] + index.window, number[ok]))
    for n, groups in index.short.items():
        for p, number in _joined(*_among(groups[0], gram_hashes(ids, n)), groups):
            ok = _equal(index, ids, p, index.begins[number], n)
            found.append((p[ok], p[ok] + n, number[ok]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _found(index: Index, texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """(number of words, merged spans, sorted items) of each text; some megabytes are searched at a time."""
    look = index.vocabulary.get
    at = 0
    while at < len(texts):
        parts, starts, sizes, size = [np.zeros(1, np.uint64)], [], [], 1
        while at < len(texts) and size < 1_000_000:
            w = words(texts[at])
            starts.append(size)
            sizes.append(len(w))
            parts += [np.fromiter((look(x, 0) for x in w), np.uint64, len(w)), np.zeros(1, np.uint64)]
            size += len(w) + 1
            at += 1
        first, last, number = _search(index, np.concatenate(parts))
        row = np.searchsorted(starts, first, "right") - 1
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(len(starts) + 1))
        for k, n in enumerate(sizes):
            mine = order[cuts[k] : cuts[k + 1]]
            if not len(mine):
                yield n, [], []
                continue
            spans = np.unique(np.stack([first[mine], last[mine]], 1) - starts[k], axis=0)
            yield n, merge(spans.tolist()), sorted({o for x in np.unique(number[mine]).tolist() for o in index.owners[x]})


def _columns(rows: list[tuple[int, list[tuple[int, int]], list[str]]]) -> list[pa.Array]:
    spans = [[{"start": a, "end": b} for a, b in s] for _, s, _ in rows]
    return [pa.array([n for n, _, _ in rows], pa.int64()), pa.array(spans, _SPANS), pa.array([i for _, _, i in rows], pa.list_(pa.string()))]


def _scan(shared):
    """Rows with what one index finds in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            rows = list(_found(shared.value, common.binary_list(batch.column(names.index("text")))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(rows)], names=[*names, "n_words", "spans", "items"])

    return run


# --------------------------------------------------------------------------------------------------------------
# benchmarks of any size: fingerprints meet in an exchange
# --------------------------------------------------------------------------------------------------------------


def _named(text: bytes | None, known: dict[bytes, int]) -> np.ndarray:
    """Words by 64-bit hashes, as both sides of an exchange can tell them."""
    out = words(text)
    for w in out:
        if w not in known:
            if len(known) >= 200_000:
                known.clear()
            known[w] = xxhash.xxh64_intdigest(w) or 1
    return np.fromiter((known.get(w) or xxhash.xxh64_intdigest(w) or 1 for w in out), np.uint64, len(out))


def _prints(window: int, gram: int, lengths: tuple[int, ...] | None):
    """(n, print, key): kept k-grams (n = 0); of items (``lengths`` None) shorter than a window all words at once, of documents all runs of
    those lengths. Columns in: key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), common.binary_list(batch.column(1)), strict=True):
                ids = _named(text, known)
                out = []
                if len(ids) >= window:
                    h = gram_hashes(ids, gram)
                    out.append((0, np.unique(h[selected(h, run_minima(h, window - gram + 1), np.arange(len(h)), window - gram + 1)])))
                elif lengths is None and len(ids):
                    out.append((len(ids), gram_hashes(ids, len(ids))))
                out += [(n, np.unique(gram_hashes(ids, n))) for n in lengths or ()]
                for n, prints in out:
                    for at in range(0, len(prints), 50_000):
                        part = prints[at : at + 50_000].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), n, np.int32)), pa.array(part), pa.array(np.full(len(part), key, np.int64))], names=["n", "print", "key"])

    return run


def _checked(window: int, gram: int):
    """(text, its candidates) to what really occurs. Columns in: t1, t2, text, candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, items in zip(common.binary_list(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                index = Index.of([(i["item"], i["text"].encode()) for i in items], window, gram)
                rows += _found(index, [text])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_columns(rows)[1:]], names=["t1", "t2", "spans", "items"])

    return run


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the words, and merges what several sets of candidates have found."""
    for batch in batches:
        names = batch.schema.names
        texts, spans, items = common.binary_list(batch.column(names.index("text"))), batch.column(names.index("_spans")).to_pylist(), batch.column(names.index("_items")).to_pylist()
        rows = [(len(words(t)), merge([(x["start"], x["end"]) for part in s or [] for x in part]), sorted({x for part in i or [] for x in part})) for t, s, i in zip(texts, spans, items, strict=True)]
        keep = [n for n in names if n not in ("_spans", "_items")]
        yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in keep), *_columns(rows)], names=[*keep, "n_words", "spans", "items"])


def _by_exchange(frame: DataFrame, bench: DataFrame, window: int, gram: int, schema: str) -> DataFrame:
    """Documents and items that share a fingerprint meet by a join of the fingerprints; a document's candidates are then checked by
    at most ``_TOGETHER`` at a time. Texts that no item shares a fingerprint with are not exchanged before the last join."""
    kind = "n int, print long, key long"
    bench = common.stage(bench.distinct().withColumn("key", F.xxhash64("item", "text")), "bench")
    of_items = common.stage(bench.select("key", "text").mapInArrow(common.in_slices(_prints(window, gram, None)), kind), "bench_prints")
    lengths = tuple(sorted(r["n"] for r in of_items.where("n > 0").select("n").distinct().collect()))  # fewer than a window
    t = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
    of_docs = frame.select(F.xxhash64("text").alias("t1"), "text").where("text is not null").mapInArrow(common.in_slices(_prints(window, gram, lengths)), kind)
    pairs = common.stage(of_docs.toDF("n", "print", "t1").join(of_items, ["n", "print"]).select("t1", "key").distinct(), "bench_pairs")
    many = pairs.groupBy("t1").agg(F.ceil(F.count("*") / _TOGETHER).alias("sets"))
    dealt = pairs.join(many, "t1").withColumn("part", F.pmod(F.xxhash64("key"), F.col("sets")))
    sets = dealt.join(bench, "key").groupBy("t1", "part").agg(F.collect_list(F.struct("item", "text")).alias("candidates"))
    texts = frame.select(*t, "text").join(many, "t1", "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    found = texts.join(sets, "t1").select("t1", "t2", "text", "candidates").mapInArrow(common.in_slices(_checked(window, gram), 16), "t1 long, t2 long, spans array<struct<start:long,end:long>>, items array<string>")
    found = found.where(F.size("items") > 0).groupBy("t1", "t2").agg(F.collect_list("spans").alias("_spans"), F.collect_list("items").alias("_items"))
    names = frame.columns
    keyed = frame.select(F.struct(*names).alias("_row"), *t).join(common.stage(found, "bench_found"), ["t1", "t2"], "left")
    return keyed.select(*(F.col("_row")[n].alias(n) for n in names), "_spans", "_items").mapInArrow(common.in_slices(_joined_up), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *, item_col: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 5, block_bytes: int = 8 << 20, drop_text: bool = False) -> DataFrame:
    """``docs`` with n_words, spans (word positions of merged hits, end exclusive) and items (ids of items with an
    occurring window, as strings, sorted).

    The benchmark's size is measured first. Up to ``block_bytes`` of text its fingerprints go to the executors as one
    index; those of a larger one are joined with the documents' fingerprints in an exchange, which finds the same.

    Null or empty texts have no words and no hits; items without words, or with a null id, never hit (a null id has no
    name to report). Repeated items hit once each, repeated rows are answered alike. Very long texts are searched whole, in time linear
    in their words. Empty tables give no hits or no rows. Of the documents' columns those
    named n_words, spans or items are replaced; all others, whatever their names, stay as they are.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram is 1 to window")
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    size = bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    frame = docs.drop("n_words", "spans", "items")
    if text_col != "text":
        frame = frame.drop("text").withColumn("text", F.col(text_col))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields]
    schema = ", ".join([*kinds, _FOUND])
    if size <= block_bytes:
        index = Index.of([(r["item"], r["text"].encode()) for r in bench.toLocalIterator()], window, gram)
        frame = frame.mapInArrow(common.in_slices(_scan(docs.sparkSession.sparkContext.broadcast(index))), schema)
    else:
        frame = _by_exchange(frame, bench, window, gram, schema)
    return frame.drop("text") if drop_text or text_col != "text" else frame


def n_hit(spans="spans"):
    return F.aggregate(F.transform(spans, lambda s: s["end"] - s["start"]), F.lit(0).cast("long"), lambda a, x: a + x)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op5_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    found = contamination(docs, common.table(spark, sf_dir, "benchmark"), drop_text=True)
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )
