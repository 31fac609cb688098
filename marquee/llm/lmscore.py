"""Cross-entropy difference of two matched n-gram models (target against background).

Both are bigram models over one vocabulary (all words of the corpus), smoothed alike: the target from documents labelled as
wanted, the background from all documents. A document's score is the mean over its tokens of
log p_target - log p_background; it is high where a text looks more like the target than like the corpus at large.

p(w | v) = (c(v, w) + a) / (c(v) + a K), with K words in the vocabulary; a document's first word follows a start mark. The pseudo-count a
of a side is ``delta`` times its share of the corpus, so that where nothing is known both models agree. Counts cover every token of every
document: no n-gram is cut off, however rare, at any size of the corpus.

The log ratio of a token is a value of its bigram less a value of its context, so nothing but these values has to meet a document.
The words' counts are few and are exchanged alone. Bigrams are exchanged once, in buckets by hash, each with its document's place in its
chunk of the table: all that holds a bigram stands together in its bucket, so its counts are known there, and the sums of its values go back to
the chunk. Frequent bigrams, of which there is a bounded number, are counted beforehand and never exchanged. Words and bigrams are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: rows and bytes of text that are worked on together; a text is never cut
_ROWS, _BYTES = 1000, 3_000_000
#: a document of more words than this sends each of its n-grams once, with a count; others send them as they come
_LONG = 20_000
#: n-grams that are dealt to the buckets at once
_DEALT = 4_000_000
_START = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
#: words of up to ``_LANES`` times eight bytes are hashed together
_LANES = 4
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit names of bigrams; the order of the words counts."""
    h = (v ^ (v >> np.uint64(32))) * _ODD + w
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit names of all words, words of each text). Letters, digits and all non-ASCII characters make words; A-Z in lower case."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(at[-1] - at[0])
    if not size:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    folded = np.zeros(size + 8 * _LANES + 8, np.uint8)
    folded[:size] = _FOLD[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    cut = np.zeros(size + 1, bool)
    cut[at] = True
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = folded[:size] != 32
    begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    length = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1 - begins
    n = np.diff(np.searchsorted(begins, at))

    lanes = np.ndarray((size + 8 * _LANES,), "<u8", folded, strides=(1,))  # the eight bytes from each place on
    keys = pair_keys(lanes[begins] & _MASKS[np.minimum(length, 8)], _START)
    for lane in range(1, _LANES):
        more = np.flatnonzero(length > 8 * lane)
        keys[more] = pair_keys(keys[more], lanes[begins[more] + 8 * lane] & _MASKS[np.minimum(length[more] - 8 * lane, 8)])
    for k in np.flatnonzero(length > 8 * _LANES):
        keys[k] = xxhash.xxh64_intdigest(folded[begins[k] : begins[k] + length[k]].tobytes())
    return keys, n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with the names of their words and each row's number of them, some megabytes of text (the first column) at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(ends):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + _BYTES, "right")))
            part = batch.slice(begin, end - begin)
            yield part, *word_keys(part.column(0))
            begin = end


def _contexts(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What stands before each token."""
    v = np.empty_like(words)
    v[1:] = words[:-1]
    v[(np.cumsum(n) - n)[n > 0]] = _START
    return v


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Few:
    """Finds the few sorted keys among many: most others are passed over by their leading bits."""

    def __init__(self, sorted_keys: np.ndarray):
        self.keys, self.leading = sorted_keys, np.zeros(1 << 20, bool)
        self.leading[sorted_keys >> np.uint64(44)] = True

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where a key is one of the few, which one it is)."""
        where = np.flatnonzero(self.leading[keys >> np.uint64(44)])
        at, hit = _found(self.keys, keys[where])
        return where[hit], at[hit]


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _summed(keys: np.ndarray, *numbers: np.ndarray) -> list[np.ndarray]:
    """Different keys, and the sums of their numbers."""
    order = np.argsort(keys)
    keys = keys[order]
    first = _firsts(keys)
    return [keys[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in numbers)]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, h, n in _chunks(batches):
        k, m = _summed(pair_keys(_contexts(h, n), h), np.ones(len(h), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(m)], names=["key", "n"])


#: kinds of counts: a word as a context (0 where it only ends texts), a frequent bigram
_WORD, _OFTEN = 0, 2


def _counted(shared):
    """Partial counts: of each word as a context, of the frequent bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = Few(shared.value)
        often = np.zeros((2, len(few.keys)), np.int64)
        held: list[list[np.ndarray]] = []
        size = 0

        def out(kind: int, key: np.ndarray, t: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(key), 50_000):
                p = slice(at, at + 50_000)
                columns = [pa.array(np.full(len(key[p]), kind, np.int8)), pa.array(key[p].view(np.int64)), pa.array(t[p]), pa.array(b[p])]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "target", "background"])

        def merged() -> list[np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch, h, n in _chunks(batches):
            if not len(h):
                continue
            v, wanted = _contexts(h, n), np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), n)
            last = h[(np.cumsum(n) - 1)[n > 0]]
            none = np.zeros(len(last), np.int64)
            held.append(_summed(np.concatenate([v, last]), np.concatenate([wanted, none]), np.concatenate([np.ones(len(v), np.int64), none])))
            where, which = few.places(pair_keys(v, h))
            often[0] += np.bincount(which, wanted[where], len(few.keys)).astype(np.int64)
            often[1] += np.bincount(which, minlength=len(few.keys))
            size += len(held[-1][0])
            if size > 2_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield from out(_WORD, *held[0])
                    held, size = [], 0
        if held:
            yield from out(_WORD, *merged())
        some = often[1] > 0
        yield from out(_OFTEN, few.keys[some], *often[:, some])

    return run


@dataclass
class Tables:
    """What every task holds: values of the frequent words as contexts and of the frequent bigrams, sorted by key."""

    words: np.ndarray
    word_values: np.ndarray
    pairs: np.ndarray
    pair_values: np.ndarray


#: A row is one chunk's share of a bucket: n-grams (``keys``) with their documents' places in the chunk, and how often (null: once each);
#: or the chunk itself: its ids, tokens, what is known of each sum, and how many n-grams it has sent.
_SENT = "bucket int, chunk long, content long, keys binary, places binary, n binary, sums binary, entries long, ids array<long>, tokens array<long>"
#: a bucket's answer to a chunk: the documents' sums over the share; chunks themselves go through
_ANSWER = "chunk long, content long, places binary, sums binary, entries long, ids array<long>, tokens array<long>"
#: bits of a place beside the number of the document in its chunk
_IS_CONTEXT, _IS_TARGET, _PLACE = np.uint16(1 << 14), np.uint16(1 << 15), np.uint16((1 << 14) - 1)


def _parts(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the bytes of consecutive parts."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _whole(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as one array, and the ends of the parts."""
    ends = np.cumsum(pc.binary_length(column).to_numpy()) // np.dtype(dtype).itemsize
    return np.concatenate([np.empty(0, dtype), *(np.frombuffer(x, dtype) for x in column.to_pylist())]), ends


def _scored(shared, buckets: int):
    """Each chunk of rows with what is known of its documents at once, and its other n-grams by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: Tables = shared.value
        few = Few(tables.pairs)
        small = np.uint16 if buckets <= 1 << 16 else np.uint32

        def value(keys: np.ndarray) -> np.ndarray:
            at, hit = _found(tables.words, keys)
            return np.where(hit, tables.word_values[at], np.nan) if len(tables.words) else np.full(len(keys), np.nan)

        def batch_of(m: int, **columns) -> pa.RecordBatch:
            kinds = {"bucket": pa.int32(), "keys": pa.binary(), "places": pa.binary(), "n": pa.binary(), "sums": pa.binary(), "entries": pa.int64(), "ids": pa.list_(pa.int64()), "tokens": pa.list_(pa.int64())}
            own = {k: pa.array(np.full(m, columns[k], np.int64)) for k in ("chunk", "content")}
            full = own | {k: columns.get(k, pa.nulls(m, kind)) for k, kind in kinds.items()}
            names = [x.split()[0] for x in _SENT.split(", ")]
            return pa.RecordBatch.from_arrays([full[k] for k in names], names=names)

        for number, (batch, h, n) in enumerate(_chunks(batches)):
            of, target = np.repeat(np.arange(len(n), dtype=np.uint16), n), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint16)
            v = _contexts(h, n)
            known, pairs = value(v), pair_keys(v, h)
            where, which = few.places(pairs)
            rare = np.isnan(known)
            sure = np.where(rare, 0.0, known)
            sure[where] += tables.pair_values[which]
            away = np.ones(len(h), bool)
            away[where] = False
            place = of | (target << np.uint16(15))[of]
            keys, places, times = np.concatenate([v[rare], pairs[away]]), np.concatenate([place[rare] | _IS_CONTEXT, place[away]]), None
            if len(n) and n.max() > _LONG:
                _, first, times = np.unique(pair_keys(keys, places.astype(np.uint64)), return_index=True, return_counts=True)
                order = np.argsort(first)
                keys, places, times = keys[first[order]], places[first[order]], times[order].astype(np.uint32)

            # a task that runs again names its chunks alike; what they hold is told, so that answers to other rows can't be taken for theirs
            chunk = (TaskContext.get().partitionId() << 32) + number
            content = int(np.bitwise_xor.reduce(pairs * (of.astype(np.uint64) * np.uint64(2) + np.uint64(1)))) if len(pairs) else 0
            name = {"chunk": chunk, "content": content - (1 << 64) if content >> 63 else content}
            ids, tokens = (pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), x) for x in (pc.cast(batch.column(2), pa.int64()), pa.array(n.astype(np.int64))))
            sums = pa.array([np.bincount(of, sure, len(n)).tobytes()], pa.binary())
            yield batch_of(1, **name, bucket=pa.array([(chunk * 0x9E3779B1 >> 7) % buckets], pa.int32()), sums=sums, entries=pa.array([len(keys)]), ids=ids, tokens=tokens)
            for begin in range(0, len(keys), _DEALT):
                p = slice(begin, begin + _DEALT)
                bucket = ((keys[p] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(small)
                order = np.argsort(bucket, kind="stable")
                sizes = np.bincount(bucket)
                here = np.flatnonzero(sizes)
                ends = np.cumsum(sizes[here])
                more = {} if times is None else {"n": _parts(times[p][order], ends)}
                yield batch_of(len(here), **name, bucket=pa.array(here.astype(np.int32)), keys=_parts(keys[p][order], ends), places=_parts(places[p][order], ends), **more)

    return run


def _answered(of_context, of_pair):
    """Counts of a bucket's n-grams, and what they add to the documents of each chunk."""

    def run(table: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in _ANSWER.split(", ")]
        is_own = pc.is_valid(table["ids"])
        own, sent = table.filter(is_own).select(names), table.filter(pc.invert(is_own))
        keys, ends = _whole(sent["keys"], np.uint64)
        if not len(keys):
            return own
        places = _whole(sent["places"], np.uint16)[0]
        n = np.ones(len(keys), np.int64)
        for k, times in enumerate(sent["n"].to_pylist() if sent["n"].null_count < len(sent) else []):
            if times is not None:
                n[ends[k] - len(times) // 4 : ends[k]] = np.frombuffer(times, np.uint32)

        order = np.argsort(keys)
        first = _firsts(keys[order])
        n_of = n[order]
        b = np.add.reduceat(n_of, first)
        t = np.add.reduceat(np.where(places[order] & _IS_TARGET, n_of, 0), first)
        value = np.where(places[order[first]] & _IS_CONTEXT, of_context(t, b), of_pair(t, b))
        each = np.empty(len(keys))
        each[order] = np.repeat(value, np.diff(np.append(first, len(keys)))) * n_of

        # documents stand in order within a share
        share = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        doc = places & _PLACE
        runs = _firsts(share, doc)
        upto = np.searchsorted(runs, ends)
        columns = {"chunk": sent["chunk"], "content": sent["content"], "places": _parts(doc[runs], upto), "sums": _parts(np.add.reduceat(each, runs), upto), "entries": pa.array(np.diff(ends, prepend=0))}
        columns |= {k: pa.nulls(len(sent), pa.list_(pa.int64())) for k in ("ids", "tokens")}
        answers = pa.table(columns).select(names)
        common.tidy()
        return pa.concat_tables([own.cast(answers.schema), answers])

    return run


def _finished(table: pa.Table) -> pa.Table:
    """The rows of a chunk with their means."""
    is_own = pc.is_valid(table["ids"])
    own, answers = table.filter(is_own), table.filter(pc.invert(is_own))
    if len(own) != 1 or len(pc.unique(table["content"])) != 1 or own["entries"][0].as_py() != (pc.sum(answers["entries"]).as_py() or 0):
        raise RuntimeError("a task read other rows when it ran again: the documents need a fixed order within their partitions")
    ids, n = own["ids"].combine_chunks().flatten(), own["tokens"].combine_chunks().flatten().to_numpy()
    places, added = _whole(answers["places"], np.uint16)[0], _whole(answers["sums"], np.float64)[0]
    sums = np.frombuffer(own["sums"][0].as_py(), np.float64) + np.bincount(places, added, len(n))
    return pa.table({"id": ids, "n_tokens": n, "score": np.where(n > 0, sums / np.maximum(n, 1), 0.0)})


def cross_entropy_difference(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, delta: float = 0.5, hot_words: int = 1_000_000, hot_share: int = 100_000, broadcast_ids: int = 2_000_000, bucket_ngrams: int = 1_000_000) -> DataFrame:
    """(id_col, n_tokens, score) for every row. ``wanted``: ids of the target documents (its first column).

    Score is the mean per token; 0 for null texts and texts without words. Null ids are in the background only. Repeated
    rows count as often as they stand there, and each gets its score. Without any target document the target model is
    uniform. Other columns are ignored, whatever their names; an empty table gives no rows. Texts are read whole.

    At most ``hot_words`` words, and bigrams that make more than one in ``hot_share`` of a sample, fewer than ``hot_share``
    of them, go to every task with their values; all other n-grams go through the exchange, in buckets of about ``bucket_ngrams``
    (up to four times as many where there would be more than 1024 buckets). The result doesn't depend on where these lines are drawn.

    Should a task have to run again, it must read the same rows in the same order, as it does from files; the query fails
    where it doesn't.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    names = wanted.select(F.col(wanted.columns[0]).cast("long").alias("id")).where("id is not null").distinct().withColumn("target", F.lit(True))
    names = common.stage(names, "wanted")
    few_names = names.count() <= broadcast_ids  # a checked bound; beyond it the texts are dealt by id
    marked = base.join(F.broadcast(names) if few_names else names, "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"), "id")
    if not few_names:
        marked = marked.sortWithinPartitions("id", F.xxhash64("text"))

    # which bigrams are frequent is read from one document in 64; it decides how they travel, not what they count
    some = base.where(F.pmod(F.xxhash64("id", "text"), F.lit(64)) == 0).select("text").mapInArrow(common.in_slices(_sampled, _ROWS), "key long, n long")
    some = common.stage(some.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "lm_sample")
    total = some.agg(F.sum("n")).first()[0] or 0
    often = some.where((F.col("n") >= 8) & (F.col("n") * hot_share > total)).select("key").toArrow()["key"].to_numpy()
    shared = spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))

    partial = marked.select("text", "target").mapInArrow(common.in_slices(_counted(shared), _ROWS), "kind byte, key long, target long, background long")
    counts = common.stage(partial.groupBy("kind", "key").agg(F.sum("target").alias("target"), F.sum("background").alias("background")), "lm_counts")
    is_word = (F.col("kind") == _WORD) & (F.col("key") != int(_START.view(np.int64)))
    sums = counts.agg(F.count_if(is_word).alias("n"), *(F.sum(F.when(F.col("kind") == _WORD, F.col(x))).alias(x) for x in ("target", "background"))).first()
    kinds, n_target, n_background = sums["n"] or 1, sums["target"] or 0, sums["background"] or 0
    a, b = delta * (n_target / n_background if n_target else 1.0), delta

    def of_context(t, n):
        return np.log(n + b * kinds) - np.log(t + a * kinds)

    def of_pair(t, n):
        return np.log(t + a) - np.log(n + b)

    # the frequent words: all from a power of two upwards, as long as they are few enough
    contexts = counts.where((F.col("kind") == _WORD) & (F.col("background") > 0)).withColumn("level", F.floor(F.log2("background")).cast("int"))
    levels = {r["level"]: r["n"] for r in contexts.groupBy("level").agg(F.count("*").alias("n")).collect()}
    least, held = 64, 0
    for level in sorted(levels, reverse=True):
        held += levels[level]
        if held > hot_words:
            break
        least = level
    arrays = []
    for table, of in ((contexts.where(F.col("level") >= least), of_context), (counts.where(F.col("kind") == _OFTEN), of_pair)):
        data = table.select("key", "target", "background").toArrow()
        keys, t, n = (data[x].to_numpy() for x in ("key", "target", "background"))
        order = np.argsort(keys.view(np.uint64))
        arrays += [keys.view(np.uint64)[order], of(t, n)[order]]
    tables = spark.sparkContext.broadcast(Tables(*arrays))

    dealt = -(-n_background // bucket_ngrams)
    buckets = max(min(dealt, 1024), -(-dealt // 4), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = marked.mapInArrow(common.in_slices(_scored(tables, buckets), _ROWS), _SENT)
    answers = sent.groupBy("bucket").applyInArrow(_answered(of_context, of_pair), _ANSWER)
    out = answers.groupBy("chunk").applyInArrow(_finished, "id long, n_tokens long, score double")
    return out.withColumnRenamed("id", id_col)


def op7_cross_entropy(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    wanted = common.table(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1").select("doc_id")
    return cross_entropy_difference(docs, wanted)
