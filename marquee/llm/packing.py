"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

What decides the packing is only how many pieces there are of each length, a histogram of at most ``capacity`` rows
whatever the size of the corpus. The plan is made from that histogram, in runs of equal bins:

* large pieces (above a third of the capacity) pair at most twice per bin, by greedy matching from the longest: each takes
  the longest large partner that still fits;
* smaller pieces, from the longest, go to the bin with the least gap that still holds them, and open a bin when none does.

Each piece then finds its place by its rank among the pieces of its length. Ranks come from counts per (length, task),
so no task ever holds a length's pieces together.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
END_ID = 1
#: parts kept in each of two generations per Python worker, and the longest one kept
_CACHE_PARTS, _CACHE_LENGTH = 150_000, 32


class WordCache:
    """Token ids of whole texts, by way of the ids of their parts between spaces and line feeds.

    Exact for tokenizers like ``word_bpe_49k``, whose matches never hold white space, which drop it, and which cut
    between a letter and a mark: parts are then encoded apart, capitals of plain ASCII parts don't matter, and a
    single full stop or comma after a letter is a match of its own. A batch's parts are told apart by Arrow, so Python
    sees each different part of a batch once. Two generations of at most ``_CACHE_PARTS`` parts bound the memory.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: the letter by which byte-level merges write each byte
        self.letters = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else "" for b in range(256)]
        unseen = iter(range(256, 512))
        self.letters = [x or chr(next(unseen)) for x in self.letters]
        self.marks = {mark: self._encode([mark])[0] for mark in ".,"}

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of parts. Words of lower-case letters alone are one match each, and go to the merges directly."""
        out: dict[str, list[int]] = {}
        merge = self.tokenizer.model.tokenize
        for part in parts:
            if part.isalpha():
                if part.isascii():
                    if part.islower():
                        out[part] = [t.id for t in merge(part)]
                elif part == part.lower() and is_normalized("NFC", part):
                    out[part] = [t.id for t in merge("".join(map(self.letters.__getitem__, part.encode())))]
        rest = [part for part in parts if part not in out]
        out.update(zip(rest, (e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return [np.array(out[part], np.dtype("<u2")).tobytes() for part in parts]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts."""
        cores, marks = [], []
        for part in parts:
            mark = b""
            if part[-1:] in self.marks and part[-2:-1].isalpha():
                mark, part = self.marks[part[-1]], part[:-1]
            cores.append(part.lower() if part.isascii() else part)
            marks.append(mark)
        wanted, found = [], {"": b""}
        for core in set(cores):
            ids = self.new.get(core)
            if ids is None and (ids := self.old.get(core)) is None:
                if core:
                    wanted.append(core)
            else:
                found[core] = ids
        found.update(zip(wanted, self._encode(wanted), strict=True))
        if len(self.new) > _CACHE_PARTS:
            self.old, self.new = self.new, {}
        self.new.update((core, ids) for core, ids in found.items() if len(core) <= _CACHE_LENGTH)
        return [found[core] + mark for core, mark in zip(cores, marks, strict=True)]

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """For each text all its ids, then the end id."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        known = pa.array(self._parts(coded.dictionary.to_pylist()), pa.large_binary())
        taken = known.take(coded.indices)
        _, where, data = taken.buffers()
        at = np.frombuffer(where, np.int64)[: len(taken) + 1]
        flat = np.frombuffer(data, np.dtype("<u2")) if data is not None and data.size else np.empty(0, np.dtype("<u2"))
        ends = at[lists.offsets.to_numpy() - lists.offsets[0].as_py()] // 2
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out = np.empty(b - a + 1, np.dtype("<u4"))
            out[:-1] = flat[a:b]
            out[-1] = END_ID
            yield out


#: by path; a worker that is used again goes on with what it has
_CACHES: dict[str, WordCache] = {}


def _tokenise(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in _CACHES:
            _CACHES[path] = WordCache(path)
        words = _CACHES[path]
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            owner, piece, start, length, crc, rank, kept = [], [], [], [], [], [], []
            for row, ids in enumerate(words.ids(batch.column(1))):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    cut = ids[at : at + capacity]
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
                    rank.append(seen[len(cut)])
                    seen[len(cut)] += 1
                    if with_ids:
                        kept.append(cut.astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(owner, pa.int64())),
                *(pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (rank, pa.int64()))),
                pa.array(np.full(len(owner), part, np.int32)),
            ]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part", "ids"][: len(columns)])

    return run


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Runs of equal bins: (number of bins, ((length, how many), ...)). Every piece of the histogram is in one bin."""
    left = {size: n for size, n in histogram.items() if n > 0}
    if any(not 0 < size <= capacity for size in left):
        raise ValueError("lengths are 1 to the capacity")
    gaps: list[int] = []  # sorted; the runs of each are in open_
    open_: dict[int, list[tuple[int, tuple]]] = {}

    def put(gap: int, n: int, holds: tuple) -> None:
        if n:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((n, holds))

    large = sorted(size for size in left if 3 * size > capacity)
    while large:
        size = large[-1]
        n = left[size]
        at = bisect_left(large, capacity - size + 1) - 1
        if at < 0:
            put(capacity - size, n, ((size, 1),))
            large.pop()
            continue
        mate = large[at]
        if mate == size:
            put(capacity - 2 * size, n // 2, ((size, 2),))
            left[size] = n % 2
            if n % 2:  # the odd one takes the next shorter, or stays alone
                if at:
                    mate = large[at - 1]
                    put(capacity - size - mate, 1, ((size, 1), (mate, 1)))
                    left[mate] -= 1
                    if not left[mate]:
                        large.pop(at - 1)
                else:
                    put(capacity - size, 1, ((size, 1),))
            large.pop()
            continue
        pairs = min(n, left[mate])
        put(capacity - size - mate, pairs, ((size, 1), (mate, 1)))
        for one in (size, mate):
            left[one] -= pairs
            if not left[one]:
                large.remove(one)

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[size]
        while n:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                gap, bins, holds = capacity, -(-n // (capacity // size)), ()
            else:
                gap = gaps[at]
                bins, holds = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            each = gap // size
            full = min(bins, n // each)
            put(gap - each * size, full, (*holds, (size, each)))
            n -= full * each
            rest = bins - full
            if n and rest:
                few = min(n, each)
                put(gap - few * size, 1, (*holds, (size, few)))
                n -= few
                rest -= 1
            put(gap, rest, holds)
    return [run for gap in gaps for run in open_[gap]]


def places(runs: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[int, np.ndarray]:
    """For each length a table with columns: first rank, first sequence, pieces per sequence, first offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for bins, holds in runs:
        offset = 0
        for size, each in holds:
            at = taken.get(size, 0)
            out.setdefault(size, []).append((at, sequence, each, offset))
            taken[size] = at + bins * each
            offset += size * each
        sequence += bins
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("rank")).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            sizes, firsts = np.unique(length[order], return_index=True)
            for size, rows in zip(sizes.tolist(), np.split(order, firsts[1:]), strict=True):
                t = tables[size]
                at = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1]
                past = rank[rows] - at[:, 0]
                sequence[rows] = at[:, 1] + past // at[:, 2]
                offset[rows] = at[:, 3] + past % at[:, 2] * size
            keep = [n for n in names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, [ids], sequence_id, offset.

    A document is its ids and the end id, so an empty or null text is one piece of length 1; only documents longer
    than the capacity are cut. A null id stays null; repeated rows are packed each for itself; an empty table gives no
    rows; other columns are ignored. ``with_ids`` adds each piece's ids.

    The histogram (at most ``capacity`` rows) is the only thing that reaches the driver, and the places that go back to
    the executors are bounded by the number of different bins, not by the corpus.
    """
    ids_type = ", ids array<int>" if with_ids else ""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, part int" + ids_type
    pieces = common.stage(source.mapInArrow(common.in_slices(_tokenise(tokenizer_path, capacity, with_ids), 1500), schema), "pieces")
    counts = common.stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    base = common.stage(common.running_base(counts, "length", "part", "n"), "piece_base")
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    placed = ranked.select(*columns, "rank").mapInArrow(_place(shared), schema.replace(", rank long, part int", "") + ", sequence_id long, offset long")
    return placed.withColumnRenamed("doc_id", id_col)


def fill(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed ``with_ids``: the training sequences themselves, each at most the capacity long."""
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents", "doc_id", "text"), default_tokenizer())
