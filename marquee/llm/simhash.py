"""SimHash near-duplicates by segment-popcount embedding.

The 64-bit fingerprint is cut into 32 segments of two bits; the embedding is the vector of their popcounts (0, 1 or
2). Flipping one fingerprint bit moves one coordinate by one, so the Manhattan distance of two embeddings is a lower
bound of the Hamming distance of the fingerprints. Two fingerprints within 3 bits are therefore within Manhattan
distance 3, and in one half of the coordinates (16 of the 32) within distance 1. The grid range-join uses those half
vectors as cells: equal cells, or cells one step apart, where each fingerprint looks only one step upwards, so that a pair meets
once per half. The full Manhattan bound is tested next, and the exact Hamming distance last.

``near_duplicates`` links by that distance alone. ``similar_classes`` and ``representatives`` ask for a Jaccard similarity of shingle sets:
the grid join gives their nearest pairs, bands of a sketch the others, and whole texts decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

#: bits of each byte value, least significant first
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_EVEN = 0x5555555555555555
_HALF = 0xFFFFFFFF


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the whole text. Null, empty and blank texts have fingerprint zero; a text of fewer
    words than a shingle counts as one shingle."""
    words = (text or b"").lower().split()  # for bytes: A-Z only, and \x20 \x09-\x0D only
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    elif shingle == 3:
        shingles = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:]))  # noqa: B905
    else:
        shingles = [b" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
    octets = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        ones = _BITS[octets].sum(axis=0).ravel()
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed bigint with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in common.binary_list(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(common.in_slices(run), "id long, fp long")


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding, packed: 32 coordinates of two bits each."""
    u = fp.view(np.uint64)
    even = np.uint64(_EVEN)
    return (u & even) + ((u >> np.uint64(1)) & even)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of packed embeddings: coordinates 0, 1, 2 written as 0, 1, 11 in unary, then compared bit by bit."""

    def unary(p: np.ndarray) -> np.ndarray:
        even = np.uint64(_EVEN)
        low, high = p & even, (p >> np.uint64(1)) & even
        return low | high | (high << np.uint64(1))

    return np.bitwise_count(unary(x) ^ unary(y))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint in its own cell of both halves (probe false), and in the cells one step up (probe true)."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        emb = popcounts(fp)
        cells, halves, owners, probes = [], [], [], []
        for half in (0, 1):
            own = (emb >> np.uint64(32 * half)) & np.uint64(_HALF)
            cells.append(own)
            owners.append(fp)
            probes.append(np.zeros(len(fp), bool))
            for k in range(16):
                unit = np.uint64(1 << (2 * k))
                can = ((own >> np.uint64(2 * k)) & np.uint64(3)) < 2
                cells.append(own[can] + unit)
                owners.append(fp[can])
                probes.append(np.ones(int(can.sum()), bool))
            halves += [np.full(sum(map(len, cells)) - sum(map(len, halves)), half, np.int64)]
        key = (np.concatenate(cells) | (np.concatenate(halves).astype(np.uint64) << np.uint64(32))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate(owners)), pa.array(np.concatenate(probes))], names=["cell", "fp", "probe"])


def _verify(max_bits: int):
    """Links within the members of a cell, as a spanning forest: enough for components, and never more rows than members."""

    def links(base: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found_a, found_b = [base[:0]], [base[:0]]
        rows = max(1, 4_000_000 // max(1, len(other)))
        emb_b, emb_o = popcounts(base), popcounts(other)
        for k in range(0, len(base), rows):
            near = manhattan(emb_b[k : k + rows, None], emb_o[None, :]) <= max_bits
            i, j = np.nonzero(near)
            a, b = base[k + i], other[j]
            ok = (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= max_bits) & (a != b)
            found_a.append(a[ok])
            found_b.append(b[ok])
        return np.concatenate(found_a), np.concatenate(found_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            lists = batch.column("members")
            offsets = lists.offsets.to_numpy()
            flat = lists.values
            block, fp, probe = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            same = batch.column("i").to_numpy() == batch.column("j").to_numpy()
            for k in range(len(same)):
                s = slice(offsets[k], offsets[k + 1])
                f, p, blk = fp[s], probe[s], block[s]
                if p.all():
                    continue
                if same[k]:
                    base = f[~p]
                    a, b = links(base, f) if len(f) > 1 else (base[:0], base[:0])
                else:
                    least = blk.min()
                    one, two = blk == least, blk != least
                    x = links(f[one & ~p], f[two])
                    y = links(f[two & ~p], f[one])
                    a, b = np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])
                if len(a) > len(f):
                    a, b = common.union_find(a, b)
                    a, b = a[a != b], b[a != b]
                out_a.append(a)
                out_b.append(b)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return run


def edges(distinct_fps: DataFrame, max_bits: int = 3, block: int = 2048) -> DataFrame:
    """(a, b): a spanning set of the links between different fingerprints. ``max_bits`` is at most 3, since the half
    cells reach one step."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits is 0 to 3")
    cells = distinct_fps.select("fp").mapInArrow(_cells, "cell long, fp long, probe boolean")
    groups = common.bounded_groups(cells, ["cell"], ["fp", "probe"], F.col("fp"), block)
    with_base = groups.where(F.exists("members", lambda m: ~m["probe"]))
    return with_base.mapInArrow(_verify(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, max_bits: int = 3, block: int = 2048) -> DataFrame:
    """One row (id_col, fp, component) per input row; component is the smallest id reachable by links.

    Nulls: a null text has fingerprint zero and is linked like any other; a null id gets its row but never names a
    component (null if no linked row has an id). Repeated rows stay repeated. An empty table gives an empty table.
    Other columns are ignored, whatever their names. Texts are read whole.
    """
    fps = common.stage(fingerprints(docs, id_col, text_col, shingle), "fps")
    distinct = common.stage(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct_fps")
    comps = common.components(edges(distinct, max_bits, block))
    rooted = common.stage(distinct.join(comps.toDF("fp", "root"), "fp").select("fp", "root", "least"), "rooted")
    least = common.stage(rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n_root")), "root_least")
    moved = common.stage(common.heavy_join(rooted, least, ["root"], "n_root", rooted.count()).select("fp", "component"), "moved")
    common.drop(rooted, least)
    reps = common.stage(distinct.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), "n"), "reps")
    return common.heavy_join(fps, reps, ["fp"], "n", fps.count()).select(F.col("id").alias(id_col), "fp", "component")


def _prints(shingle: int, percent: int):
    """Fingerprint, set and meetings of each text. Columns in: id, k1, k2, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in common.binary_list(batch.column(3)):
                x = shingles.shingles(shingles.split(text), shingle)
                out.append((xxhash.xxh64_intdigest(x.tobytes()), len(x), fingerprint(text, shingle), *shingles.meetings(x, percent)))
            s, n, fp, marks, bands, low, keys = zip(*out, strict=True) if out else ((),) * 7
            signed = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (s, fp)]
            met = [pa.array(v, kind) for v, kind in ((marks, pa.binary()), (bands, pa.list_(pa.int64())), (low, pa.binary()), (keys, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], signed[0], pa.array(n, pa.int32()), signed[1], *met], names=["id", "k1", "k2", "s", "n", "fp", "marks", "bands", "low", "keys"])

    return run


def similar_classes(rows: DataFrame, shingle: int = 5, percent: int = 80, max_bits: int = 3, block: int = 2048) -> DataFrame:
    """(id, k1, k2, s, root): classes of rows that chains of pairs with a Jaccard similarity of ``percent`` or more join; root names the
    class, s the row's set of shingles. ``rows``: id, k1, k2 (hashes of the row), text.

    The fingerprints' grid join gives the pairs within ``max_bits`` bits. At a similarity of 0.8 fingerprints differ by about ten of 64 bits, where no
    cell of the grid is selective, so pairs beyond are found by bands of a sketch, or between small sets by their first shingles. Every pair is
    checked by its whole texts. ``percent`` is above 50."""
    if percent <= 50:
        raise ValueError("percent is above 50")
    parts = "marks binary, bands array<long>, low binary, keys array<long>"
    schema = f"id long, k1 long, k2 long, s long, n int, fp long, {parts}"
    held = ["n", "fp", "marks", "bands", "low", "keys"]
    prints = common.stage(rows.select("id", "k1", "k2", "text").mapInArrow(common.in_slices(_prints(shingle, percent)), schema), "prints")
    one = prints.groupBy("s").agg(F.min(F.struct("k1", "k2")).alias("k"), F.first(F.struct(*held)).alias("p"), F.count("*").alias("n_rows"))
    sets = common.stage(one.select("s", "k.k1", "k.k2", *(f"p.{c}" for c in held), "n_rows"), "sets")
    fps = common.stage(sets.groupBy("fp").agg(F.min("s").alias("first"), F.count("*").alias("n")), "set_fps")
    # sets of one fingerprint around the first of them, and those around each other
    alike = sets.select("s", "fp").join(fps.where("n > 1"), "fp").where("s <> first").select(F.col("first").alias("a"), F.col("s").alias("b"))
    forest = edges(fps.select("fp"), max_bits, block)
    first = fps.select("fp", "first")
    across = forest.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    found = shingles.links(sets.drop("fp", "n_rows"), alike.unionByName(across), rows.select("k1", "k2", "text"), shingle, percent, block)
    linked = common.components(found).toDF("s", "root")
    rooted = common.stage(sets.select("s", "n_rows").join(linked, "s", "left").withColumn("root", F.coalesce("root", "s")), "set_roots")
    slim = prints.select("id", "k1", "k2", "s")
    classes = common.stage(common.heavy_join(slim, rooted, ["s"], "n_rows", prints.count()).drop("n_rows"), "set_classes")
    common.drop(prints, sets, fps, rooted)
    return classes


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, max_bits: int = 3, block: int = 2048) -> DataFrame:
    """``docs`` without near-duplicates: of each class (see ``similar_classes``) the row with the least id stays, whole and unchanged.

    Texts without words, null ones among them, are one class. Of rows that share the least id one stays, and of a class without ids one of each set of
    shingles. An empty table gives no rows; columns may have any names; texts are read whole."""
    names = docs.columns
    text = F.col(text_col).cast("string")
    hashes = F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(F.lit(1), F.col(id_col), text).alias("k2")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), *hashes, text.alias("text"))
    rows = similar_classes(slim, shingle, percent, max_bits, block)
    least = common.stage(rows.groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("n_root")), "root_least")
    best = common.heavy_join(rows, least, ["root"], "n_root", rows.count()).where("id <=> least")
    group = F.when(F.col("least").isNull(), F.col("s")).alias("of")
    chosen = best.groupBy("root", group).agg(F.min(F.struct("k1", "k2")).alias("k"), F.count("*").alias("n"))
    chosen = common.stage(chosen.select("k.k1", "k.k2", "n"), "chosen")
    keyed = docs.select(F.struct(*names).alias("row"), *hashes)
    kept = common.join_few(keyed, chosen.select("k1", "k2"), ["k1", "k2"], shingles.FEW)
    if not chosen.where("n > 1").isEmpty():  # an id's rows that are equal
        kept = kept.dropDuplicates(["k1", "k2"])
    return kept.select(*(F.col("row")[c].alias(c) for c in names))


def hex_fingerprint(fp):
    """Sixteen lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
