"""Word-shingle sets: their exact Jaccard similarity, sketches that estimate it, and the search for pairs beyond a fingerprint's reach.

A sketch cuts the range of the shingles' hashes into bins and keeps the least of each; two sets agree in a bin with the probability of their
similarity. Runs of bins make bands: sets that agree in a whole band meet in one group, where the sketches tell which pairs can be
similar enough; those alone are compared by their whole texts.

Small sets leave most bins empty, so they meet without loss instead: in the order of hashes, two sets that are similar enough share at least two of
their first n - ceil(share * n) + 2 shingles, and every two of these name a group. There the low bits of all their shingles rule out pairs that
share too few, which loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BINS, BANDS, _ROWS = 512, 32, 8
#: sets of so many shingles or fewer meet by their first shingles; larger ones, and those that could be similar to larger ones, by bands
SMALL = 40
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(55))
#: an estimate so many standard deviations below the threshold rules a pair out
_SURE = 3.5
#: texts or keys that may be broadcast, by a count made before
FEW = 1_000_000


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; fewer words than a shingle are one, no words none."""
    if not words:
        return np.empty(0, np.uint64)
    found = {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))


def split(text: bytes | None) -> list[bytes]:
    """Words as in ``simhash.fingerprint``: A-Z in lower case, cut at ASCII white space."""
    return (text or b"").lower().split()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """In whole numbers, so that a similarity of just the threshold counts."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def sketch(x: np.ndarray) -> tuple[bytes, list[int]]:
    """(marks, bands). Marks: a byte for each bin, 0 where it is empty, and four of each band's name; bands: their names, 0 where a band is empty."""
    at = np.searchsorted(x, _EDGES)
    full = at < np.append(at[1:], len(x))
    least = np.where(full, x[np.minimum(at, len(x) - 1)], 0) if len(x) else np.zeros(BINS, np.uint64)
    marks = np.where(full, (least & np.uint64(0xFFFF)) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)
    rows = least[: BANDS * _ROWS].reshape(BANDS, _ROWS)
    names = np.array([xxhash.xxh64_intdigest(row.tobytes(), k) | 1 if some else 0 for k, (row, some) in enumerate(zip(rows, rows.any(axis=1).tolist(), strict=True))], np.uint64)
    return marks.tobytes() + names.astype(np.uint32).tobytes(), names.view(np.int64).tolist()


def leaders(x: np.ndarray, percent: int) -> tuple[bytes, list[int]]:
    """(low, keys) of a small set: two bytes of each shingle, none of them 0, and the groups in which it meets all sets of similarity ``percent`` or
    more, which is above 50: different sets then share two shingles at least."""
    low = np.zeros(SMALL, np.uint16)
    low[: len(x)] = x % np.uint64(65535) + np.uint64(1)
    first = x[: len(x) - -(-percent * len(x) // 100) + 2]
    i, j = np.triu_indices(len(first), 1)
    return low.tobytes(), (first[i] * np.uint64(0x9E3779B97F4A7C15) + first[j] * np.uint64(0xD6E8FEB86659FD93)).view(np.int64).tolist()


def meetings(x: np.ndarray, percent: int) -> tuple[bytes, list[int], bytes, list[int]]:
    """(marks, bands, low, keys): a set's bands, its small groups, or both if it lies where sets of either kind can be similar to it."""
    by_band = sketch(x) if 100 * len(x) > percent * SMALL else (b"", [])
    return *by_band, *(leaders(x, percent) if len(x) <= SMALL else (b"", []))


def _shared(low: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """The similarity of the pairs (i, j) of small sets if shingles with equal low bits were equal, which it can only exceed; -1 where that is too little."""
    out = np.full(len(i), -1.0)
    for at in range(0, len(i), 10_000):
        k = slice(at, at + 10_000)
        x, y = low[i[k]], low[j[k]]
        both = ((x[:, :, None] == y[:, None, :]).any(axis=2) & (x != 0)).sum(axis=1)
        either = np.maximum(n[i[k]] + n[j[k]] - both, 1)
        out[k] = np.where(100 * both >= percent * either, both / either, -1.0)
    return out


def _maybe(marks: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Estimated similarity of the pairs (i, j); -1 where it is ruled out by the sizes or the sketches.

    The bins that either set fills show some of the shingles of both, drawn without replacement: the fewer are hidden, the less an
    estimate can be off."""
    out = np.full(len(i), -1.0)
    fit = np.nonzero(100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))[0]
    t = percent / 100
    for at in range(0, len(fit), 10_000):
        k = fit[at : at + 10_000]
        x, y = marks[i[k]], marks[j[k]]
        seen = np.maximum(np.count_nonzero(x | y, axis=1), 1)
        share = np.count_nonzero((x == y) & (x != 0), axis=1) / seen
        all_ = np.maximum((n[i[k]] + n[j[k]]) / (1 + t), seen)  # different shingles of both, at the threshold
        off = np.sqrt(t * (1 - t) / seen * (all_ - seen + 1) / all_)
        ok = share >= t - _SURE * off - 1 / seen
        out[k[ok]] = share[ok]
    return out


def _candidates(percent: int, forest: bool):
    """Pairs (a, b) of a group that may be similar and that nothing has joined yet. ``forest``: of those only enough to join what all of them would
    join, the likeliest first. A pair that meets in several bands counts in the first of them. Marks of the last band number are those of small sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            offsets, flat = lists.offsets.to_numpy(), lists.values
            block, s, n, root = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            marks = flat.field(4)
            same, bands = batch.column("i").to_numpy() == batch.column("j").to_numpy(), batch.column("k").to_numpy()
            for k in range(len(same)):
                at = slice(offsets[k], offsets[k + 1])
                f, m, r, b = s[at], n[at].astype(np.int64), root[at], block[at]
                small = bands[k] == BANDS
                sk = np.frombuffer(b"".join(marks.slice(at.start, len(f)).to_pylist()), np.uint16 if small else np.uint8).reshape(len(f), -1)
                if not small:
                    before = np.ascontiguousarray(sk[:, BINS:]).view(np.uint32)[:, : bands[k]]
                    sk = sk[:, :BINS]
                found = []
                step = max(1, 200_000 // len(f))
                for x in range(0, len(f), step):
                    rows = np.arange(x, min(x + step, len(f)))
                    ok = (f[rows, None] < f[None, :]) & (r[rows, None] != r[None, :])
                    if not same[k]:
                        ok &= b[rows, None] != b[None, :]
                    i, j = np.nonzero(ok)
                    i = rows[i]
                    share = (_shared if small else _maybe)(sk, m, i, j, percent)
                    keep = share >= 0
                    i, j, share = i[keep], j[keep], share[keep]
                    if not small:
                        keep = ~((before[i] == before[j]) & (before[i] != 0)).any(axis=1)
                        i, j, share = i[keep], j[keep], share[keep]
                    found.append((i, j, share))
                i, j, share = (np.concatenate(c) for c in zip(*found, strict=True))
                if forest and len(i):
                    order = np.argsort(-share, kind="stable")
                    i, j = _tree(r, i[order], j[order])
                for y in range(0, len(i), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(f[i[y : y + 50_000]]), pa.array(f[j[y : y + 50_000]])], names=["a", "b"])

    return run


def _tree(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first pairs that join what isn't joined; members of one root are joined already."""
    parent = np.unique(root, return_inverse=True)[1].tolist()
    up = list(range(len(root)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = top(parent[x]), top(parent[y])
        if x != y:
            up[x] = y
            keep.append(k)
    return i[keep], j[keep]


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of similarity ``percent`` or more, by their whole texts. ``texts``: s, text, a staged table that is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = common.binary_list(batch.column(2)), common.binary_list(batch.column(3))
            ok = pa.array([similar(shingles(split(t), size), shingles(split(u), size), percent) for t, u in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(ok)

    wide = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
    found = common.stage(wide.mapInArrow(common.in_slices(run), "a long, b long"), "similar_links")
    common.drop(texts)
    return found


def texts_of(pairs: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(s, text) of all sets in ``pairs``. ``sets``: s, k1, k2 of a row that has the set; ``rows``: k1, k2, text."""
    held = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    keys = common.stage(sets.select("s", "k1", "k2").join(held, "s"), "similar_held")
    found = common.join_few(rows, keys, ["k1", "k2"], FEW)
    texts = common.stage(found.groupBy("s").agg(F.first("text").alias("text")), "similar_texts")
    common.drop(keys)
    return texts


def links(sets: DataFrame, near: DataFrame, rows: DataFrame, size: int, percent: int, block: int = 2048) -> DataFrame:
    """(a, b): links between different sets that join all that chains of pairs of similarity ``percent`` or more join. ``sets``: s, n, k1,
    k2, marks, bands, low, keys (see ``meetings``), one row for each set; ``near``: pairs of sets that are likely similar; ``rows``: k1, k2, text.

    The likely pairs are checked first. Then the sets that share a band are compared: once by the likeliest pairs that would
    join each group, and once more by all pairs that are not ruled out and that nothing has joined by then."""
    near = common.stage(near.distinct(), "similar_near")
    first = verified(near, texts_of(near, sets, rows), size, percent)
    keys = ["k", "band"]
    by_band = sets.select("s", F.posexplode("bands").alias(*keys)).where("band <> 0")
    entries = by_band.unionByName(sets.select("s", F.lit(BANDS).alias("k"), F.explode("keys").alias("band")))
    met = entries.groupBy(*keys).agg(F.count("*").alias("many")).where("many > 1").select(*keys)
    marks = F.when(F.col("k") == BANDS, F.col("low")).otherwise(F.col("marks")).alias("marks")
    members = common.stage(entries.join(met, keys).join(sets.select("s", "n", "marks", "low"), "s").select("s", *keys, "n", marks), "similar_members")
    found = [first]
    for forest in (True, False):
        all_links = found[0]
        for more in found[1:]:
            all_links = all_links.unionByName(more)
        comps = common.components(all_links).toDF("s", "root")
        now = members.join(comps, "s", "left").withColumn("root", F.coalesce("root", "s"))
        if not forest:  # groups that are one by now need no other look
            now = common.stage(now, "similar_left")
            split_ = now.groupBy(*keys).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(*keys)
            now = now.join(split_, keys)
        groups = common.bounded_groups(now, keys, ["s", "n", "root", "marks"], F.col("s"), block)
        pairs = common.stage(groups.mapInArrow(common.in_slices(_candidates(percent, forest), 64), "a long, b long").distinct(), "similar_pairs")
        if not forest:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        tried = pairs
        found.append(verified(pairs, texts_of(pairs, sets, rows), size, percent))
    common.drop(members)
    return found[0].unionByName(found[1]).unionByName(found[2])
