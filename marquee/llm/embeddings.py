"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted, and cut into cells of a width; ``projections`` cells
together name a bucket, in each of ``tables`` tables. For unit vectors a cosine of 0.95 is a distance of 0.316, for
which one projection agrees with probability 0.895 at width 2.4; 24 of them agree with 0.070, and in one of 76 tables
with 0.996, while unrelated vectors meet in a table once in 1.6 million.

First only bucket names are exchanged, to tell which buckets hold more than one vector; a vector is then sent to those of its buckets alone, which for
most vectors is none. Vectors of a bucket are compared exactly, in double precision. A pair that meets in several tables counts in
the first of them, which both sides can tell from their bucket names alone, so no pair list is ever gathered. Equal vectors are compared as
one, with the number of those that bear it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def signatures(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """(rows, tables) bucket names as int32 hashes of the cells."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    directions = rng.standard_normal((unit.shape[1], tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    cells = np.floor((unit @ directions + shift) / width).astype(np.int64).reshape(len(unit), tables, projections)
    h = np.zeros(cells.shape[:2], np.uint64)
    for k in range(projections):
        h = (h ^ cells[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _unit(vectors: list[bytes], dim: int, kind: type) -> np.ndarray:
    """Rows of length one, as doubles; cut by their greatest part first, so that no square overflows."""
    raw = np.frombuffer(b"".join(vectors), kind).reshape(-1, dim).astype(np.float64)
    raw /= np.abs(raw).max(axis=1)[:, None]
    return raw / np.linalg.norm(raw, axis=1)[:, None]


def _packed(kind: type):
    """(node, dim, vector as bytes) of (node, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(kind)
            data = [flat[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int32()), pa.array(data, pa.binary())], names=["node", "dim", "vector"])

    return run


def _buckets(tables: int, projections: int, width: float, seed: int, kind: type):
    """(tab, bucket, dim, node) of each vector in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, dims, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for dim in np.unique(dims).tolist():
                mine = np.nonzero(dims == dim)[0]
                for at in range(0, len(mine), 512):
                    rows = mine[at : at + 512]
                    names = signatures(_unit(vectors.take(pa.array(rows)).to_pylist(), dim, kind), tables, projections, width, seed) | np.int32(1)  # 0 stands for no bucket
                    n = len(rows)
                    columns = [np.tile(np.arange(tables, dtype=np.int32), n), names.ravel(), np.full(n * tables, dim, np.int32), np.repeat(nodes[rows], tables)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tab", "bucket", "dim", "node"])

    return run


def _sent(tables: int):
    """Each vector once per bucket that it shares, with the names of all of these (0 elsewhere). Columns in: node, own, n, dim, vector, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column(5)
                offsets, flat = lists.offsets.to_numpy(), lists.values
                tab, bucket = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                of = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                tab, bucket = tab[offsets[0] : offsets[-1]], bucket[offsets[0] : offsets[-1]]
                names = np.zeros((part.num_rows, tables), np.int32)
                names[of, tab] = bucket
                where = pa.array(of)
                columns = [pa.array(tab), pa.array(bucket), *(part.column(k).take(where) for k in (3, 0, 1, 2, 4)), pa.array([x.tobytes() for x in names], pa.binary()).take(where)]
                yield pa.RecordBatch.from_arrays(columns, names=["tab", "bucket", "dim", "node", "own", "n", "vector", "names"])

    return run


def _compare(min_cosine: float, kind: type):
    """Links of each bucket: (node, vectors linked here, least linked node of its star), one row per node at most."""

    def bucket(tab: int, same: bool, block: np.ndarray, ids: np.ndarray, own: np.ndarray, n: np.ndarray, x: np.ndarray, names: np.ndarray):
        counts = np.zeros(len(ids), np.int64)
        star_a, star_b = [], []
        left = np.arange(len(ids)) if same else np.nonzero(block == block.min())[0]
        right = left if same else np.nonzero(block != block.min())[0]
        if not len(right):
            return counts, np.empty(0, np.int64), np.empty(0, np.int64)
        step = max(1, 2_000_000 // len(right))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            i, j = np.nonzero(x[rows] @ x[right].T >= min_cosine - 1e-9)
            i, j = rows[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 200_000):
                a, b = i[k : k + 200_000], j[k : k + 200_000]
                ok = (np.einsum("ij,ij->i", x[a], x[b]) >= min_cosine) & ((own[a] != own[b]) | (own[a] == _NO_ONE))
                if tab:
                    ok &= ~((names[a, :tab] == names[b, :tab]) & (names[a, :tab] != 0)).any(axis=1)
                a, b = a[ok], b[ok]
                counts += np.bincount(a, n[b], len(ids)).astype(np.int64) + np.bincount(b, n[a], len(ids)).astype(np.int64)
                if len(a):
                    nodes, roots = common.union_find(ids[a], ids[b])
                    star_a.append(nodes)
                    star_b.append(roots)
        if not star_a:
            return counts, np.empty(0, np.int64), np.empty(0, np.int64)
        return counts, *common.union_find(np.concatenate(star_a), np.concatenate(star_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tabs, dims = batch.column("tab").to_numpy(), batch.column("dim").to_numpy()
            same = batch.column("i").to_numpy() == batch.column("j").to_numpy()
            lists = batch.column("members")
            offsets, flat = lists.offsets.to_numpy(), lists.values
            block, ids, own, n = (flat.field(k).to_numpy() for k in range(4))
            vectors, names = flat.field(4), flat.field(5)
            out = []
            for k in range(len(tabs)):
                a, b = offsets[k], offsets[k + 1]
                x = _unit(vectors.slice(a, b - a).to_pylist(), int(dims[k]), kind)
                m = np.frombuffer(b"".join(names.slice(a, b - a).to_pylist()), np.int32).reshape(b - a, -1)
                counts, nodes, roots = bucket(int(tabs[k]), bool(same[k]), block[a:b], ids[a:b], own[a:b], n[a:b], x, m)
                if len(nodes):
                    linked = counts > 0
                    who = ids[a:b][linked]
                    out.append((who, counts[linked], roots[np.searchsorted(nodes, who)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "links", "root"])

    return run


#: of nodes that stand for ids with one vector each
_NO_ONE = -(1 << 63)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, min_cosine: float = 0.95, tables: int = 76, projections: int = 24, width: float = 2.4, seed: int = 7, block: int = 1024) -> DataFrame:
    """One row (id_col, n_links, component) per input row: number of other vectors linked directly, least id reachable.

    Linked pairs have an exact cosine of ``min_cosine`` or more; pairs at just that value are found with probability
    0.996, nearer ones with more. Null, empty and zero vectors, and those with null or non-finite components, link with nothing,
    nor do vectors of different lengths. A null id gets its row with no links and a null component. Equal rows count
    once among links and all get the same result; rows of one id with different vectors share its links and component,
    and don't link with each other. Other columns are ignored. An empty table gives no rows.
    """
    single = dict(vectors.dtypes)[vector_col] == "array<float>"  # then half the bytes hold the same numbers
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    # 0.0 and -0.0 are one number
    plain = F.transform("vector", lambda x: x + F.lit(0.0).cast("float" if single else "double"))
    hashed = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("h1", F.xxhash64(plain)).withColumn("h2", F.xxhash64(F.lit(1), plain))
    good = hashed.where("usable")
    several = common.stage(good.groupBy("id").agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.min("h2").alias("u"), F.max("h2").alias("v")).where("x <> y or u <> v").select("id"), "several")
    mixed = not several.isEmpty()  # ids that bear different vectors stand for themselves
    own = several.withColumn("own", F.col("id"))
    good = good.join(own, "id", "left") if mixed else good.withColumn("own", F.lit(None).cast("long"))
    good = good.withColumn("own", F.coalesce("own", F.lit(_NO_ONE))).withColumn("node", F.xxhash64("h1", "h2", "own"))
    slim = common.stage(good.select("id", "node", "own").distinct(), "vector_ids")
    counted = slim.groupBy("node", "own").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    one = good.groupBy("node").agg(F.min_by("vector", "id").alias("vector"))
    packed = one.mapInArrow(_packed(kind), "node long, dim int, vector binary")
    nodes = common.stage(counted.join(packed, "node"), "vector_nodes")

    placed = nodes.select("node", "dim", "vector").mapInArrow(_buckets(tables, projections, width, seed, kind), "tab int, bucket int, dim int, node long")
    placed = common.stage(placed, "vector_buckets")
    keys = ["tab", "bucket", "dim"]
    shared = placed.groupBy(*keys).agg(F.count("*").alias("many")).where("many > 1")
    shared = common.stage(shared, "vector_shared")
    met = common.heavy_join(placed, shared, keys, "many", nodes.count() * tables)
    places = met.groupBy("node").agg(F.collect_list(F.struct("tab", "bucket")).alias("places"))  # at most one per table
    sent = common.stage(nodes.join(places, "node").select("node", "own", "n", "dim", "vector", "places"), "vector_places")
    common.drop(placed, shared)
    copies = sent.mapInArrow(_sent(tables), "tab int, bucket int, dim int, node long, own long, n long, vector binary, names binary")
    groups = common.bounded_groups(copies, keys, ["node", "own", "n", "vector", "names"], F.col("node"), block)
    found = common.stage(groups.mapInArrow(_compare(min_cosine, kind), "node long, links long, root long"), "vector_links")
    common.drop(sent)

    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if mixed:
        same = slim.where(F.col("own") != _NO_ONE).groupBy("own").agg(F.min("node").alias("b"))
        edges = edges.unionByName(slim.join(same, "own").select(F.col("node").alias("a"), "b"))
    comps = common.components(edges).toDF("node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "n", "least").join(links, "node", "left").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = common.stage(known, "vector_classes")
    least = common.stage(known.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n_root")), "root_least")
    named = common.heavy_join(known, least, ["root"], "n_root", known.count())
    named = common.stage(named.select("node", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component"), "vector_named")
    by_id = common.heavy_join(slim.select("id", "node"), named, ["node"], "n", slim.count()).select("id", "links", "component")
    if mixed:
        by_id = by_id.groupBy("id").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    out = rows.select("id").join(by_id, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def op8_pstable(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))
