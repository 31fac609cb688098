"""Joins and groups on keys of which some are frequent, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import drop, stage

#: a key is heavy if it bears more than one row in so many; there are fewer heavy keys than that
_SHARE = 1000


def heavy_join(rows: DataFrame, lookup: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, which has one row per key, without nulls among the keys, and in ``n`` the number of
    rows that bear it. ``total``: number of ``rows``.

    Fewer than ``_SHARE`` keys can bear more than a ``_SHARE``-th of all rows each: these are broadcast, with that proven bound, and their
    rows stay where they are. All others go through an exchange, in which no key is heavy."""
    heavy = lookup.where(F.col(n) * _SHARE > total)
    light = lookup.where(F.col(n) * _SHARE <= total)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))


def join_few(rows: DataFrame, few: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """Inner join with a staged table of different keys: up to ``bound`` of them are counted and broadcast, so that ``rows`` stay where they
    are; more of them meet the rows in an exchange."""
    return rows.join(F.broadcast(few) if few.count() <= bound else few.hint("merge"), keys)


def spread_join(few: DataFrame, many: DataFrame, keys: list[str], deal: str, parts: int = 64) -> DataFrame:
    """Inner join on keys that are no bound for a task: the rows of ``many`` that share one are dealt into parts by ``deal``, each of which gets a copy of
    the key's rows of ``few``, the smaller side. The part stays as ``_part``.

    The work is in the pairs, not in the rows that are read, so the number of tasks is a fixed one: small inputs would be merged into few tasks, or broadcast to the few
    that read a small file. Rows come out dealt by ``keys`` and ``_part``, so a group by these and more needs no exchange."""
    tasks = int(few.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, *keys, "_part")
    dealt = many.withColumn("_part", F.pmod(F.xxhash64(deal), F.lit(parts)).cast("int")).repartition(tasks, *keys, "_part")
    return copies.join(dealt.hint("merge"), [*keys, "_part"])


def bounded_groups(members: DataFrame, keys: list[str], payload: list[str], salt: Column, limit: int) -> DataFrame:
    """Rows of ``members`` that share ``keys`` (without nulls), brought together so that every pair of a group meets exactly once in one
    output row, while no row holds more than about ``2 * limit`` members.

    A group of n > limit members is dealt into ceil(n / limit) blocks by the hash of ``salt``; each pair of blocks is one row.
    Members learn of their group's size without an exchange that would bring a large group together.
    Columns out: keys, i, j, members (array of struct<block, payload...>). Where i < j, only pairs across the two
    blocks are to be compared; where i = j, all pairs. Groups of one member are left out.
    """
    sizes = members.groupBy(*keys).agg(F.count("*").alias("n_members"))
    hot = stage(sizes.where(F.col("n_members") > limit), "hot")
    item = F.struct(F.col("block"), *payload)
    alone = [F.lit(0).alias("i"), F.lit(0).alias("j")]
    if hot.isEmpty():
        grouped = members.withColumn("block", F.lit(0)).groupBy(*keys).agg(F.collect_list(item).alias("members"))
        return grouped.where(F.size("members") > 1).select(*keys, *alone, "members")
    # a limit or a thousandth of the members, whichever is more, makes a group too large for an exchange; these are few
    total = hot.agg(F.sum("n_members")).first()[0]
    large = heavy_join(members, hot, keys, "n_members", total)
    small = members.join(hot.select(*keys), keys, "left_anti") if hot.count() > _SHARE else members.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    blocks = F.ceil(F.col("n_members") / limit).cast("int")
    wide = large.withColumn("block", F.pmod(F.xxhash64(salt), blocks).cast("int"))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    wide = wide.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("n_members", "other")
    both = wide.unionByName(small.select("*", F.lit(0).alias("block"), *alone))
    grouped = both.groupBy(*keys, "i", "j").agg(F.collect_list(item).alias("members"))
    return grouped.where(F.size("members") > 1).select(*keys, "i", "j", "members")


# ---- connected components ----


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the graph with edges a-b; a root is the least node of its component."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)].tolist(), index[len(a) :].tolist()
    parent = list(range(len(nodes)))
    for x, y in zip(left, right, strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for k in range(len(parent)):  # parents have smaller numbers, so theirs are final already
        parent[k] = parent[parent[k]]
    return nodes, nodes[parent]


def _pair(x: np.ndarray, y: np.ndarray, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind), pa.array(y, kind)], names=names)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning stars of what one task has read; contracted again and again, so that memory follows the nodes."""
    parts, held, kind = [], 0, None
    for batch in batches:
        kind = batch.column(0).type
        parts.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
        held += batch.num_rows
        if held > 500_000:
            a, b = union_find(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            parts, held = [(a[a != b], b[a != b])], 0
    if parts:
        a, b = union_find(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield _pair(a[a != b], b[a != b], ["a", "b"], kind)


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    if parts:
        yield _pair(*union_find(*(np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in parts]) for k in (0, 1))), ["node", "root"], parts[0].column(0).type)


def components(edges: DataFrame, finish_edges: int = 1_000_000) -> DataFrame:
    """Connected components of ``edges`` (two columns of bigint or of string): one row (node, root) for each node that has an edge;
    root is the component's least node. Rows with nulls and loops count as no edge.

    Each task first contracts its own edges to spanning stars. Rounds of "point to the least neighbour, jump twice,
    relabel" then shrink the graph; once at most ``finish_edges`` edges are left (a checked bound, of ids), one
    task ends the work. Every round's table is staged, so no lineage grows and nothing is brought to the driver. Nodes with a thousandth of
    all edges are no heavy keys of an exchange.
    """
    names = edges.columns
    kind = "string" if dict(edges.dtypes)[names[0]] == "string" else "long"
    pair, label = f"a {kind}, b {kind}", f"node {kind}, root {kind}"
    clean = edges.select(F.col(names[0]).cast(kind).alias("a"), F.col(names[1]).cast(kind).alias("b")).where("a <> b")
    e = stage(clean.mapInArrow(_forest, pair), "edges")
    labels = None
    while True:
        n = e.count()
        if n <= finish_edges:
            last = stage(e.repartition(1).mapInArrow(_labels, label), "labels")
            drop(e)
            return last if labels is None else _follow(labels, last)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"), F.count("*").alias("n")), "step")
        degree = step.select("node", "n")
        first_step = step
        for _ in range(2):
            step = stage(_follow(step, step), "step")
        sized = step.join(degree, "node")
        x, y = sized.toDF("a", "ra", "n"), sized.toDF("b", "rb", "n")
        first = heavy_join(e, x, ["a"], "n", n).drop("n")
        relabelled = heavy_join(first, y, ["b"], "n", n).select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct()
        labels = step if labels is None else stage(_follow(labels, step).unionByName(step.join(labels.select("node"), "node", "left_anti")), "labels")
        before, e = e, stage(relabelled.mapInArrow(_forest, pair), "edges")
        drop(before, first_step)


def _follow(labels: DataFrame, step: DataFrame) -> DataFrame:
    """Labels after one more step; what the step doesn't hold stays. A root that bears a large share of the labels is no key of an exchange."""
    s = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
    sizes = labels.groupBy("root").agg(F.count("*").alias("n_root")).join(s, "root", "left")
    lookup = stage(sizes.select("root", F.coalesce("next", "root").alias("next"), "n_root"), "follow")
    return heavy_join(labels, lookup, ["root"], "n_root", labels.count()).select("node", F.col("next").alias("root"))
