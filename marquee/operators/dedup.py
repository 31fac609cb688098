"""Duplicate listings: exact by id, fuzzy by title within a day and venue, merged to one row."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import venue_key
from ..storage import stage
from . import groups

SIMILAR_ABOVE = 0.85


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b), the longest common subsequence by bit-parallel rows. 1 for two empty strings."""
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for k, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def shared_grams(a: int, b: int) -> int:
    """How many bigrams, counted with their repeats, two different strings of these lengths share at least if they are similar above ``SIMILAR_ABOVE``.

    They are fewer than (1 - SIMILAR_ABOVE) * (a + b) single insertions and deletions apart. A deletion takes at most two bigrams from the one string and breaks at
    most one of the other, and an insertion the other way round; half the sum of what is left on both sides is a lower bound."""
    apart = math.ceil(round((1 - SIMILAR_ABOVE) * (a + b), 9)) - 1
    return max(0, -(-(a + b - 2 - 3 * apart) // 2))


@lru_cache(100_000)
def _leading(length: int) -> int:
    """Of a string's bigrams, in any fixed order, so many first ones hold one that each similar string has among its own first ones; 0 if there is no such string."""
    partners = [n for n in range(1, 2 * length + 1) if 2 * min(length, n) > SIMILAR_ABOVE * (length + n) and (n != length or (1 - SIMILAR_ABOVE) * 2 * length > 2)]
    if not partners:
        return 0
    need = min(shared_grams(length, n) for n in partners)
    return length - 1 - need + 1 if need > 0 else length - 1


def leading_grams(title: str) -> list[str]:
    """The first of a title's bigrams, each with the number of its occurrence, in an order that is the same for all titles."""
    seen: dict[str, int] = {}
    grams = []
    for k in range(len(title) - 1):
        gram = title[k : k + 2]
        seen[gram] = seen.get(gram, 0) + 1
        grams.append(f"{gram}{seen[gram]}")
    return sorted(grams, key=lambda g: (zlib.crc32(g.encode("utf-8", "surrogatepass")), g))[: _leading(len(title))]


#: titles whose similarities a task remembers as a table
_KNOWN = 4096
#: titles of a block that are compared in one task
_BLOCK = 2048


class _Similarities:
    """Similarity of titles by number, each pair worked out once; 0 where the lengths or the bigrams in common rule it out."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.titles: list[str] = []
        self.grams: list[Counter] = []
        self.table = np.full((64, 64), np.nan)

    def of(self, titles: list[str]) -> np.ndarray:
        if len(self.titles) + len(titles) > _KNOWN:
            self.__init__()
        for t in titles:
            if t not in self.number:
                self.number[t] = len(self.titles)
                self.titles.append(t)
                self.grams.append(Counter(zip(t, t[1:])))  # noqa: B905
        if len(self.titles) > len(self.table):
            wider = np.full((2 * len(self.titles),) * 2, np.nan)
            wider[: len(self.table), : len(self.table)] = self.table
            self.table = wider
        at = np.array([self.number[t] for t in titles])
        part = self.table[np.ix_(at, at)]
        for x, y in zip(*(at[k] for k in np.nonzero(np.isnan(part))), strict=True):
            if x <= y:
                a, b = self.titles[x], self.titles[y]
                possible = a == b or (2 * min(len(a), len(b)) > SIMILAR_ABOVE * (len(a) + len(b)) and sum((self.grams[x] & self.grams[y]).values()) >= shared_grams(len(a), len(b)))
                self.table[x, y] = self.table[y, x] = indel_ratio(a, b) if possible else 0.0
        return self.table[np.ix_(at, at)]


_PAIR = "event_date date, venue_key string, a string, b string, left_id string, right_id string, similarity double"


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of titles of a block that are alike, with the least id of each."""
    known = _Similarities()
    for batch in batches:
        lists = batch.column("members")
        offsets, flat = lists.offsets.to_numpy(), lists.values
        block, titles = flat.field(0).to_numpy(), flat.field(1).to_pylist()
        same = batch.column("i").to_numpy() == batch.column("j").to_numpy()
        rows, left, right, share = [], [], [], []
        for k in range(len(same)):
            at = offsets[k]
            table = known.of(titles[at : offsets[k + 1]])
            x, y = np.nonzero(np.triu(table > SIMILAR_ABOVE, 1))
            if not same[k]:
                ok = block[at + x] != block[at + y]
                x, y = x[ok], y[ok]
            rows.append(np.full(len(x), k))
            left.append(at + x)
            right.append(at + y)
            share.append(table[x, y])
        if not rows:
            continue
        rows, left, right = (pa.array(np.concatenate(x)) for x in (rows, left, right))
        keys = [batch.column(c).take(rows) for c in ("event_date", "venue_key")]
        yield pa.RecordBatch.from_arrays([*keys, *(flat.field(f).take(x) for f in (1, 2) for x in (left, right)), pa.array(np.concatenate(share))], schema=_PAIR_ARROW)


_PAIR_ARROW = pa.schema([("event_date", pa.date32()), ("venue_key", pa.string()), ("a", pa.string()), ("b", pa.string()), ("left_id", pa.string()), ("right_id", pa.string()), ("similarity", pa.float64())])
_CLASS = ["event_date", "venue_key", "title"]


def _named(events: DataFrame) -> DataFrame:
    """(day, venue, title, event_id): different ids of each title of each day and venue, nulls included."""
    named = events.select(F.col("event_date").cast("date").alias("event_date"), venue_key(F.col("venue")).alias("venue_key"), "title", "event_id")
    return stage(named.distinct(), "title_classes")


def _keyed_by_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [leading_grams(t) for t in batch.column(2).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
        yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array([g for k in keys for g in k], pa.string())], names=["event_date", "venue_key", "title", "least", "gram"])


def _alike_titles(classes: DataFrame) -> DataFrame:
    """Different titles of a day and venue that are alike, and the least id of each. In a block of up to ``_BLOCK`` titles each is compared with each; in larger ones
    only titles that share one of their leading bigrams meet, which all that are alike do."""
    block = ["event_date", "venue_key"]
    titles = stage(classes.groupBy(*_CLASS).agg(F.min("event_id").alias("least")), "titles")
    large = stage(titles.groupBy(*block).count().where(F.col("count") > _BLOCK).select(*block), "large_blocks")
    if large.isEmpty():
        return groups.bounded_groups(titles, block, ["title", "least"], F.col("title"), _BLOCK).mapInArrow(_alike, _PAIR)
    small = groups.bounded_groups(titles.join(large, block, "left_anti"), block, ["title", "least"], F.col("title"), _BLOCK).mapInArrow(_alike, _PAIR)
    keyed = titles.join(large, block, "left_semi").select(*block, "title", "least").mapInArrow(_keyed_by_grams, "event_date date, venue_key string, title string, least string, gram string")
    met = groups.bounded_groups(keyed, [*block, "gram"], ["title", "least"], F.col("title"), _BLOCK)
    return small.unionByName(met.drop("gram").mapInArrow(_alike, _PAIR).distinct())


def fuzzy_pairs(events: DataFrame) -> DataFrame:
    """(left_id, right_id, similarity) of different ids on the same day at the same venue whose titles are alike or equal. Titles are
    compared once per distinct pair of a block, whatever the number of rows that bear them."""
    classes = _named(events).dropna()  # events without one of these are like no other
    ids = classes.toDF("event_date", "venue_key", "a", "left_id"), classes.toDF("event_date", "venue_key", "b", "right_id")
    block = ["event_date", "venue_key"]
    across = _alike_titles(classes).drop("left_id", "right_id").join(ids[0], [*block, "a"]).join(ids[1], [*block, "b"])
    within = ids[0].join(classes.toDF(*block, "a", "right_id"), [*block, "a"]).withColumn("similarity", F.lit(1.0))
    columns = ["left_id", "right_id", "similarity"]
    pairs = across.select(*columns).unionByName(within.where("left_id < right_id").select(*columns)).where("left_id <> right_id")
    return pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "similarity").distinct()


def merge(events: DataFrame, cluster: str = "event_id") -> DataFrame:
    """One row per cluster: the row of the best source (quality, then feed name, then the first in order), all feeds
    sorted, and how it was merged. One aggregation: the order is folded into the arg-max by inverting its hex digits, so ``ord`` has
    digits, a to f and separators at fixed places."""
    rest = [c for c in events.columns if c != cluster]
    inverted = F.translate("ord", "0123456789abcdef", "fedcba9876543210")
    grouped = events.groupBy(cluster).agg(
        F.max_by(F.struct(*rest), F.struct("source_quality", "feed", inverted)).alias("row"),
        F.array_sort(F.collect_set("feed")).alias("source_feeds"),
        F.count("*").alias("n_members"),
        *([] if cluster == "event_id" else [(F.min("event_id") == F.max("event_id")).alias("one_id")]),
    )
    one = F.lit(True) if cluster == "event_id" else F.col("one_id")
    kind = F.when(F.col("n_members") <= 1, "none").when(one, "exact_id").otherwise("fuzzy")
    return grouped.select(cluster, *(F.col("row")[c].alias(c) for c in rest), "source_feeds", F.size("source_feeds").alias("source_count"), "n_members", kind.alias("merge_type"))


def clusters(events: DataFrame) -> DataFrame:
    """(event_id, cluster), one row per id: transitive closure of fuzzy pairs, and of rows that share an id, over all days and venues; a cluster is
    named by its least id. The ids of one title hang on the least of them, so there are as many edges as ids and alike titles, not pairs of rows."""
    named = _named(events)
    classes = named.dropna()
    least = classes.groupBy(*_CLASS).agg(F.min("event_id").alias("least"), F.count("*").alias("n"))
    stars = classes.join(least.where("n > 1"), _CLASS).select(F.col("least").alias("a"), F.col("event_id").alias("b"))
    across = _alike_titles(classes).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    closed = groups.components(stars.unionByName(across)).toDF("event_id", "cluster")
    return named.select("event_id").distinct().join(closed, "event_id", "left").select("event_id", F.coalesce("cluster", "event_id").alias("cluster"))
