"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a key: a hash of the group (equal texts stand together), then a hash of the id. Shard borders are found by
counting: each round splits the key range of every open border by evenly spaced probes, counts the exact bytes below
every probe in one aggregation over all partitions, and keeps the one stretch between two probes that holds the border.
A border is settled when a probe is within the tolerance, or when the stretch holds a single key. A group larger than
the tolerance is cut within, by the same rounds over its ids. Then the rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: keys are hashes cut to so many bits, so that their arithmetic stays within a bigint
KEY_BITS = 62
_TOP = 1 << KEY_BITS
#: the level that numbers rows
_ROW = "row_number"


@dataclass
class Border:
    """Where a shard begins: ``want`` bytes are to lie below. It is sought among the rows whose first levels are ``at`` and
    whose next one is in [low, high), ``below`` bytes before them. ``cut`` is the splitter once settled: rows whose levels are less than it,
    compared from the first on, are before the border."""

    want: int
    at: tuple[int, ...] = ()
    low: int = 0
    high: int = _TOP
    below: int = 0
    cut: tuple[int, ...] | None = None


def hash_key(*columns: Column) -> Column:
    """0 to 2^62 - 1."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(_TOP - 1))


def _count(slim: DataFrame, levels: list[str], spans: list[tuple[tuple[int, ...], int, int]], probes: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Exact bytes, least and greatest value, for each (span, stretch): at most len(spans) * probes rows reach the driver."""
    span, stretch, value = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for number, (at, low, high) in enumerate(spans):
        level = levels[len(at)]
        inside = F.col(level).between(low, high - 1)
        for name, x in zip(levels, at, strict=False):
            inside = (F.col(name) == x) & inside
        width = -(-(high - low) // probes)
        span = F.when(inside, F.lit(number)).otherwise(span)
        stretch = F.when(inside, F.expr(f"({level} - {low}L) div {width}L")).otherwise(stretch)
        value = F.when(inside, F.col(level)).otherwise(value)
    seen = slim.select(span.alias("span"), stretch.alias("stretch"), value.alias("k"), "size").where("span is not null")
    rows = seen.groupBy("span", "stretch").agg(F.sum("size").alias("bytes"), F.min("k").alias("least"), F.max("k").alias("most")).collect()
    return {(r["span"], r["stretch"]): (r["bytes"], r["least"], r["most"]) for r in rows}


def splitters(slim: DataFrame, levels: list[str], total: int, shards: int, tolerance: float, probes: int = 512) -> list[tuple[int, ...]] | None:
    """The ``shards - 1`` cuts, ascending. ``slim`` has the levels (0 to 2^62 - 1 each) and size, ``total`` bytes in all. None
    where a border would have to lie among rows that are equal in all levels and larger than the tolerance."""
    slack = tolerance * total / shards
    borders = [Border(want=total * k // shards) for k in range(1, shards)]
    while total and (open_ := [b for b in borders if b.cut is None]):
        spans = sorted({(b.at, b.low, b.high) for b in open_})
        found = _count(slim, levels, spans, probes)
        for b in open_:
            number, below = spans.index((b.at, b.low, b.high)), b.below
            for stretch in sorted(k for s, k in found if s == number):
                size, least, most = found[number, stretch]
                if below + size >= b.want:
                    break
                below += size
            # the border is before, within or after the values from least to most of this stretch
            before, after = b.want - below, below + size - b.want
            last = len(b.at) == len(levels) - 1
            if min(before, after) <= slack or (least == most and last and size == 1):
                b.cut = (*b.at, least if before <= after else most + 1)
            elif least < most:
                b.low, b.high, b.below = least, most + 1, below
            elif not last:  # one group is larger than the tolerance: go on within it
                b.at, b.low, b.high, b.below = (*b.at, least), 0, _TOP, below
            elif levels[-1] == _ROW:  # one row is larger than the tolerance
                b.cut = (*b.at, least if before <= after else most + 1)
            else:
                return None
    return sorted(b.cut or (0,) for b in borders)


def _not_before(cut: tuple[int, ...], levels: list[str]) -> Column:
    """Whether a row is at or after the cut."""
    past = F.col(levels[len(cut) - 1]) >= cut[-1]
    for name, x in reversed(list(zip(levels, cut[:-1], strict=False))):
        past = (F.col(name) > x) | ((F.col(name) == x) & past)
    return past


def shard_of(cuts: list[tuple[int, ...]], levels: list[str]) -> Column:
    """Number of cuts at or before the row."""
    out = F.lit(0)
    for cut in cuts:
        out = out + _not_before(cut, levels).cast("int")
    return out


def parts_of(slim: DataFrame, cuts: list[tuple[int, ...]], levels: list[str], shards: int, tasks: int) -> tuple[Column, int]:
    """(number of the task that writes a row, tasks of a shard at most). Tasks follow the order of the levels.

    Values are hashes, so they lie evenly: a shard's rows are dealt by where they stand between its first and last key. Where it begins
    or ends within a group of equal texts, that group is dealt by its second level, with as many tasks as its bytes ask for."""
    shard = shard_of(cuts, levels)
    if tasks == 1:
        return shard.cast("int"), 1
    key, tie = (F.col(x).cast("double") for x in levels[:2])
    lows, highs = [(0,), *cuts], [*cuts, (_TOP,)]
    head = [c[0] if len(c) > 1 else -1 for c in lows]
    tail = [c[0] if len(c) > 1 and c[0] != h else -1 for c, h in zip(highs, head, strict=True)]

    def per_shard(values: list) -> Column:
        return F.get(F.array(*(F.lit(v) for v in values)), shard)

    segment = F.when(F.col("key") == per_shard(head), 0).when(F.col("key") == per_shard(tail), 2).otherwise(1)
    rows = slim.groupBy(shard.alias("shard"), segment.alias("segment")).agg(F.sum("size").alias("bytes")).collect()
    sizes = {(r["shard"], r["segment"]): r["bytes"] for r in rows}
    begin, many = [[], [], []], [[], [], []]
    for s in range(shards):
        at, all_ = 0, sum(sizes.get((s, g), 0) for g in range(3))
        for g in range(3):
            n = max(1, round(tasks * sizes[s, g] / all_)) if (s, g) in sizes else 0
            begin[g].append(at)
            many[g].append(max(1, n))
            at += n
    second = lambda c, none: float(c[1]) if len(c) > 1 else none
    ends = [second(h, float(_TOP)) if h[0] == low[0] and len(h) > 1 else float(_TOP) for low, h in zip(lows, highs, strict=True)]
    bounds = [(tie, [second(c, 0.0) for c in lows], ends), (key, [float(c[0]) for c in lows], [float(c[0]) for c in highs]), (tie, [0.0] * shards, [second(c, float(_TOP)) for c in highs])]
    place = F.lit(0)
    for g, (value, low, high) in enumerate(bounds):
        share = F.try_divide(value - per_shard(low), per_shard(high) - per_shard(low))
        within = F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0)) * per_shard(many[g])), F.lit(0)), per_shard(many[g]) - 1)
        place = F.when(segment == g, per_shard(begin[g]) + within).otherwise(place)
    width = tasks + 3
    return (shard * width + place).cast("int"), width


def shard_documents(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005, task_bytes: int = 256 << 20) -> DataFrame:
    """All columns of ``docs`` and shard (0 to shards - 1) and slot (gapless from 0 within the shard).

    Law: bytes. The size of a row is the UTF-8 bytes of its text (null: none) plus 1; shard sizes differ from their
    share by at most ``tolerance``, or by one row where rows are larger than that. Equal texts lie together, and are cut
    only where a border would else miss the tolerance.

    Ties: rows with the same text and id stay together unless a border would miss the tolerance; they are then numbered once, in a
    staged copy of the table, and split by that number. Null texts are one group, and so are null ids within theirs. Very long texts are
    rows like others. An empty table gives no rows. Columns named shard or slot are replaced, others stay, whatever their names.

    Large shards are written by several tasks of about ``task_bytes``, each a stretch of the shard's order; slots follow that order.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    text = F.col(text_col).cast("string")
    if {"key", "tie", "size", "part", "base", "at", _ROW} & set(names):  # clashing names: set the row aside in a struct
        packed = docs.select(F.struct(*names).alias("packed"), F.col(id_col).alias("id"), text.alias("text"))
        placed = shard_documents(packed, shards, id_col="id", text_col="text", tolerance=tolerance, task_bytes=task_bytes)
        return placed.select("packed.*", "shard", "slot")
    levels = ["key", "tie"]
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    keyed = docs.select(*names, hash_key(text).alias("key"), hash_key(F.col(id_col).cast("long")).alias("tie"), size.alias("size"))
    slim = common.stage(keyed.select(*levels, "size"), "shard_keys")
    total = slim.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(slim, levels, total, shards, tolerance)
    if cuts is None:
        levels = [*levels, _ROW]
        keyed = common.stage(keyed.withColumn(_ROW, F.monotonically_increasing_id()), "shard_rows")
        slim = keyed.select(*levels, "size")
        cuts = splitters(slim, levels, total, shards, tolerance)
    part, width = parts_of(slim, cuts, levels, shards, max(1, -(-total // (shards * task_bytes))))
    # tasks of a shard follow each other: at most total / task_bytes + 3 * shards rows
    counts = slim.select(part.alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("group", F.floor(F.col("part") / width))
    w = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    moved = keyed.withColumn("part", part).repartitionById(shards * width, F.col("part")).sortWithinPartitions(*levels)
    placed = moved.withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = placed.join(F.broadcast(base), "part")
    return placed.select(*names, F.floor(F.col("part") / width).cast("int").alias("shard"), (F.col("at") + F.col("base")).cast("long").alias("slot"))


def op6_histogram_sort(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(common.table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
