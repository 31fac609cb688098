"""Diverse selection: ranks, wildcard slots, and the greedy choice of a user's list."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocab
from .groups import spread_join


def ranked(scored: DataFrame, user: str = "user_id", within: tuple[str, ...] = ()) -> DataFrame:
    """rank 1..n per user, best score first, ties in input order. ``within``: columns with one value for each user, by which the rows are dealt to tasks already
    (see ``spread_join``); with them no exchange is needed."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*within, user).orderBy(F.desc("score"), "ord")))


def top_k(scored: DataFrame, k: int, user: str = "user_id", within: tuple[str, ...] = ()) -> DataFrame:
    """The best k per user; where there is an exchange, the group limit is pushed below it by the optimizer."""
    return ranked(scored, user, within).where(F.col("rank") <= k)


def top_k_bounded(users: DataFrame, events: DataFrame, k: int, *, on: str, block: list[str], own: Column, static: Column, score: Callable[[DataFrame], DataFrame], user: str = "user_id", slack: float = 2e-6) -> DataFrame:
    """``top_k`` of all pairs of users and events that share ``on``, while few pairs are scored.

    A pair's score is ``own``, which depends on the user and on the event's ``block`` columns alone, plus ``static``, which depends on the event alone. Of each
    block the best ``k`` static parts are kept; with a user's own part of each block they give the user's k-th best score. Only blocks whose best event reaches it, and
    in these only events that do, are joined and scored by ``score`` (pairs in, a column score and ord out). ``slack`` is more than sums can differ by their order and
    by rounding. A user with fewer than ``k`` events keeps all."""
    keys = [on, *block]
    rated = events.withColumn("_static", static)
    best = rated.select(*keys, "_static").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_static")))).where(F.col("_n") <= k)
    blocks = best.groupBy(*keys).agg(F.sort_array(F.collect_list("_static"), asc=False).alias("_best"))
    met = spread_join(blocks, users, [on], user)
    # a user's blocks stand in one row, made where they met
    item = F.struct(*block, own.alias("own"), F.col("_best").alias("best"))
    rest = [c for c in users.columns if c not in (on, user)]
    held = met.groupBy(on, "_part", user).agg(F.first(F.struct(*rest)).alias("_user"), F.collect_list(item).alias("_blocks"))
    sums = F.flatten(F.transform("_blocks", lambda b: F.transform(b["best"], lambda x: x + b["own"])))
    bar = F.coalesce(F.get(F.sort_array(sums, asc=False), F.lit(k - 1)), F.lit(float("-inf")))
    barred = held.select(on, user, "_user", "_blocks", bar.alias("_bar"))
    reach = F.filter("_blocks", lambda b: F.get(b["best"], F.lit(0)) >= F.col("_bar") - b["own"] - slack)
    open_ = barred.select(on, user, "_user.*", "_bar", F.explode(reach).alias("_block"))
    open_ = open_.select(on, user, *rest, *(F.col("_block")[c].alias(c) for c in block), (F.col("_bar") - F.col("_block")["own"] - slack).alias("_least"))
    pairs = spread_join(rated, open_, keys, user).where(F.col("_static") >= F.col("_least")).drop("_static", "_least")
    return top_k(score(pairs), k, user)


def wildcards(rows: DataFrame, user: str = "user_id", within: tuple[str, ...] = ()) -> Column:
    """Whether a ranked row is one of the two most novel of middling score."""
    low, high = vocab.WILDCARD_SCORES
    fit = F.col("score").between(low, high) & (F.col("novelty") >= vocab.WILDCARD_MIN_NOVELTY)
    w = Window.partitionBy(*within, user, fit).orderBy(F.desc("novelty"), "rank")
    return fit & (F.row_number().over(w) <= vocab.WILDCARD_SLOTS)


def totals(picks: DataFrame, names: list[str]) -> DataFrame:
    """(category, n, n_venues, n_dates): for each of ``names`` the picks that bear it, zero included, and the different venues and days of all picks. Picks:
    category, venue, date. A selection is summed up by one aggregation for each figure; names are few."""
    whole = picks.agg(F.count_distinct("venue").alias("n_venues"), F.count_distinct("date").alias("n_dates"))
    per = picks.where(F.col("category").isin(*names)).groupBy("category").agg(F.count("*").alias("n"))
    every = picks.sparkSession.createDataFrame([(c,) for c in names], "category string")
    return every.join(F.broadcast(per), "category", "left").crossJoin(F.broadcast(whole)).select("category", F.coalesce("n", F.lit(0)).alias("n"), "n_venues", "n_dates")  # one row


def choose(pool: list[dict], limit: int = vocab.MAX_PICKS) -> list[dict]:
    """Up to ``limit`` rows of a pool in rank order: at most 3 per category and 2 per venue. Rows: event_id, score,
    categories, venue, date, wildcard.

    Wildcards by score come first (two at most), then the pool in order. If all picks fall on one date, the pick with the
    least score that isn't a wildcard makes way for the best other row on another date that fits. If no wildcard was picked, one is
    added, or takes the place of the lowest-scored pick that it can replace; that step looks at the constant of ten picks,
    so a smaller limit can be exceeded by one.
    """
    picks: list[dict] = []

    def ids(rows: list[dict]) -> set[str]:
        return {r["event_id"] for r in rows}

    def room(row: dict, among: list[dict]) -> bool:
        kinds, venues = Counter(c for p in among for c in p["categories"]), Counter(p["venue"] for p in among)
        return all(kinds[c] < vocab.MAX_PER_CATEGORY for c in row["categories"]) and venues[row["venue"]] < vocab.MAX_PER_VENUE

    def fits(row: dict) -> bool:
        return row["event_id"] not in ids(picks) and room(row, picks)

    def by_score(rows: list[dict], best: bool) -> list[dict]:
        return sorted(rows, key=lambda r: r["score"], reverse=best)

    def swap(newcomers: list[dict], outer_new: bool) -> bool:
        """Replace one pick that is no wildcard. The outer loop runs over newcomers or over picks."""
        leaving = by_score([p for p in picks if not p["wildcard"]], best=False)
        pairs = [(n, o) for n in newcomers for o in leaving] if outer_new else [(n, o) for o in leaving for n in newcomers]
        for new, old in pairs:
            if room(new, [p for p in picks if p is not old]):
                picks.remove(old)
                picks.append(new)
                return True
        return False

    for row in by_score([r for r in pool if r["wildcard"]], best=True)[: vocab.MAX_WILDCARDS]:
        if len(picks) < limit and fits(row):
            picks.append(row)
    for row in pool:
        if len(picks) >= limit:
            break
        if fits(row):
            picks.append(row)

    dates = {p["date"] for p in picks}
    if 2 <= len(picks) and len(dates) < vocab.MIN_DATES:
        swap(by_score([r for r in pool if r["event_id"] not in ids(picks) and r["date"] not in dates and not r["wildcard"]], best=True), outer_new=False)

    for row in by_score([r for r in pool if r["wildcard"] and r["event_id"] not in ids(picks)], best=True):
        if any(p["wildcard"] for p in picks):
            break
        if len(picks) < vocab.MAX_PICKS:
            if fits(row):
                picks.append(row)
        else:
            swap([row], outer_new=True)
    return by_score(picks, best=True)


#: pools that a task holds as Python rows at once
_POOLS = 32


def curate(rows: DataFrame, user: str = "user_id", limit: int = vocab.MAX_PICKS, within: tuple[str, ...] = ()) -> DataFrame:
    """The greedy choice per user. A user's pool is what was ranked for them; it is first cut to the rows that could ever be
    chosen: per category and venue the choice takes few, but dates and wildcards may reach further, so wildcards and the
    best rows of each (venue, categories, date) stay. ``within`` as in ``ranked``. A task takes a few pools at a time."""
    kinds = F.when(F.size("categories") > 0, F.transform("categories", F.lower)).otherwise(F.array(F.lit("uncategorized")))
    keyed = rows.withColumn("_kinds", kinds)
    w = Window.partitionBy(*within, user, "venue", "_kinds", "event_date", "wildcard").orderBy("rank")
    few = keyed.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= limit) | F.col("wildcard")).drop("_n")

    kind = dict(rows.dtypes)[user]
    pick = "array<struct<event_id:string,score:double,wildcard:boolean>>"
    item = F.struct("rank", "event_id", "score", F.col("_kinds").alias("categories"), "venue", F.col("event_date").alias("date"), "wildcard")
    pools = few.groupBy(*within, user).agg(F.array_sort(F.collect_list(item)).alias("pool")).select(user, "pool")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("event_id", pa.string()), ("score", pa.float64()), ("wildcard", pa.bool_())]))
        for whole in batches:
            for at in range(0, whole.num_rows, _POOLS):
                batch = whole.slice(at, _POOLS)
                chosen = [[{k: r[k] for k in ("event_id", "score", "wildcard")} for r in choose(pool, limit)] for pool in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, shape)], names=[user, "picks"])

    picked = pools.mapInArrow(run, f"`{user}` {kind}, picks {pick}")
    each = picked.select(user, F.posexplode("picks").alias("position", "pick"))
    return each.select(user, (F.col("position") + 1).alias("position"), "pick.*")
