"""Keyed tables: caches with expiry, upserts, first matches, back joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins. An aggregation, so partial results are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row"))
    return best.select(*keys, *(F.col("row")[c].alias(c) for c in rest))


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: str) -> DataFrame:
    """Each left row with the first right row (least ``order``) of its keys; null columns where none fits. The right side
    is brought to one row per key before the join, so a frequent key makes no more rows than the left side has."""
    rest = [c for c in right.columns if c not in on]
    first = right.groupBy(*on).agg(F.min_by(F.struct(*rest), F.col(order)).alias("match"))
    return left.join(first, on, "left").select(*left.columns, *(F.col("match")[c].alias(f"match_{c}") for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after the writes of ``new``: a fresh snapshot."""
    return latest_per_key(old.unionByName(new), keys, order)


def hits_and_misses(entries: DataFrame, cache: DataFrame, keys: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """Entries whose key has an unexpired row, with that row's columns, and the others. Expired at ``expires_at <= now``."""
    live = cache.where(F.col("expires_at") > now)
    return entries.join(live, keys), entries.join(live.select(*keys), keys, "left_anti")


def hits_of_own(rows: DataFrame, keys: list[str], expires_at: str, now: Column) -> DataFrame:
    """``hits_and_misses`` where the cache's writes are among the entries themselves: each row with ``hit``, true where a row of its key has an ``expires_at`` (null: no
    write) after ``now``. The rows are made, exchanged and sorted once. A null in a key is no match."""
    live = F.max(F.coalesce(F.col(expires_at) > now, F.lit(False))).over(Window.partitionBy(*keys))
    for k in keys:
        live = live & F.col(k).isNotNull()
    return rows.withColumn("hit", live)


def partial_upsert(old: DataFrame, new: DataFrame, key: str, groups: dict[str, list[str]], expiry: dict[str, Column]) -> DataFrame:
    """Only the column groups that ``new`` supplies are refreshed, each with an expiry of its own
    (``<group>_expires_at``); the others keep value and clock. A group counts as supplied where its first column isn't null."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    out = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for group, columns in groups.items():
        given = F.col(f"n.{columns[0]}").isNotNull()
        out += [F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
        out.append(F.when(given, expiry[group]).otherwise(F.col(f"o.{group}_expires_at")).alias(f"{group}_expires_at"))
    return joined.select(*out)


def read_groups(rows: DataFrame, key: str, groups: dict[str, list[str]], now: Column) -> DataFrame:
    """Each group's columns while it lives; rows of which every group has expired are left out."""
    alive = {g: F.coalesce(F.col(f"{g}_expires_at") > now, F.lit(False)) for g in groups}
    some = F.lit(False)
    for a in alive.values():
        some = some | a
    return rows.where(some).select(key, *(F.when(alive[g], F.col(c)).alias(c) for g, columns in groups.items() for c in columns))


def cached_then_new(cached: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Both, as a bag, with ``position``: what the cache gave comes first, each part in its own order. ``position`` sorts without a global sort."""
    names = new.columns
    place = lambda df, n: df.select(*names, F.struct(F.lit(n).alias("part"), F.col(order).alias("at")).alias("position"))
    return place(cached, 0).unionByName(place(new, 1))


def placed(rows: DataFrame, hit: str, order: str) -> DataFrame:
    """``cached_then_new`` of rows that tell by ``hit`` to which part they belong: ``position`` is added to each."""
    return rows.withColumn("position", F.struct(F.when(F.col(hit), 0).otherwise(1).alias("part"), F.col(order).alias("at")))


def first_rows(rows: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first ``most`` rows by ``order``, all without a limit: a cap that a user asks for, such as on what is sent to a paid model."""
    return rows if most is None else rows.orderBy(order).limit(most)


def changed(fetched: DataFrame, tokens: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what is new, the tokens after this run) of fetched payloads and the change tokens of the last run: etag and last_modified by key.

    A payload is unchanged where it bears the etag that is stored, or, without one, the stored time of change. A payload with neither is always new and
    leaves the stored tokens as they are."""
    old = tokens.select(key, F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"))
    same = F.when(F.coalesce("etag", F.lit("")) != "", F.col("etag") == F.col("_etag")).otherwise((F.coalesce("last_modified", F.lit("")) != "") & (F.col("last_modified") == F.col("_modified")))
    fresh = fetched.join(old, key, "left").where(~F.coalesce(same, F.lit(False))).select(*fetched.columns)
    told = fetched.where((F.coalesce("etag", F.lit("")) != "") | (F.coalesce("last_modified", F.lit("")) != "")).select(key, "etag", "last_modified", F.lit(1).alias("_at"))
    return fresh, latest_per_key(tokens.select(key, "etag", "last_modified", F.lit(0).alias("_at")).unionByName(told), [key], "_at").drop("_at")


def answered(rows: DataFrame, key: str, results: dict[str, tuple[DataFrame, object]]) -> DataFrame:
    """``rows`` with the answer of each agent by ``key``: ``results`` names a column, the table that has it (one row per key), and what stands where an answer
    is missing or failed (null)."""
    for column, (table, default) in results.items():
        rows = rows.join(table.select(key, F.col(column)), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))
    return rows


def open_requests(work: DataFrame, key: str, caches: dict[str, DataFrame]) -> DataFrame:
    """(request_id, agent, key): for each agent the distinct keys of ``work`` that its cache (a table with the key) does not answer. The id is the same in every run."""
    found = None
    for agent, cache in caches.items():
        todo = work.select(key).distinct().join(cache.select(key).distinct(), key, "left_anti").select(F.lit(agent).alias("agent"), key)
        found = todo if found is None else found.unionByName(todo)
    return found.select(F.sha2(F.concat("agent", F.lit(":"), F.col(key).cast("string")), 256).alias("request_id"), "agent", key)


def run_of_token(tokens: DataFrame, history: DataFrame, run: Column) -> DataFrame:
    """(token, run_id): the run that a feedback token was made in; unknown tokens say so. Tokens of the history are unique."""
    known = history.select("token", run.alias("run_id"))
    return tokens.join(known, "token", "left").select("token", F.coalesce("run_id", F.lit("unknown")).alias("run_id"))


def signalled(history: DataFrame, signals: DataFrame) -> DataFrame:
    """The history after feedback: the row of a token takes its signal, and ``updated`` tells which did; tokens without a row are ignored."""
    once = signals.groupBy("token").agg(F.max("signal").alias("new_signal"))
    return history.join(once, "token", "left").withColumnRenamed("new_signal", "signal").withColumn("updated", F.col("signal").isNotNull())
