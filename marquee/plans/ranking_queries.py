"""Queries of ranking, recency, vibes, risk, selection and feedback. Each with its oracle in SQL where SQL has the means."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..catalog import FEEDBACK_NOW, FEEDBACK_SQL, HISTORY_SQL, LISTINGS_SQL, NOW, feedback, history, listings, now, table, with_id
from ..functions import categories, scoring, text, vocab
from ..operators import dedup, groups, keyed, select
from ..operators import feedback as folds
from ..storage import stage

QUERIES, ORACLES = {}, {}
_N, _F = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{FEEDBACK_NOW}'"
_DAYS = f"(epoch_us({_F}) - epoch_us(recommended_at)) / 86400e6"
_RATE = -math.log(1 - vocab.NOVELTY_RECOVERY) / 14


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _days(ts):
    return folds.age_days(ts, now(FEEDBACK_NOW))


_SHOWS_SQL = HISTORY_SQL.rstrip() + ", shows AS (SELECT event_key || '-' || CAST(token % 97 AS VARCHAR) AS show_key, recommended_at FROM history WHERE event_key IS NOT NULL)"


@query(_SHOWS_SQL + f" SELECT show_key, count(*) AS n FROM shows WHERE show_key NOT IN (SELECT show_key FROM shows WHERE recommended_at >= {_F} - INTERVAL 14 DAY) GROUP BY 1")
def hard_exclude(spark, sf_dir):
    """Shows that nobody was given within 14 days. An event has many shows, so that some of each are left."""
    h = history(spark, sf_dir).where("event_key is not null").select(F.concat("event_key", F.lit("-"), (F.col("token") % 97).cast("string")).alias("show_key"), "recommended_at")
    recent = h.where(F.col("recommended_at") >= now(FEEDBACK_NOW) - F.make_dt_interval(days=F.lit(vocab.HARD_RECENCY_DAYS))).select("show_key").distinct()
    return h.join(recent, "show_key", "left_anti").groupBy("show_key").agg(F.count("*").alias("n"))


@query(HISTORY_SQL + f"SELECT event_key, max(recommended_at) AS last_at FROM history WHERE recommended_at >= {_F} - INTERVAL 28 DAY AND event_key IS NOT NULL GROUP BY 1")
def recency_lookup(spark, sf_dir):
    """Latest recommendation per event within 28 days."""
    h = history(spark, sf_dir).where(F.col("recommended_at") >= now(FEEDBACK_NOW) - F.make_dt_interval(days=F.lit(vocab.SOFT_RECENCY_DAYS)))
    return h.where(F.col("event_key").isNotNull()).groupBy("event_key").agg(F.max("recommended_at").alias("last_at"))


@query(
    HISTORY_SQL + f", l AS (SELECT event_key, user_id, {_DAYS} AS days FROM history), f AS (SELECT *, CASE WHEN days >= 28 THEN 1.0 WHEN days <= 14 THEN 0.5 ELSE 0.5 + 0.5 * (1 - exp(-{_RATE!r} * (days - 14))) END AS factor FROM l) "
    "SELECT event_key, round(min(factor), 6) AS factor, round(min(CASE WHEN user_id % 2 = 0 THEN least(1.0, factor + 0.2) ELSE factor END), 6) AS novelty, bool_or(factor < 1) AS penalty, min(CASE WHEN days > 28 THEN 'none' WHEN days <= 14 THEN 'hard' ELSE 'soft' END) AS band FROM f GROUP BY 1"
)
def novelty(spark, sf_dir):
    """Recency factor, bonus for what is unseen, penalty flag and band."""
    known = F.array(F.lit("jazz"))
    cats = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("Jazz"), F.lit("Film"))).otherwise(F.array(F.lit(" JAZZ")))
    rows = history(spark, sf_dir).withColumn("days", _days(F.col("recommended_at")))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("factor", scoring.recency_factor(F.col("days"))).withColumn("novelty", scoring.novelty(F.col("days"), cats, known, none, none))
    return rows.groupBy("event_key").agg(F.round(F.min("factor"), 6).alias("factor"), F.round(F.min("novelty"), 6).alias("novelty"), F.bool_or(F.col("factor") < 1).alias("penalty"), F.min(scoring.recency_band(F.col("days"))).alias("band"))


_TAGS = [*vocab.VIBES, "unknown"]
_TAGS_SQL = "[" + ", ".join(f"'{t}'" for t in _TAGS) + "]"
_VIBES_SQL = f"""WITH raw AS (SELECT p_partkey, list_transform(range(1, CAST(p_size % 6 + 1 AS BIGINT)), lambda i: list_extract({_TAGS_SQL}, CAST((p_partkey * i + i) % 20 + 1 AS INTEGER))) AS tags FROM part),
valid AS (SELECT p_partkey, CASE WHEN len(tags) BETWEEN 2 AND 5 AND NOT list_contains(tags, 'unknown') AND len(list_distinct(tags)) >= 2 THEN list_sort(list_distinct(tags)) END AS tags FROM raw)
"""


def _vibes(spark, sf_dir):
    k, names = F.col("p_partkey"), F.array(*(F.lit(t) for t in _TAGS))
    n = (F.col("p_size") % 6).cast("int")
    raw = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.get(names, ((k * i + i) % 20).cast("int")))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(k, categories.validate_vibes(raw).alias("tags"))


@query(_VIBES_SQL + "SELECT p_partkey, array_to_string(tags, ',') AS tags FROM valid")
def vibe_validate(spark, sf_dir):
    return _vibes(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query(_VIBES_SQL + "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM valid) GROUP BY tag")
def vibe_distribution(spark, sf_dir):
    return _vibes(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(_VIBES_SQL + "SELECT p_partkey, round(CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN tags IS NOT NULL THEN 0.5 ELSE 0.0 END WHEN tags IS NULL THEN 0.0 ELSE len(list_intersect(tags, ['social', 'niche', 'outdoor'])) / 3.0 END, 6) AS fit FROM valid")
def vibe_fit(spark, sf_dir):
    preferred = F.when(F.col("p_partkey") % 7 != 0, F.array(F.lit("social"), F.lit("niche"), F.lit("outdoor"))).otherwise(F.array().cast("array<string>"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return _vibes(spark, sf_dir).select("p_partkey", F.round(scoring.vibe_fit(tags, preferred), 6).alias("fit"))


_W = r"[\p{L}\p{N}_]"
_SHORT = rf"[A-Z](?:{_W}|[''-])+(?:\s+[A-Z](?:{_W}|[''-])+)?"
_PERF = (
    rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:featuring|feat\.?|starring|presents|presented by)\s+({_SHORT})",
    rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])with special guest\s+({_SHORT})",
    rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])DJ\s+([A-Z](?:{_W}|[''-])+)",
)
_BLURB = "CASE c_custkey % 4 WHEN 0 THEN 'Live: featuring ' || c_name || ' and DJ Zoë' WHEN 1 THEN 'An evening with special guest Beyoncé Knowles-' || c_mktsegment WHEN 2 THEN 'DJ Zoë, presents ' || c_name || '! DJ zoë again' ELSE 'nothing here' END"


@query(
    f"WITH t AS (SELECT c_custkey, c_mktsegment || chr(10) || {_BLURB} AS s FROM customer), found AS (SELECT c_custkey, "
    + " || ".join(f"regexp_extract_all(s, '{p}', 1)" for p in _PERF)
    + " AS names FROM t), each AS (SELECT c_custkey, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM found), firsts AS (SELECT c_custkey, lower(name) AS k, arg_min(name, pos) AS name, min(pos) AS pos FROM each GROUP BY 1, 2) "
    "SELECT c.c_custkey, coalesce(string_agg(name, '|' ORDER BY pos), '') AS names FROM customer c LEFT JOIN firsts f USING (c_custkey) GROUP BY 1"
)
def performer_extract(spark, sf_dir):
    """Performer names of a text, accents included."""
    k, name = F.col("c_custkey"), F.col("c_name")
    blurb = F.when(k % 4 == 0, F.concat(F.lit("Live: featuring "), name, F.lit(" and DJ Zoë"))).when(k % 4 == 1, F.concat(F.lit("An evening with special guest Beyoncé Knowles-"), "c_mktsegment")).when(k % 4 == 2, F.concat(F.lit("DJ Zoë, presents "), name, F.lit("! DJ zoë again"))).otherwise("nothing here")
    return table(spark, sf_dir, "customer").select(k, F.array_join(text.performer_names(F.col("c_mktsegment"), blurb), "|").alias("names"))


@query("SELECT o_orderkey, round(coalesce(max(CASE WHEN l_discount * 10 > 1 THEN 1.0 ELSE l_discount * 10 END), 0), 6) AS affinity, count(*) FILTER (l_tax < 0.07 AND l_linenumber IS NOT NULL) AS without_summary FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def performer_affinity(spark, sf_dir):
    """Greatest affinity of an event's performers, 0 without any; summaries go below confidence 0.7."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.least(F.lit(1.0), F.col("l_discount") * 10)).alias("a"), F.count_if(F.col("l_tax") < 0.07).alias("n"))
    return table(spark, sf_dir, "orders").select("o_orderkey").distinct().join(per, "o_orderkey", "left").select("o_orderkey", F.round(F.coalesce("a", F.lit(0.0)), 6).alias("affinity"), F.coalesce("n", F.lit(0)).alias("without_summary"))


_PROFILE_WEIGHTS = (("jaz", 0.9), ("film", 0.4), ("Music", 0.7))


def _weights():
    return F.array(*(F.struct(F.lit(k).alias("key"), F.lit(w).alias("weight")) for k, w in _PROFILE_WEIGHTS))


@query(
    """SELECT p_partkey, round(CASE p_partkey % 4 WHEN 3 THEN 0.0 WHEN 0 THEN 0.9 WHEN 1 THEN (0.4 + 0.7) / 2 ELSE 0.0 END, 6) AS by_weight,
  round(CASE p_partkey % 4 WHEN 3 THEN 0.0 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END, 6) AS by_interest, CASE WHEN p_partkey % 4 = 3 THEN 0.0 ELSE 0.5 END AS neutral FROM part"""
)
def category_fit(spark, sf_dir):
    """First matching key counts, in the profile's order; interests and the neutral value stand in."""
    k = F.col("p_partkey")
    cats = F.when(k % 4 == 0, F.array(F.lit("Jazz"), F.lit("Sports"))).when(k % 4 == 1, F.array(F.lit(" FILM "), F.lit("music"))).when(k % 4 == 2, F.array(F.lit("Dance"))).otherwise(F.array().cast("array<string>"))
    no_weights, none = F.array().cast("array<struct<key:string,weight:double>>"), F.array().cast("array<string>")
    interests = F.array(F.lit("jazz"), F.lit("sport"), F.lit("films"))
    rows = table(spark, sf_dir, "part")
    return rows.select(k, F.round(scoring.category_fit(cats, _weights(), none), 6).alias("by_weight"), F.round(scoring.category_fit(cats, no_weights, interests), 6).alias("by_interest"), scoring.category_fit(cats, no_weights, none).alias("neutral"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0.5 WHEN n = '' THEN 0.0 WHEN contains(n, 'nation_1') OR contains('nation_1', n) OR contains(n, 'old town') THEN 1.0 ELSE 0.0 END AS fit FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE lower(trim(n_name)) END AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def location_fit(spark, sf_dir):
    """Neighbourhood against preferred ones, by containment either way."""
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    n = F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("n_name"))
    preferred = F.when(F.col("s_suppkey") % 5 != 0, F.array(F.lit("Nation_1"), F.lit("Old Town "))).otherwise(F.array().cast("array<string>"))
    return rows.select("s_suppkey", scoring.location_fit(n, preferred).alias("fit"))


@query("SELECT l_orderkey, round(least(1.0, count(DISTINCT l_suppkey % 7) / 3.0), 6) AS coverage FROM lineitem GROUP BY 1")
def source_coverage(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(scoring.source_coverage(F.count_distinct(F.col("l_suppkey") % 7)), 6).alias("coverage"))


@query(
    "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), liked AS (SELECT v FROM e WHERE label = 0) "
    "SELECT c.vec_id, round(coalesce(max(list_cosine_similarity(c.v, l.v)), 0), 6) AS similarity FROM e c LEFT JOIN liked l ON true WHERE c.label <> 0 GROUP BY 1"
)
def semantic_similarity(spark, sf_dir):
    """Greatest cosine of each candidate with all events that a user liked, which meet every candidate in blocks, in double precision."""
    from ..operators.similarity import max_cosine

    e = table(spark, sf_dir, "embeddings")
    liked = e.where("label = 0").select("embedding")
    return max_cosine(e.where("label <> 0"), liked, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


_RANK_SQL = LISTINGS_SQL.rstrip() + f""", ids AS (SELECT *, sha256(title || CAST(event_date AS VARCHAR) || venue) AS event_id FROM listings WHERE start BETWEEN {_N} AND {_N} + INTERVAL 14 DAY),
best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY source_quality DESC, feed DESC, ord) AS rn, count(*) OVER (PARTITION BY event_id) AS members FROM ids),
cover AS (SELECT event_id, count(DISTINCT feed) AS source_count FROM ids GROUP BY 1),
events_ AS (SELECT b.*, c.source_count, CASE WHEN b.is_free OR b.price_cents IS NOT NULL THEN 1.0 ELSE 0.0 END AS clarity FROM best b JOIN cover c USING (event_id) WHERE rn = 1),
users AS (SELECT c_custkey AS user_id, n_name AS home, c_custkey % 10 / 10.0 AS wj, (c_custkey % 7) / 7.0 AS wm FROM customer JOIN nation ON c_nationkey = n_nationkey),
tagged AS (SELECT *, CAST(right(venue, 1) AS INTEGER) AS v, CASE category WHEN 'Jazz' THEN ['niche', 'social'] WHEN 'Music' THEN ['social', 'outdoor'] ELSE [] END AS tags FROM events_),
pairs AS (SELECT *, CASE WHEN (u.user_id + e.v) % 5 = 0 THEN 15.0 + e.v WHEN (u.user_id + e.v) % 5 = 1 THEN 40.0 END AS days, CASE WHEN u.user_id % 4 = 0 THEN [] ELSE ['niche', 'social', 'outdoor'] END AS liked_tags FROM tagged e JOIN users u ON u.home = e.city),
recent AS (SELECT *, CASE WHEN days IS NULL OR days >= 28 THEN 1.0 WHEN days <= 14 THEN 0.5 ELSE 0.5 + 0.5 * (1 - exp(-{_RATE!r} * (days - 14))) END AS factor FROM pairs),
parts AS (SELECT user_id, event_id, ord, title, venue, category, event_date, start, price_cents, is_free,
  CASE WHEN category = 'Jazz' THEN wj WHEN category = 'Music' THEN wm ELSE 0.0 END AS category_fit, CASE WHEN user_id % 3 = 0 THEN 0.5 WHEN contains(lower(venue), 'venue ' || CAST(user_id % 10 AS VARCHAR)) THEN 1.0 ELSE 0.0 END AS location,
  CASE WHEN len(liked_tags) = 0 THEN CASE WHEN len(tags) > 0 THEN 0.5 ELSE 0.0 END ELSE len(list_intersect(tags, liked_tags)) / 3.0 END AS vibe_fit,
  ((user_id * 3 + v) % 11) / 10.0 AS semantic_similarity, CASE WHEN right(title, 1) = '!' THEN 0.75 ELSE 0.25 END AS performer_affinity,
  CASE WHEN len(list_filter(tags, lambda t: NOT list_contains(liked_tags, t))) > 0 THEN least(1.0, factor + 0.2) ELSE factor END AS novelty,
  source_quality, least(1.0, source_count / 3.0) AS source_coverage, round(0.2 * 0.3 + 0.2 + 0.2 + 0.1 + 0.1 + 0.05 * clarity, 4) AS description_quality FROM recent),
scored AS (SELECT *, 0.20 * category_fit + 0.15 * vibe_fit + 0.10 * semantic_similarity + 0.10 * performer_affinity + 0.10 * location + 0.10 * novelty + 0.05 * source_quality + 0.05 * source_coverage + 0.15 * description_quality AS raw FROM parts),
ranked AS (SELECT *, round(raw, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(raw, 6) DESC, ord) AS rank FROM scored)
"""


def _users_and_events(spark, sf_dir):
    """Users, and the listings of the coming fortnight, merged. The horizon is applied first, so it reaches the scan; the merge is one aggregation."""
    inside = F.col("start").between(now(), now() + F.make_dt_interval(days=F.lit(vocab.HORIZON_DAYS)))
    rows = with_id(listings(spark, sf_dir).where(inside)).select("event_id", "ord", "title", "venue", "city", "category", "event_date", "start", "feed", "source_quality", "price_cents", "is_free", "link")
    events = dedup.merge(rows)
    signals = scoring.quality_signals(F.col("title"), F.col("title"), F.col("venue"), F.col("start") + F.make_dt_interval(secs=F.lit(1)), F.lit(None), F.array("category"), F.col("link"), F.col("price_cents"), F.col("is_free"))
    events = events.withColumn("description_quality", scoring.quality(signals)).withColumn("categories", F.array("category"))
    # labels are normalised here, once per event and user, not once per pair
    events = events.withColumn("category_keys", scoring.labels(F.col("categories"))).withColumn("venue_label", scoring.label(F.col("venue")))
    nation = table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    users = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(  # 25 nations
        k.alias("user_id"),
        F.col("n_name").alias("city"),
        F.array(F.struct(F.lit("jazz").alias("key"), (k % 10 / 10.0).alias("weight")), F.struct(F.lit("music").alias("key"), ((k % 7) / 7.0).alias("weight")), F.struct(F.lit("film").alias("key"), F.lit(0.0).alias("weight"))).alias("weights"),
        F.when(k % 3 != 0, F.array(F.concat(F.lit("venue "), (k % 10).cast("string")))).otherwise(F.array().cast("array<string>")).alias("areas"),
    )
    none = F.array().cast("array<string>")
    tags = F.when(F.col("category") == "Jazz", F.array(F.lit("niche"), F.lit("social"))).when(F.col("category") == "Music", F.array(F.lit("social"), F.lit("outdoor"))).otherwise(none)
    events = events.withColumn("tags", tags).withColumn("v", F.right("venue", F.lit(1)).cast("int"))
    users = users.withColumn("liked_tags", F.when(F.col("user_id") % 4 == 0, none).otherwise(F.array(F.lit("niche"), F.lit("social"), F.lit("outdoor"))))
    users = users.withColumn("known", F.transform("weights", lambda w: w["key"]))
    return users, events


#: what of an event a user's own parts of the score depend on
_BLOCK = ["category_keys", "tags", "venue_label", "v"]


def _user_parts() -> dict:
    u, v, none = F.col("user_id"), F.col("v"), F.array().cast("array<string>")
    days = F.when((u + v) % 5 == 0, 15.0 + v).when((u + v) % 5 == 1, 40.0)
    return {
        "category_fit": scoring.category_fit(F.col("category_keys"), F.col("weights"), none, plain=True),
        "vibe_fit": scoring.vibe_fit(F.col("tags"), F.col("liked_tags")),
        "semantic_similarity": (u * 3 + v) % 11 / 10.0,
        "location": scoring.location_fit(F.col("venue_label"), F.col("areas"), plain=True),
        "novelty": scoring.novelty(days, F.col("category_keys"), F.col("known"), F.col("tags"), F.col("liked_tags"), plain=True),
    }


def _event_parts() -> dict:
    return {
        "performer_affinity": F.when(F.col("title").endswith("!"), 0.75).otherwise(0.25),
        "source_quality": scoring.clamp(F.col("source_quality")),
        "source_coverage": scoring.source_coverage(F.col("source_count")),
        "description_quality": scoring.clamp(F.col("description_quality")),
    }


#: how pairs are dealt to tasks; a user has one value of each
_DEALT = ("city", "_part")


def scored_events(spark, sf_dir):
    """Every user with every event of their city, scored; they meet by an equi-join on the city, and stay dealt by ``_DEALT``."""
    users, events = _users_and_events(spark, sf_dir)
    return _scored(groups.spread_join(events, users, ["city"], "user_id"))


def _scored(pairs):
    all_parts = _user_parts() | _event_parts()
    parts = {n: all_parts[n] for n in vocab.RANK_WEIGHTS}
    kept = (*_DEALT, "user_id", "event_id", "ord", "title", "venue", "categories", "event_date", "start", "price_cents", "is_free")
    named = pairs.select(*kept, *(c.alias(f"p_{n}") for n, c in parts.items()))
    score = F.round(scoring.rank_score({n: F.col(f"p_{n}") for n in parts}), 6)
    return named.withColumn("score", score).withColumn("novelty", F.col("p_novelty"))


@query(_RANK_SQL + "SELECT user_id, event_id, round(category_fit, 6) AS category_fit, round(vibe_fit, 6) AS vibe_fit, semantic_similarity, performer_affinity, location, round(novelty, 6) AS novelty, source_quality, round(source_coverage, 6) AS source_coverage, description_quality, score FROM ranked")
def rank_composite(spark, sf_dir):
    """Nine-part score of every user and event of their city."""
    s = scored_events(spark, sf_dir)
    plain = [F.col(f"p_{c}").alias(c) for c in ("semantic_similarity", "performer_affinity", "location", "source_quality")]
    return s.select("user_id", "event_id", F.round("p_category_fit", 6).alias("category_fit"), F.round("p_vibe_fit", 6).alias("vibe_fit"), *plain, F.round("novelty", 6).alias("novelty"), F.round("p_source_coverage", 6).alias("source_coverage"), F.col("p_description_quality").alias("description_quality"), "score")


@query(_RANK_SQL + "SELECT user_id, rank, event_id, title, score FROM ranked WHERE rank <= 10")
def rank_topk_per_user(spark, sf_dir):
    """The ten best events of each user."""
    return select.top_k(scored_events(spark, sf_dir), 10, within=_DEALT).select("user_id", "rank", "event_id", "title", "score")


@query(_RANK_SQL + "SELECT user_id, rank, event_id, title, score FROM ranked WHERE rank <= 10")
def rank_topk_bounded(spark, sf_dir):
    """The same ten, without scoring all pairs: bounds by blocks of events that are alike to a user."""
    users, events = _users_and_events(spark, sf_dir)
    events = stage(events, "events")  # read for the blocks and for the pairs
    own, static = (scoring.weighted(parts, {n: vocab.RANK_WEIGHTS[n] for n in parts}) for parts in (_user_parts(), _event_parts()))
    best = select.top_k_bounded(users, events, 10, on="city", block=_BLOCK, own=own, static=static, score=_scored)
    return best.select("user_id", "rank", "event_id", "title", "score")


@query(_RANK_SQL + ", w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY novelty DESC, rank) AS wr FROM ranked WHERE score BETWEEN 0.35 AND 0.65 AND novelty >= 0.6) SELECT user_id, rank, event_id FROM w WHERE wr <= 2")
def wildcard_slots(spark, sf_dir):
    rows = select.ranked(scored_events(spark, sf_dir), within=_DEALT)
    return rows.withColumn("wildcard", select.wildcards(rows, within=_DEALT)).where("wildcard").select("user_id", "rank", "event_id")


#: the greedy choice, a pick for each round of the recursion: the first row after the last pick that has room. With three categories no list
#: is full, so a wildcard that there is stands in it from the first pick on, and nothing makes way for one
_CURATE_SQL = _RANK_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, w AS (SELECT *, score BETWEEN 0.35 AND 0.65 AND novelty >= 0.6 AS fit, row_number() OVER (PARTITION BY user_id, score BETWEEN 0.35 AND 0.65 AND novelty >= 0.6 ORDER BY novelty DESC, rank) AS wr FROM ranked),
pool AS (SELECT user_id, rank, event_id, score, lower(category) AS c, lower(venue) AS v, event_date AS d, fit AND wr <= 2 AS wild FROM w),
queue AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first DESC, CASE WHEN first THEN -score END, rank) AS pos FROM (SELECT *, false AS first FROM pool UNION ALL SELECT *, true FROM pool WHERE wild)),
greedy AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS cats, CAST([] AS VARCHAR[]) AS venues FROM pool
  UNION ALL SELECT user_id, r.pos, list_append(ids, r.event_id), list_append(cats, r.c), list_append(venues, r.v)
  FROM (SELECT g.user_id, g.ids, g.cats, g.venues, arg_min({'pos': q.pos, 'event_id': q.event_id, 'c': q.c, 'v': q.v}, q.pos) AS r FROM greedy g JOIN queue q ON q.user_id = g.user_id AND q.pos > g.pos
    WHERE len(g.ids) < 10 AND NOT list_contains(g.ids, q.event_id) AND len(list_filter(g.cats, lambda x: x = q.c)) < 3 AND len(list_filter(g.venues, lambda x: x = q.v)) < 2 GROUP BY ALL)),
lists AS (SELECT user_id, arg_max(ids, len(ids)) AS ids FROM greedy GROUP BY 1),
picks AS (SELECT p.*, list_position(ids, p.event_id) AS n FROM lists l JOIN pool p ON p.user_id = l.user_id AND list_contains(ids, p.event_id)),
one_day AS (SELECT user_id, min(d) AS d FROM picks GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT d) < 2),
swaps AS (SELECT o.user_id, arg_min({'leaves': o.event_id, 'comes': q.event_id}, (o.score, o.n, -q.score, q.rank)) AS s
  FROM one_day y JOIN picks o ON o.user_id = y.user_id AND NOT o.wild JOIN pool q ON q.user_id = y.user_id AND NOT q.wild AND q.d <> y.d
  WHERE (SELECT count(*) FROM picks k WHERE k.user_id = o.user_id AND k.event_id <> o.event_id AND k.c = q.c) < 3 AND (SELECT count(*) FROM picks k WHERE k.user_id = o.user_id AND k.event_id <> o.event_id AND k.v = q.v) < 2 GROUP BY 1),
final AS (SELECT p.user_id, p.event_id, p.score, p.wild, p.n FROM picks p LEFT JOIN swaps ON swaps.user_id = p.user_id WHERE s IS NULL OR s.leaves <> p.event_id
  UNION ALL SELECT p.user_id, p.event_id, p.score, p.wild, 99 FROM swaps JOIN pool p ON p.user_id = swaps.user_id AND p.event_id = s.comes)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, n) AS INTEGER) AS position, event_id, round(score, 6) AS score, wild AS wildcard FROM final"""


@query(_CURATE_SQL)
def curate_greedy(spark, sf_dir):
    """Each user's list under the caps on categories, venues, dates and wildcards."""
    rows = select.ranked(scored_events(spark, sf_dir), within=_DEALT)
    rows = rows.withColumn("wildcard", select.wildcards(rows, within=_DEALT)).withColumn("venue", text.venue_group_key(F.col("venue")))
    return select.curate(rows, within=_DEALT).withColumn("score", F.round("score", 6))


_URGENT = ["plenty of seating", "Almost sold out - last chance", "no cover, selling fast", "walk-up welcome, no cover", ""]
_HALLS = ["Rose Bowl", "Blue  Club", "City Hall", "The Spot", "Arena House"]


def _in_sql(column: str, phrases) -> str:
    return " + ".join(f"CAST(contains({column}, '{p}') AS INTEGER)" for p in phrases)


def _or_sql(column: str, phrases) -> str:
    return " OR ".join(f"contains({column}, '{p}')" for p in phrases)


_RISK_SQL = (
    f"WITH b AS (SELECT o_orderkey, o_orderdate, list_extract({_HALLS}, CAST(o_orderkey % 5 + 1 AS INTEGER)) AS venue, list_extract({_URGENT}, CAST(o_custkey % 5 + 1 AS INTEGER)) AS d, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_totalprice AS INTEGER) % 9000 END AS cents, o_orderkey % 11 = 0 AS free, (o_custkey % 100) / 100.0 AS aff FROM orders), "
    f"n AS (SELECT *, lower(regexp_replace(venue, '\\s+', ' ', 'g')) AS v, lower(d) AS t, (epoch_us(o_orderdate) - epoch_us({_N})) / 86400e6 AS days FROM b), "
    f"h AS (SELECT *, {_in_sql('t', vocab.HIGH_URGENCY)} AS hi, {_in_sql('t', vocab.LOW_URGENCY)} AS lo, CASE WHEN {_or_sql('v', vocab.LARGE_VENUES)} THEN 'large' WHEN {_or_sql('v', vocab.SMALL_VENUES)} THEN 'small' WHEN {_or_sql('v', vocab.MEDIUM_VENUES)} THEN 'medium' ELSE 'unknown' END AS size FROM n), "
    "s AS (SELECT o_orderkey, size, round(0.25 * CASE size WHEN 'large' THEN 0.25 WHEN 'small' THEN 0.9 WHEN 'medium' THEN 0.55 ELSE 0.5 END + 0.15 * CASE WHEN free OR cents <= 0 THEN 0.85 WHEN cents IS NULL THEN 0.5 WHEN cents < 2000 THEN 0.75 WHEN cents < 6000 THEN 0.55 ELSE 0.35 END "
    "+ 0.25 * CASE WHEN days < 0 THEN 0.2 WHEN days <= 2 THEN 0.95 WHEN days <= 7 THEN 0.75 WHEN days <= 14 THEN 0.55 WHEN days <= 30 THEN 0.4 ELSE 0.25 END + 0.2 * CASE WHEN hi = 0 AND lo = 0 THEN 0.5 WHEN hi >= lo THEN least(1.0, 0.55 + 0.15 * hi) ELSE greatest(0.0, 0.45 - 0.1 * lo) END + 0.15 * aff, 6) AS score FROM h), "
    "r AS (SELECT *, CASE WHEN score >= 0.62 THEN 'high' WHEN score >= 0.38 THEN 'medium' ELSE 'low' END AS band FROM s) "
)


def _risk(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, i: F.get(F.array(*(F.lit(x) for x in names)), i.cast("int"))
    cents = F.when(k % 4 != 0, F.rint("o_totalprice").cast("int") % 9000)
    parts = scoring.risk_parts(pick(_HALLS, k % 5), cents, k % 11 == 0, F.col("o_orderdate"), pick(_URGENT, c % 5), c % 100 / 100.0, now())
    score = F.round(scoring.risk_score(parts), 6)
    return o.select(k, scoring.venue_size(pick(_HALLS, k % 5)).alias("size"), score.alias("score")).withColumn("band", scoring.risk_band(F.col("score")))


@query(_RISK_SQL + f"SELECT o_orderkey, size, score, band, CASE WHEN band = 'high' THEN '{vocab.URGENCY_NOTE}' END AS note FROM r")
def sellout_risk(spark, sf_dir):
    return _risk(spark, sf_dir).withColumn("note", F.when(F.col("band") == "high", vocab.URGENCY_NOTE))


@query(_RISK_SQL + "SELECT b.band, count(r.band) AS n FROM (VALUES ('low'), ('medium'), ('high')) b(band) LEFT JOIN r ON r.band = b.band GROUP BY 1")
def risk_distribution(spark, sf_dir):
    counts = _risk(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n"))
    return spark.createDataFrame([("low",), ("medium",), ("high",)], "band string").join(counts, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


_AGE = f"greatest(0, (epoch_us({_F}) - epoch_us(ts)) / 86400e6)"
_DECAY = f"exp(-{math.log(2) / 30!r} * {_AGE})"


@query(FEEDBACK_SQL + f"SELECT event_id, round({_DECAY}, 6) AS decay FROM feedback")
def feedback_decay(spark, sf_dir):
    return feedback(spark, sf_dir).select("event_id", F.round(scoring.feedback_decay(_days(F.col("ts"))), 6).alias("decay"))


@query(
    FEEDBACK_SQL.rstrip() + f""", d AS (SELECT user_id, category_no, list(CAST(CASE WHEN signal = 'click' THEN 0.03 ELSE -0.05 END * {_DECAY} AS DOUBLE) ORDER BY ts, event_id) AS deltas FROM feedback GROUP BY 1, 2)
SELECT user_id, category_no, round(list_reduce(list_prepend(CAST(0.5 AS DOUBLE), deltas), lambda a, x: greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), a + x))), 6) AS weight, CAST(len(deltas) AS BIGINT) AS n_signals FROM d"""
)
def feedback_fold(spark, sf_dir):
    """Category weights after all signals, clamped at each step."""
    return folds.fold_weights(feedback(spark, sf_dir), ["user_id", "category_no"], now(FEEDBACK_NOW)).withColumn("weight", F.round("weight", 6))


@query(
    FEEDBACK_SQL.rstrip() + f", e AS (SELECT user_id, ts, event_id, signal, list_extract({_TAGS_SQL}, CAST(category_no % 20 + 1 AS INTEGER)) AS tag FROM feedback WHERE {_DECAY} >= 0.5), l AS (SELECT user_id, tag, arg_max(signal, (ts, event_id)) AS signal FROM e WHERE tag <> 'unknown' GROUP BY 1, 2) SELECT user_id, string_agg(tag, ',' ORDER BY tag) AS vibes FROM l WHERE signal = 'click' GROUP BY 1"
)
def vibe_fold(spark, sf_dir):
    """Vibe preferences after adds and removals."""
    rows = feedback(spark, sf_dir).withColumn("vibe_tags", F.array(F.get(F.array(*(F.lit(t) for t in _TAGS)), (F.col("category_no") % 20).cast("int"))))
    return folds.fold_vibes(rows, "user_id", now(FEEDBACK_NOW)).select("user_id", F.array_join("vibes", ",").alias("vibes"))


@query(HISTORY_SQL + f"SELECT token, event_key, recommended_at FROM history WHERE recommended_at >= {_F} - INTERVAL 7 DAY")
def history_recent(spark, sf_dir):
    """The last seven days, newest first."""
    h = history(spark, sf_dir).where(F.col("recommended_at") >= now(FEEDBACK_NOW) - F.make_dt_interval(days=F.lit(7)))
    return h.select("token", "event_key", "recommended_at").orderBy(F.desc("recommended_at"))


@query(
    HISTORY_SQL.rstrip() + ", signals AS (SELECT event_id - 1 AS token, CASE WHEN event_type = 'click' THEN 'click' ELSE 'negative' END AS signal FROM events WHERE event_type IN ('click', 'error')) "
    "SELECT h.token, h.event_key, s.signal, s.token IS NOT NULL AS updated FROM history h LEFT JOIN signals s USING (token)"
)
def history_update(spark, sf_dir):
    """Feedback written to the history row of its token; other rows stay."""
    signals = feedback(spark, sf_dir).select((F.col("event_id") - 1).alias("token"), "signal")
    return keyed.signalled(history(spark, sf_dir), signals).select("token", "event_key", "signal", "updated")


@query(HISTORY_SQL.rstrip() + ", s AS (SELECT event_id - 1 AS token, event_type FROM events WHERE event_type = 'click') SELECT s.token, coalesce('run_' || h.event_key, 'unknown') AS run_id FROM s LEFT JOIN history h USING (token)")
def token_lookup(spark, sf_dir):
    """The run of a feedback token; unknown tokens say so."""
    clicks = feedback(spark, sf_dir).where("signal = 'click'").select((F.col("event_id") - 1).alias("token"))
    return keyed.run_of_token(clicks, history(spark, sf_dir), F.concat(F.lit("run_"), "event_key"))


@query(
    """WITH cat AS (SELECT n_nationkey AS feed FROM nation), summary AS (SELECT user_id % 30 AS feed, count(*) AS entries FROM events WHERE event_type = 'view' GROUP BY 1),
logs AS (SELECT user_id % 30 AS feed, arg_max(event_type, (ts, event_id)) AS last_status, max(ts) AS last_at FROM events GROUP BY 1), etags AS (SELECT user_id % 30 AS feed, max(event_id) AS etag FROM events WHERE event_type = 'signup' AND user_id % 30 < 20 GROUP BY 1)
SELECT c.feed, coalesce(s.entries, 0) AS entries, coalesce(l.last_status, 'never') AS status, l.last_at, coalesce(CAST(e.etag AS VARCHAR), '') AS etag FROM cat c LEFT JOIN summary s USING (feed) LEFT JOIN logs l USING (feed) LEFT JOIN etags e USING (feed)"""
)
def feed_dashboard(spark, sf_dir):
    """Catalog, summary, last log line and change token of each feed."""
    e = table(spark, sf_dir, "events").withColumn("feed", (F.col("user_id") % 30).cast("int"))
    summary = e.where("event_type = 'view'").groupBy("feed").agg(F.count("*").alias("entries"))
    logs = e.groupBy("feed").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"), F.max("ts").alias("last_at"))
    etags = e.where("event_type = 'signup' and feed < 20").groupBy("feed").agg(F.max("event_id").alias("etag"))
    cat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("feed"))
    joined = cat.join(summary, "feed", "left").join(logs, "feed", "left").join(etags, "feed", "left")
    return joined.select("feed", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("last_status", F.lit("never")).alias("status"), "last_at", F.coalesce(F.col("etag").cast("string"), F.lit("")).alias("etag"))


@query(
    LISTINGS_SQL.rstrip() + f", f AS (SELECT count(*) AS raw, count(*) FILTER (start BETWEEN {_N} AND {_N} + INTERVAL 14 DAY) AS in_window, count(*) FILTER (start BETWEEN {_N} AND {_N} + INTERVAL 14 DAY AND source_quality >= 0.15) AS kept FROM listings) SELECT raw, in_window, kept, round(100.0 * in_window / raw, 1) AS date_yield_pct FROM f"
)
def funnel(spark, sf_dir):
    """One row: how many listings pass each step."""
    inside = F.col("start").between(now(), now() + F.make_dt_interval(days=F.lit(14)))
    f = listings(spark, sf_dir).agg(F.count("*").alias("raw"), F.count_if(inside).alias("in_window"), F.count_if(inside & (F.col("source_quality") >= 0.15)).alias("kept"))
    return f.withColumn("date_yield_pct", F.round(F.col("in_window") * 100.0 / F.col("raw"), 1))


@query("SELECT user_id % 40 AS run, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, run DESC LIMIT 10")
def run_log_counts(spark, sf_dir):
    """Log lines per run, the ten longest."""
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("run")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("run")).limit(10)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d-%H%M%S') AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Free' ELSE printf('$%.2f', CAST(o_totalprice * 100 AS BIGINT) / 100.0) END AS price FROM orders")
def display_format(spark, sf_dir):
    """Run ids and price labels."""
    free = F.col("o_orderkey") % 2 == 0
    return table(spark, sf_dir, "orders").select("o_orderkey", text.run_id(F.col("o_orderdate")).alias("run_id"), text.price_label(free, F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("price"))


@query(
    "SELECT c_custkey, sha256(lower(trim(c_name || '@X.example '))) AS user_id, sha256('about ' || c_name || '[\"' || array_to_string(list_sort(['Jazz', c_mktsegment]), '\",\"') || '\"]') AS vibe_hash FROM customer"
)
def user_and_vibe_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", text.user_id(F.concat("c_name", F.lit("@X.example "))).alias("user_id"), text.vibe_hash(F.concat(F.lit("about "), "c_name"), F.array(F.lit("Jazz"), F.col("c_mktsegment"))).alias("vibe_hash"))


@query(
    "WITH w AS (SELECT sha256('talent:' || CAST(p_partkey AS VARCHAR)) AS request_id, 'talent' AS agent, p_partkey FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT sha256('vibe:' || CAST(p_partkey AS VARCHAR)), 'vibe', p_partkey FROM part WHERE p_size % 5 <> 0) SELECT * FROM w"
)
def enrichment_requests(spark, sf_dir):
    """Work that no cache answers, per agent, with a stable id."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return keyed.open_requests(part, "p_partkey", {agent: part.where(F.col("p_size") % n == 0) for agent, n in (("talent", 3), ("vibe", 5))})


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'fallback' ELSE upper(p_type) END AS genre, CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE p_size / 50.0 END AS affinity FROM part")
def batch_results_join(spark, sf_dir):
    """Answers joined by id; missing or failed ones leave the defaults."""
    part = table(spark, sf_dir, "part")
    genres = part.where(F.col("p_size") % 3 != 0).select("p_partkey", F.upper("p_type").alias("genre"))
    affinity = part.where(F.col("p_size") % 4 != 0).select("p_partkey", (F.col("p_size") / 50.0).alias("affinity"))
    return keyed.answered(part.select("p_partkey"), "p_partkey", {"genre": (genres, "fallback"), "affinity": (affinity, 0.0)})


@query(HISTORY_SQL + f"SELECT event_key, count(*) AS n_users FROM (SELECT DISTINCT event_key, user_id FROM history WHERE recommended_at >= {_F} - INTERVAL 28 DAY) GROUP BY 1")
def soft_recency_state(spark, sf_dir):
    """Users per event inside the soft window: the state a stream joins against."""
    h = history(spark, sf_dir).where(F.col("recommended_at") >= now(FEEDBACK_NOW) - F.make_dt_interval(days=F.lit(28)))
    return h.groupBy("event_key").agg(F.count_distinct("user_id").alias("n_users"))


