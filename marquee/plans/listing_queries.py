"""Queries over listings: hashes, routing, normalisation, duplicates, quality, filters. Each with its oracle in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import LISTINGS_SQL, NOW, feeds, listings, now, table, with_id
from ..functions import categories, scoring, text, vocab
from ..operators import dedup, keyed
from ..sources import catalog_file

QUERIES, ORACLES = {}, {}
_FEEDS_SQL = """feeds AS (
  SELECT 'feed_' || CAST(i AS VARCHAR) AS feed, CAST((i + 1) / 10.0 AS DOUBLE) AS quality, i < 2 AS is_national,
         CASE i % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'ical' WHEN 2 THEN 'api' ELSE 'scrape' END AS source_type, i <> 5 AS active, i = 3 AS structured_ingest
  FROM range(7) t(i)
)"""
_IDS_SQL = LISTINGS_SQL.rstrip() + ", ids AS (SELECT *, sha256(title || CAST(event_date AS VARCHAR) || venue) AS event_id FROM listings)\n"
_N = f"TIMESTAMP '{NOW}'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT s_suppkey, 'CITY_' || CAST(s_nationkey AS VARCHAR) AS city, s_suppkey % 10 = 0 AS is_national FROM supplier WHERE s_acctbal >= 0 AND (s_suppkey % 10 = 0 OR s_nationkey = 3)")
def feed_city_filter(spark, sf_dir):
    """Active feeds of the user's city, and the national ones; the catalog is made of the suppliers."""
    k = F.col("s_suppkey")
    catalog = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(k, F.concat(F.lit("CITY_"), F.col("s_nationkey").cast("string")).alias("city"), (k % 10 == 0).alias("is_national"))
    return catalog_file.for_city(catalog, " CITY_3 ")


@query(
    """WITH e AS (SELECT user_id % 7 AS feed_no, event_type, CASE event_type WHEN 'signup' THEN 'OK' WHEN 'view' THEN 'UNCHANGED' WHEN 'error' THEN 'UNREACHABLE' WHEN 'click' THEN 'STALE' ELSE 'EMPTY' END AS status FROM events)
SELECT feed_no, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'UNCHANGED') AS unchanged, count(*) FILTER (status NOT IN ('OK', 'UNCHANGED')) AS failed, count(*) AS total, bool_and(status IN ('OK', 'UNCHANGED')) AS all_ok FROM e GROUP BY feed_no"""
)
def feed_health_summary(spark, sf_dir):
    """Fetch outcomes per feed by class."""
    kinds = {"signup": "OK", "view": "UNCHANGED", "error": "UNREACHABLE", "click": "STALE"}
    status = F.lit("EMPTY")
    for event, name in kinds.items():
        status = F.when(F.col("event_type") == event, name).otherwise(status)
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("feed_no"), status.alias("status"))
    good = F.col("status").isin("OK", "UNCHANGED")
    return e.groupBy("feed_no").agg(F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") == "UNCHANGED").alias("unchanged"), F.count_if(~good).alias("failed"), F.count("*").alias("total"), F.bool_and(good).alias("all_ok"))


@query(LISTINGS_SQL + "SELECT ord, sha256(link || published_raw) AS entry_hash FROM listings")
def entry_hash(spark, sf_dir):
    """Cache key of a raw entry."""
    return listings(spark, sf_dir).select("ord", text.entry_hash(F.col("link"), F.col("published_raw")).alias("entry_hash"))


@query(_IDS_SQL + "SELECT ord, event_id FROM ids")
def event_id_hash(spark, sf_dir):
    return with_id(listings(spark, sf_dir)).select("ord", "event_id")


def _seen(rows):
    """A cache that was written for a third of the entries, with 14 days to live."""
    return rows.where(F.col("l_orderkey") % 3 == 0).groupBy("feed", "entry_hash").agg((F.max("written") + F.make_dt_interval(days=F.lit(14))).alias("expires_at"))


def _raw(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    link = F.concat(F.lit("https://x.example/e/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    return li.select("l_orderkey", F.concat(F.lit("feed_"), (F.col("l_suppkey") % 7).cast("string")).alias("feed"), text.entry_hash(link, F.col("l_shipdate").cast("date").cast("string")).alias("entry_hash"), F.col("l_shipdate").alias("written"))


_SEEN_SQL = f"""WITH raw AS (
  SELECT l_orderkey, 'feed_' || CAST(l_suppkey % 7 AS VARCHAR) AS feed, sha256('https://x.example/e/' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS entry_hash, l_shipdate AS written FROM lineitem
), seen AS (SELECT feed, entry_hash, max(written) + INTERVAL 14 DAY AS expires_at FROM raw WHERE l_orderkey % 3 = 0 GROUP BY 1, 2)
"""


@query(_SEEN_SQL + f"SELECT r.feed, CAST(count(*) FILTER (s.expires_at > {_N}) AS BIGINT) AS hits, CAST(count(*) FILTER (s.expires_at IS NULL OR s.expires_at <= {_N}) AS BIGINT) AS misses, round(100.0 * count(*) FILTER (s.expires_at > {_N}) / count(*), 2) AS hit_rate_pct FROM raw r LEFT JOIN seen s USING (feed, entry_hash) GROUP BY r.feed")
def seen_cache_partition(spark, sf_dir):
    """Hits and misses of the seen cache, and the hit rate, per feed."""
    raw = _raw(spark, sf_dir)
    joined = raw.join(_seen(raw), ["feed", "entry_hash"], "left")
    hit = F.coalesce(F.col("expires_at") > now(), F.lit(False))
    return joined.groupBy("feed").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(F.count_if(hit) * 100.0 / F.count("*"), 2).cast("double").alias("hit_rate_pct"))


@query(_SEEN_SQL + f"SELECT feed, entry_hash, count(*) AS n FROM raw r WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.feed = r.feed AND s.entry_hash = r.entry_hash AND s.expires_at > {_N}) GROUP BY 1, 2")
def seen_cache_misses(spark, sf_dir):
    """Entries that no live cache row answers."""
    raw = _raw(spark, sf_dir)
    return keyed.hits_and_misses(raw, _seen(raw), ["feed", "entry_hash"], now())[1].groupBy("feed", "entry_hash").agg(F.count("*").alias("n"))


@query(
    LISTINGS_SQL.rstrip() + f", {_FEEDS_SQL}" + """, routed AS (
  SELECT l.ord, l.feed, coalesce(f.source_type IN ('api', 'ical') OR (f.source_type = 'scrape' AND f.structured_ingest), false) AND trim(l.title) <> '' AND regexp_matches(l.link, '^https?://[^/?#]+') AND l.price_cents IS NOT NULL AS bypass
  FROM listings l LEFT JOIN feeds f ON l.feed = f.feed)
SELECT feed, CASE WHEN bypass THEN 'bypass' ELSE 'extract' END AS route, count(*) AS n FROM routed GROUP BY 1, 2"""
)
def structured_router(spark, sf_dir):
    """Rows whose source is structured and complete skip extraction; the price stands in for the date that may be missing."""
    joined = listings(spark, sf_dir).join(F.broadcast(feeds(spark)), "feed", "left")  # seven rows
    applies = F.col("source_type").isin("api", "ical") | ((F.col("source_type") == "scrape") & F.col("structured_ingest"))
    whole = (text.strip(F.col("title")) != "") & text.is_http_url(F.col("link")) & F.col("price_cents").isNotNull()
    route = F.when(F.coalesce(applies, F.lit(False)) & whole, "bypass").otherwise("extract")
    return joined.groupBy("feed", route.alias("route")).agg(F.count("*").alias("n"))


@query(
    """SELECT p_partkey, nullif(trim(regexp_replace(regexp_replace(trim(v), '[.,;:!?]+$', ''), '\\s+', ' ', 'g')), '') AS venue,
  regexp_matches(u, '^https?://[^/?#]+', 'i') AS url_ok, CASE WHEN lower(trim(pr)) IN ('free', 'no cover', 'gratis', 'complimentary') OR contains(lower(pr), 'donation') THEN NULL
  ELSE CAST(round(CAST(nullif(regexp_extract(pr, '\\$(\\d+(?:\\.\\d{2})?)', 1), '') AS DECIMAL(18, 2)) * 100) AS INTEGER) END AS price_cents,
  coalesce(lower(trim(pr)) IN ('free', 'no cover', 'gratis', 'complimentary') OR contains(lower(pr), 'donation'), false) AS is_free
FROM (SELECT p_partkey, '  ' || p_name || '   ' || p_brand || CASE p_partkey % 3 WHEN 0 THEN ' .!' WHEN 1 THEN '!!' ELSE '' END AS v,
  CASE p_partkey % 4 WHEN 0 THEN 'https://x.example/a' WHEN 1 THEN 'HTTP://x.example' WHEN 2 THEN 'ftp://x.example' ELSE 'https:///nohost' END AS u,
  CASE p_partkey % 5 WHEN 0 THEN 'Free' WHEN 1 THEN 'from $' || CAST(p_size AS VARCHAR) || '.50 up' WHEN 2 THEN '$' || CAST(p_size AS VARCHAR) WHEN 3 THEN 'suggested Donation $5' ELSE 'tba' END AS pr FROM part)"""
)
def normalize_text(spark, sf_dir):
    """Venue cleanup, URL check, price parsing."""
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, " .!").when(k % 3 == 1, "!!").otherwise("")
    raw = table(spark, sf_dir, "part").select(
        k,
        F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand", tail).alias("v"),
        F.when(k % 4 == 0, "https://x.example/a").when(k % 4 == 1, "HTTP://x.example").when(k % 4 == 2, "ftp://x.example").otherwise("https:///nohost").alias("u"),
        F.when(k % 5 == 0, "Free").when(k % 5 == 1, F.concat(F.lit("from $"), F.col("p_size").cast("string"), F.lit(".50 up"))).when(k % 5 == 2, F.concat(F.lit("$"), F.col("p_size").cast("string"))).when(k % 5 == 3, "suggested Donation $5").otherwise("tba").alias("pr"),
    )
    v, pr = F.col("v"), F.col("pr")
    return raw.select(k, text.clean_venue(v).alias("venue"), text.is_http_url(F.col("u")).alias("url_ok"), text.price_cents(pr).alias("price_cents"), text.is_free(pr).alias("is_free"))


_ALIAS_SQL = ", ".join(f"('{k}', '{v}')" for k, v in sorted(({c.lower(): c for c in vocab.CATEGORIES} | vocab.CATEGORY_ALIASES).items()))
_LABELS = ("Concert", " jazz ", "THEATRE", "hip-hop", "Pool", "unknown", "Films", "folk")


@query(
    f"""WITH aliases(k, v) AS (VALUES {_ALIAS_SQL}), labels AS (
  SELECT p_partkey, i AS pos, list_extract({list(_LABELS)}, CAST((p_partkey + i * p_size) % 8 + 1 AS INTEGER)) AS label FROM part, range(4) t(i)),
mapped AS (SELECT p_partkey, v, min(pos) AS pos FROM labels JOIN aliases ON k = lower(trim(label)) GROUP BY 1, 2)
SELECT p.p_partkey, coalesce(string_agg(m.v, ',' ORDER BY m.pos), '') AS categories FROM part p LEFT JOIN mapped m USING (p_partkey) GROUP BY 1"""
)
def category_standardize(spark, sf_dir):
    labels = F.array(*(F.lit(x) for x in _LABELS))
    k = F.col("p_partkey")
    raw = F.array(*(F.get(labels, ((k + i * F.col("p_size")) % 8).cast("int")) for i in range(4)))
    return table(spark, sf_dir, "part").select(k, F.array_join(categories.standardize(raw), ",").alias("categories"))


def _infer_sql(haystack: str) -> str:
    cases = [f"CASE WHEN {' OR '.join(f'contains({haystack}, {w!r})' for w in words)} THEN '{c}' END" for c, words in vocab.CATEGORY_KEYWORDS]
    return f"concat_ws(',', {', '.join(cases)})"


@query(f"SELECT doc_id, {_infer_sql('t')} AS categories FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents)")
def category_infer(spark, sf_dir):
    """Keyword categories of every document."""
    found = categories.infer(F.lit(None).cast("string"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("categories"))


@query(LISTINGS_SQL + f"SELECT ord, start FROM listings WHERE start BETWEEN {_N} AND {_N} + INTERVAL 14 DAY")
def window_filter(spark, sf_dir):
    """The horizon, closed on both ends; the bound reaches the scan as a filter on the ship date."""
    return listings(spark, sf_dir).where(F.col("start").between(now(), now() + F.make_dt_interval(days=F.lit(vocab.HORIZON_DAYS)))).select("ord", "start")


@query(
    f"""SELECT o_orderkey, s, e FROM (SELECT o_orderkey, least(a, b) AS s, greatest(a, b) AS e FROM (SELECT o_orderkey, o_orderdate AS a, o_orderdate + to_days(CAST(o_orderkey % 61 - 20 AS INTEGER)) AS b FROM orders))
WHERE s <= {_N} + INTERVAL 14 DAY AND e >= {_N}"""
)
def range_overlap(spark, sf_dir):
    """Ranges, swapped where reversed, that overlap the horizon."""
    a = F.col("o_orderdate")
    b = a + F.make_dt_interval(days=(F.col("o_orderkey") % 61 - 20).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.least(a, b).alias("s"), F.greatest(a, b).alias("e"))
    return rows.where((F.col("s") <= now() + F.make_dt_interval(days=F.lit(14))) & (F.col("e") >= now()))


_DISCARD_SQL = LISTINGS_SQL.rstrip() + f""", reasons AS (
  SELECT ord, title, feed, CASE WHEN is_free AND price_cents IS NULL AND right(ord, 1) = '7' THEN 'unparseable_date' WHEN venue = 'Venue 3' THEN 'missing_venue' WHEN city = 'NATION_5' OR right(ord, 1) = '1' THEN 'invalid_url'
    WHEN NOT start BETWEEN {_N} AND {_N} + INTERVAL 14 DAY THEN 'outside_window' END AS reason FROM listings)
"""


def _reasons(spark, sf_dir):
    """Discard reason by precedence; the flaws are planted by rules on the listing."""
    last = F.right("ord", F.lit(1))
    inside = F.col("start").between(now(), now() + F.make_dt_interval(days=F.lit(14)))
    reason = F.when(F.col("is_free") & F.col("price_cents").isNull() & (last == "7"), "unparseable_date").when(F.col("venue") == "Venue 3", "missing_venue").when((F.col("city") == "NATION_5") | (last == "1"), "invalid_url").when(~inside, "outside_window")
    return listings(spark, sf_dir).withColumn("reason", reason)


@query(_DISCARD_SQL + "SELECT reason, count(*) AS n, array_to_string(list_slice(list(title ORDER BY ord), 1, 5), '|') AS sample FROM reasons WHERE reason IS NOT NULL GROUP BY reason")
def normalize_discards(spark, sf_dir):
    """Discards per reason with the first five titles. Samples are cut by a pushed-down window limit, counts are a plain aggregate,
    so no reason's rows are gathered."""
    from pyspark.sql.window import Window

    gone = _reasons(spark, sf_dir).where(F.col("reason").isNotNull()).select("reason", "ord", "title")
    few = gone.withColumn("n", F.row_number().over(Window.partitionBy("reason").orderBy("ord"))).where("n <= 5")
    sample = few.groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]), "|").alias("sample"))
    return gone.groupBy("reason").agg(F.count("*").alias("n")).join(sample, "reason").select("reason", "n", "sample")


@query(_DISCARD_SQL + ", names(reason) AS (VALUES ('unparseable_date'), ('missing_venue'), ('invalid_url'), ('outside_window'), ('normalization_error')) SELECT n.reason, count(r.ord) AS n FROM names n LEFT JOIN reasons r ON n.reason = r.reason GROUP BY n.reason")
def discard_histogram(spark, sf_dir):
    """Counts per reason, zeros included."""
    names = spark.createDataFrame([(x,) for x in ("unparseable_date", "missing_venue", "invalid_url", "outside_window", "normalization_error")], "reason string")
    counts = _reasons(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))
    return names.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


@query(_IDS_SQL + ", firsts AS (SELECT feed, link, title, arg_min(ord, ord) AS match_ord FROM ids GROUP BY 1, 2, 3) SELECT i.ord, f.match_ord FROM ids i LEFT JOIN firsts f ON f.feed = i.feed AND f.link = i.link AND f.title = i.title")
def first_match_backjoin(spark, sf_dir):
    """Each event with the first candidate of its feed, link and title."""
    rows = listings(spark, sf_dir).select("ord", "feed", "link", "title")
    return keyed.first_match(rows, rows, ["feed", "link", "title"], "ord").select("ord", "match_ord")


@query(_IDS_SQL + "SELECT event_id, count(*) AS n, min(ord) AS first_ord FROM ids GROUP BY event_id")
def dedup_exact(spark, sf_dir):
    return with_id(listings(spark, sf_dir)).groupBy("event_id").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@query(
    _IDS_SQL + """, best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY source_quality DESC, feed DESC, ord) AS rn FROM ids),
grouped AS (SELECT event_id, array_to_string(list_sort(list(DISTINCT feed)), ',') AS feeds, count(DISTINCT feed) AS source_count, count(*) AS n_members FROM ids GROUP BY 1)
SELECT g.event_id, b.ord, b.title, b.feed AS best_feed, b.source_quality, g.feeds, CAST(g.source_count AS INTEGER) AS source_count, g.n_members, CASE WHEN g.n_members <= 1 THEN 'none' ELSE 'exact_id' END AS merge_type FROM grouped g JOIN best b ON b.event_id = g.event_id AND rn = 1"""
)
def dedup_merge(spark, sf_dir):
    """Exact duplicates merged: best source's content, all feeds, kind of merge."""
    merged = dedup.merge(with_id(listings(spark, sf_dir).select("ord", "title", "feed", "source_quality", "event_date", "venue")))
    return merged.select("event_id", "ord", "title", F.col("feed").alias("best_feed"), "source_quality", F.array_join("source_feeds", ",").alias("feeds"), "source_count", "n_members", "merge_type")


#: Indel similarity of titles that share a day and venue: rows of the longest-common-subsequence table, one character at a time, where each
#: cell is the greatest of the cells to its left
_PAIRS_SQL = _IDS_SQL.replace("WITH listings", "WITH RECURSIVE listings", 1) + """, t AS (SELECT DISTINCT event_date, lower(trim(venue)) AS vk, title, event_id FROM ids),
p AS (SELECT DISTINCT a.title AS a, b.title AS b FROM (SELECT DISTINCT event_date, vk, title FROM t) a JOIN (SELECT DISTINCT event_date, vk, title FROM t) b ON a.event_date = b.event_date AND a.vk = b.vk AND a.title < b.title),
lcs AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: CAST(0 AS BIGINT)) AS r FROM p
  UNION ALL SELECT a, b, i + 1, list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(b) + 1), lambda j: list_max(c[1:j]))) AS r
  FROM (SELECT a, b, i, list_transform(range(1, length(b) + 1), lambda j: greatest(r[j + 1], CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(j AS INTEGER), 1) THEN r[j] + 1 ELSE 0 END)) AS c FROM lcs WHERE i < length(a))),
alike AS (SELECT a, b, 2.0 * r[length(b) + 1] / (length(a) + length(b)) AS similarity FROM lcs WHERE i = length(a)),
pairs AS (SELECT DISTINCT least(x.event_id, y.event_id) AS left_id, greatest(x.event_id, y.event_id) AS right_id, similarity
  FROM (SELECT a, b, CAST(similarity AS DOUBLE) AS similarity FROM alike WHERE similarity > 0.85 UNION ALL SELECT title, title, 1.0 FROM (SELECT DISTINCT title FROM t)) s
  JOIN t x ON x.title = s.a JOIN t y ON y.title = s.b AND x.event_date = y.event_date AND x.vk = y.vk WHERE x.event_id <> y.event_id)
"""


@query(_PAIRS_SQL + "SELECT left_id, right_id, round(similarity, 6) AS similarity FROM pairs")
def dedup_fuzzy_pairs(spark, sf_dir):
    """Alike titles on the same day at the same venue."""
    return dedup.fuzzy_pairs(with_id(listings(spark, sf_dir))).withColumn("similarity", F.round("similarity", 6))


@query(
    _PAIRS_SQL + """, near AS (SELECT left_id AS a, right_id AS b FROM pairs UNION SELECT right_id, left_id FROM pairs),
reach AS (SELECT DISTINCT a, a AS b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
named AS (SELECT i.*, coalesce(c.cluster, i.event_id) AS cluster FROM ids i LEFT JOIN (SELECT a, min(b) AS cluster FROM reach GROUP BY a) c ON c.a = i.event_id),
best AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY source_quality DESC, feed DESC, ord) AS rn FROM named),
grouped AS (SELECT cluster, array_to_string(list_sort(list(DISTINCT feed)), ',') AS feeds, CAST(count(DISTINCT feed) AS INTEGER) AS source_count, count(*) AS n_members, count(DISTINCT event_id) AS n_ids FROM named GROUP BY 1)
SELECT g.cluster, b.event_id, b.ord, b.title, b.feed, g.feeds, g.source_count, g.n_members, CASE WHEN g.n_members <= 1 THEN 'none' WHEN g.n_ids = 1 THEN 'exact_id' ELSE 'fuzzy' END AS merge_type
FROM grouped g JOIN best b ON b.cluster = g.cluster AND rn = 1"""
)
def dedup_clusters(spark, sf_dir):
    """Events merged over exact and fuzzy duplicates."""
    rows = with_id(listings(spark, sf_dir).select("ord", "title", "feed", "source_quality", "event_date", "venue"))
    merged = dedup.merge(rows.join(dedup.clusters(rows), "event_id"), "cluster")
    return merged.select("cluster", "event_id", "ord", "title", "feed", F.array_join("source_feeds", ",").alias("feeds"), "source_count", "n_members", "merge_type")


@query(
    _IDS_SQL + """, t AS (SELECT DISTINCT event_date, venue, title, event_id FROM ids)
SELECT least(a.event_id, b.event_id) AS left_id, greatest(a.event_id, b.event_id) AS right_id FROM t a JOIN t b ON a.event_date = b.event_date AND a.venue = b.venue AND a.title < b.title WHERE levenshtein(a.title, b.title) <= 1"""
)
def dedup_levenshtein_pairs(spark, sf_dir):
    """The same blocks with a bounded edit distance, which both engines have."""
    t = with_id(listings(spark, sf_dir)).select("event_date", "venue", "title", "event_id").distinct()
    u = t.withColumnRenamed("title", "other").withColumnRenamed("event_id", "other_id")
    pairs = t.join(u, ["event_date", "venue"]).where((F.col("title") < F.col("other")) & (F.levenshtein("title", "other", 1) >= 0))
    return pairs.select(F.least("event_id", "other_id").alias("left_id"), F.greatest("event_id", "other_id").alias("right_id"))


_W = r"[\p{L}\p{N}_]"
_NAME = rf"[A-Z]({_W}|[''-])+(?:\s+[A-Z]({_W}|[''-])+)*".replace("({_W}", "(?:{_W}").replace(f"({_W}", f"(?:{_W}")
_GENERIC = " OR ".join(f"(n = '{p}' OR starts_with(n, '{p} '))" for p in vocab.GENERIC_PERFORMERS)
_PATTERNS_SQL = (
    rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:featuring|feat\.?|starring|presents|presented by)\s+({_NAME})",
    rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])with\s+(?:special guest\s+)?({_NAME})",
    rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])DJ\s+([A-Z](?:{_W}|[''-])+)",
)


@query(
    "WITH d AS (SELECT doc_id, source, text, trim(text) AS s, "
    + ", ".join(f"lower(trim(regexp_extract(source || chr(10) || text, '{p}', 1))) AS n{k}" for k, p in enumerate(_PATTERNS_SQL))
    + " FROM documents), q AS (SELECT doc_id, CASE WHEN length(s) = 0 THEN 0.0 WHEN length(s) < 50 THEN 0.3 WHEN length(s) < 150 THEN 0.7 ELSE 1.0 END AS len, CASE WHEN "
    + " OR ".join(f"(n{k} <> '' AND NOT ({_GENERIC.replace('(n ', f'(n{k} ').replace('starts_with(n,', f'starts_with(n{k},')}))" for k in range(3))
    + " THEN 1.0 ELSE 0.0 END AS performer, CASE WHEN doc_id % 9 = 0 THEN 0.0 ELSE 1.0 END AS venue, CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 1.0 END AS dt, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 1.0 END AS cat, CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE 1.0 END AS url, CASE WHEN doc_id % 2 = 0 THEN 0.0 ELSE 1.0 END AS price FROM d) "
    "SELECT doc_id, CAST(len AS DOUBLE) AS description_length, CAST(performer AS DOUBLE) AS performer_named, round(CAST(0.2 * len + 0.2 * venue + 0.2 * dt + 0.15 * performer + 0.1 * cat + 0.1 * url + 0.05 * price AS DOUBLE), 4) AS quality, 0.2 * len + 0.2 * venue + 0.2 * dt + 0.15 * performer + 0.1 * cat + 0.1 * url + 0.05 * price < 0.29995 AS low_information FROM q"
)
def quality_rubric(spark, sf_dir):
    """The seven-signal rubric over the documents as descriptions."""
    k = F.col("doc_id")
    start = F.when(k % 4 == 0, F.lit("1998-06-02 00:00:00")).otherwise(F.lit("1998-06-02 19:30:00")).cast("timestamp_ntz")
    signals = scoring.quality_signals(
        F.col("source"), F.col("text"), F.when(k % 9 == 0, " TBA ").otherwise("Hall"), start, F.lit(None).cast("timestamp_ntz"),
        F.when(k % 5 == 0, F.array(F.lit("Misc "))).otherwise(F.array(F.lit("Misc"), F.lit("Jazz"))),
        F.when(k % 7 == 0, "ftp://x").otherwise("https://x.example"), F.when(k % 2 == 1, F.lit(500)), F.lit(False),
    )
    q = scoring.quality(signals)
    return table(spark, sf_dir, "documents").select(k, signals["description_length"].alias("description_length"), signals["performer_named"].alias("performer_named"), q.alias("quality"), (q < vocab.LOW_INFORMATION_BELOW).alias("low_information"))


@query(
    _IDS_SQL + f""", excluded AS (SELECT DISTINCT event_id FROM ids WHERE right(ord, 1) = '2'),
r AS (SELECT i.ord, CASE WHEN source_quality < 0.15 THEN 'low_information' WHEN e.event_id IS NOT NULL THEN 'in_exclude_window' WHEN NOT start BETWEEN {_N} AND {_N} + INTERVAL 14 DAY THEN 'outside_coming_week' END AS reason FROM ids i LEFT JOIN excluded e USING (event_id))
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1"""
)
def pre_enrichment_filter(spark, sf_dir):
    """Reasons by precedence before the expensive steps. Only the start counts, not a range's end."""
    rows = with_id(listings(spark, sf_dir))
    excluded = rows.where(F.right("ord", F.lit(1)) == "2").select("event_id").distinct().withColumn("gone", F.lit(True))
    joined = rows.join(excluded, "event_id", "left")
    inside = F.col("start").between(now(), now() + F.make_dt_interval(days=F.lit(14)))
    reason = F.when(F.col("source_quality") < 0.15, "low_information").when(F.col("gone"), "in_exclude_window").when(~inside, "outside_coming_week").otherwise("kept")
    return joined.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    LISTINGS_SQL.rstrip() + """, v AS (SELECT city, lower(venue) || '|' || lower(city) AS venue_key, min(ord) AS rep_ord, count(*) AS n FROM listings GROUP BY 1, 2),
c AS (SELECT *, CAST(right(venue_key, 1) = '1' OR n % 3 = 0 AS BOOLEAN) AS sure FROM v)
SELECT l.ord, c.rep_ord, CASE WHEN c.sure THEN 'near ' || l.venue END AS context FROM listings l JOIN c ON lower(l.venue) || '|' || lower(l.city) = c.venue_key"""
)
def venue_dedupe_fanback(spark, sf_dir):
    """One representative per venue is looked up and its answer goes to all; answers below confidence 0.5 are cleared."""
    rows = listings(spark, sf_dir).select("ord", "venue", "city", F.concat(F.lower("venue"), F.lit("|"), F.lower("city")).alias("venue_key"))
    reps = rows.groupBy("venue_key").agg(F.min_by("venue", "ord").alias("rep_venue"), F.min("ord").alias("rep_ord"), F.count("*").alias("n"))
    confidence = F.when((F.right("venue_key", F.lit(1)) == "1") | (F.col("n") % 3 == 0), 0.8).otherwise(0.4)
    answered = reps.select("venue_key", "rep_ord", F.when(confidence >= 0.5, F.concat(F.lit("near "), "rep_venue")).alias("context"))
    return rows.join(answered, "venue_key").select("ord", "rep_ord", "context")


@query(
    f"""WITH w AS (SELECT c_nationkey AS k, c_custkey, c_mktsegment, c_acctbal FROM customer), old AS (SELECT * FROM w WHERE c_custkey % 2 = 0), new AS (SELECT * FROM w WHERE c_custkey % 2 = 1), u AS (SELECT * FROM old UNION ALL SELECT * FROM new)
SELECT k, max(c_custkey) AS written_at, arg_max(c_mktsegment, c_custkey) AS value, round(arg_max(c_acctbal, c_custkey), 6) AS amount FROM u GROUP BY k"""
)
def cache_upsert(spark, sf_dir):
    """Last write per key wins."""
    w = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("written_at"), F.col("c_mktsegment").alias("value"), F.round("c_acctbal", 6).alias("amount"))
    return keyed.upsert(w.where("written_at % 2 = 0"), w.where("written_at % 2 = 1"), ["k"], "written_at")


_VENUES_SQL = """WITH old AS (SELECT s_suppkey AS k, s_acctbal AS lat, 'old ' || s_name AS context, TIMESTAMP '1998-05-01' + to_days(CAST(s_suppkey % 60 AS INTEGER)) AS geo_expires_at, TIMESTAMP '1998-05-01' + to_days(CAST(s_suppkey % 45 AS INTEGER)) AS context_expires_at FROM supplier WHERE s_suppkey % 3 <> 0),
new AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 END AS lat, CASE WHEN s_suppkey % 5 = 0 THEN 'new ' || s_name END AS context FROM supplier WHERE s_suppkey % 4 <> 0),
merged AS (SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.lat IS NOT NULL THEN n.lat ELSE o.lat END AS lat, CASE WHEN n.lat IS NOT NULL THEN TIMESTAMP '1998-08-30' ELSE o.geo_expires_at END AS geo_expires_at,
  CASE WHEN n.context IS NOT NULL THEN n.context ELSE o.context END AS context, CASE WHEN n.context IS NOT NULL THEN TIMESTAMP '1998-07-01' ELSE o.context_expires_at END AS context_expires_at FROM old o FULL JOIN new n ON o.k = n.k)
"""
_GROUPS = {"geo": ["lat"], "context": ["context"]}


def _venues(spark, sf_dir):
    s, day = table(spark, sf_dir, "supplier"), lambda n: F.lit("1998-05-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=n.cast("int"))
    k = F.col("s_suppkey")
    old = s.where(k % 3 != 0).select(k.alias("k"), F.col("s_acctbal").alias("lat"), F.concat(F.lit("old "), "s_name").alias("context"), day(k % 60).alias("geo_expires_at"), day(k % 45).alias("context_expires_at"))
    new = s.where(k % 4 != 0).select(k.alias("k"), F.when(k % 2 == 0, F.col("s_acctbal") + 1).alias("lat"), F.when(k % 5 == 0, F.concat(F.lit("new "), "s_name")).alias("context"))
    expiry = {g: now() + F.make_dt_interval(days=F.lit(vocab.CACHE_TTL_DAYS[f"venue_{g}"])) for g in _GROUPS}
    return keyed.partial_upsert(old, new, "k", _GROUPS, expiry)


@query(_VENUES_SQL + "SELECT k, round(lat, 6) AS lat, geo_expires_at, context, context_expires_at FROM merged")
def venue_partial_upsert(spark, sf_dir):
    """Column groups refresh apart, each with its own clock."""
    return _venues(spark, sf_dir).withColumn("lat", F.round("lat", 6))


@query(_VENUES_SQL + f"SELECT k, round(CASE WHEN geo_expires_at > {_N} THEN lat END, 6) AS lat, CASE WHEN context_expires_at > {_N} THEN context END AS context FROM merged WHERE coalesce(geo_expires_at > {_N}, false) OR coalesce(context_expires_at > {_N}, false)")
def dual_ttl_read(spark, sf_dir):
    """Groups null out apart; a row is a miss when both have expired."""
    return keyed.read_groups(_venues(spark, sf_dir), "k", _GROUPS, now()).withColumn("lat", F.round("lat", 6))


@query(_SEEN_SQL + f"SELECT feed, count(*) AS total, count(*) FILTER (expires_at < {_N}) AS expired, count(*) FILTER (NOT expires_at < {_N}) AS active FROM seen GROUP BY feed")
def cache_stats(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    gone = F.col("expires_at") < now()
    return _seen(raw).groupBy("feed").agg(F.count("*").alias("total"), F.count_if(gone).alias("expired"), F.count_if(~gone).alias("active"))
