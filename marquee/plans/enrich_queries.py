"""Queries of enrichment, validation, text building and logs, each with its oracle."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..catalog import LISTINGS_SQL, listings, table
from ..functions import text, vocab
from ..operators import enrich, select
from ..sources import catalog_file, sinks
from ..storage import fresh_path

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT 'feed_' || CAST(s_suppkey AS VARCHAR) AS feed FROM supplier WHERE s_suppkey IN (1, 4, 6)")
def feed_subset(spark, sf_dir):
    """Feeds of a catalog, here the suppliers, that are asked for by id."""
    catalog = table(spark, sf_dir, "supplier").select(F.concat(F.lit("feed_"), F.col("s_suppkey").cast("string")).alias("feed"))
    return catalog_file.subset(catalog, catalog_file.parse_ids(" feed_4,feed_1 ,, feed_6"), "feed").select("feed")


@query("SELECT p_partkey, lower(trim(p_type)) IN ('economy', 'small') AS excluded FROM part")
def excluded_category_filter(spark, sf_dir):
    unwanted = F.array(F.lit(" Economy"), F.lit("SMALL "))
    return table(spark, sf_dir, "part").select("p_partkey", enrich.excluded(F.array(F.col("p_type"), F.lit("x")), unwanted).alias("excluded"))


@query(
    "SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'home_city' WHEN c_custkey % 7 = 0 THEN 'vibe_preferences' WHEN c_custkey % 10 / 9.0 > 1 OR c_acctbal < 0 THEN 'category_weights' WHEN c_custkey % 70 NOT BETWEEN 1 AND 60 THEN 'horizon_days' END AS reason FROM customer) GROUP BY 1"
)
def validation_quarantine(spark, sf_dir):
    """Profiles by the first rule they break."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(k % 11 == 0, "  ").otherwise("Metro").alias("home_city"),
        F.when(k % 7 == 0, F.array(F.lit("social"), F.lit("loud"))).otherwise(F.array(F.lit("social"))).alias("vibe_preferences"),
        F.array(F.struct(F.lit("jazz").alias("key"), F.when(F.col("c_acctbal") < 0, -0.1).otherwise(k % 10 / 9.0).alias("weight"))).alias("category_weights"),
        (k % 70).alias("horizon_days"),
    )
    return rows.groupBy(F.coalesce(enrich.invalid_profile(rows), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ':cafe|Brand:place' ELSE 'Op:museum' END AS pois, printf('coord:%.5f:%.5f', s_acctbal, s_suppkey / 4.0) AS coord_key FROM supplier")
def poi_parse(spark, sf_dir):
    """Places of a map answer, and coordinate keys."""
    name = F.col("s_name")
    even = F.concat(F.lit('{"elements":[{"tags":{"name":"'), name, F.lit('","amenity":"cafe"}},{"tags":{"name":"'), F.upper(name), F.lit('","shop":"x"}},{"tags":{"brand":"Brand"}},{"tags":{"amenity":"bench"}},{"id":3}]}'))
    payload = F.when(F.col("s_suppkey") % 2 == 0, even).otherwise('{"elements":[{"tags":{"name":"","operator":"Op","tourism":"museum","building":"yes"}}]}')
    found = F.transform(enrich.pois(payload), lambda p: F.concat_ws(":", p["name"], p["type"]))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(found, "|").alias("pois"), enrich.coordinate_key(F.col("s_acctbal"), F.col("s_suppkey") / 4.0).alias("coord_key"))


@query(
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'General event discovery' WHEN 1 THEN 'Interests: jazz, ' || c_mktsegment ELSE 'Interests: jazz, ' || c_mktsegment || '; Vibe preferences: social' END AS summary, c_name || ' looks worth your time this week based on your profile signals.' AS explanation, 'one|' || c_name || '|' || c_name AS aligned, replace(replace(c_name || ' <b>', '<', '&lt;'), '>', '&gt;') AS escaped FROM customer"
)
def text_builders(spark, sf_dir):
    """Profile summary, explanation, aligned descriptions, escaping."""
    k, name = F.col("c_custkey"), F.col("c_name")
    none = F.array().cast("array<string>")
    interests = F.when(k % 3 == 0, none).otherwise(F.array(F.lit("jazz"), F.col("c_mktsegment")))
    vibes = F.when(k % 3 == 2, F.array(F.lit("social"))).otherwise(none)
    aligned = enrich.align_descriptions(F.array(F.lit(" one "), F.lit("  ")), F.array(name, name, name))
    return table(spark, sf_dir, "customer").select(k, enrich.profile_summary(interests=interests, vibe_preferences=vibes).alias("summary"), enrich.fallback_explanation(name).alias("explanation"), F.array_join(aligned, "|").alias("aligned"), text.html_escape(F.concat(name, F.lit(" <b>"))).alias("escaped"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax >= 0.07 THEN 'sum' END AS summary, round(CASE WHEN l_discount > l_tax THEN l_discount ELSE l_tax END, 6) AS affinity FROM lineitem")
def performer_prepare(spark, sf_dir):
    """Summaries of unsure performers go; the greatest affinity stays."""
    p = F.array(
        F.struct(F.lit("A").alias("name"), (F.col("l_tax") * 10).alias("confidence"), F.lit("sum").alias("one_line_summary"), F.col("l_discount").alias("affinity_score")),
        F.struct(F.lit("B").alias("name"), F.lit(1.0).alias("confidence"), F.lit("b").alias("one_line_summary"), F.col("l_tax").alias("affinity_score")),
    )
    ready = enrich.prepare_performers(p, 0.7 - 1e-9)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.get(ready, F.lit(0))["one_line_summary"].alias("summary"), F.round(enrich.top_affinity(ready), 6).alias("affinity"))


def _stub(prompt: str) -> str:
    """A deterministic extractor: lines that mention a ring are no events, some answers can't be read."""
    title = prompt.split("\n")[0]
    if title.startswith("small"):
        return "cannot say"
    return json.dumps({"is_event": "ring" not in title, "title": title.upper(), "city": "Metro"})


@query("SELECT upper(p_name) AS title, 'Metro' AS city, count(*) AS n FROM part WHERE p_name NOT LIKE '%ring%' AND p_name NOT LIKE 'small%' GROUP BY 1")
def llm_extraction(spark, sf_dir):
    """Unstructured rows through a pluggable extractor, each distinct prompt once."""
    entries = table(spark, sf_dir, "part").select(F.lit("f").alias("feed"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("published_raw"), F.lit(None).cast("string").alias("link"))
    return enrich.extract(entries, _stub).groupBy("title", "city").agg(F.count("*").alias("n"))


@query("SELECT user_id % 5 AS run, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events WHERE user_id % 3 = 1 AND event_type = 'error' GROUP BY 1")
def log_filter(spark, sf_dir):
    """A JSON-lines log, written and read back by agent and level; broken lines are left out."""
    e = table(spark, sf_dir, "events")
    rows = e.select("ts", F.concat(F.lit("run_"), (F.col("user_id") % 5).cast("string")).alias("run_id"), F.concat(F.lit("agent_"), (F.col("user_id") % 3).cast("string")).alias("agent"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("event_type").alias("message"), F.col("props").alias("data"))
    path = fresh_path(spark, "log")
    sinks.write_log(rows.withColumn("ts", F.col("ts").cast("timestamp")), path)
    found = sinks.read_log(spark, path, agent="agent_1", level="ERROR")
    return found.groupBy(F.replace("run_id", F.lit("run_"), F.lit("")).cast("bigint").alias("run")).agg(F.count("*").alias("n"), F.count_distinct("message").alias("kinds"))


@query(LISTINGS_SQL.rstrip() + ", w AS (SELECT count(DISTINCT venue) AS n_venues, count(DISTINCT event_date) AS n_dates FROM listings) SELECT k AS category, (SELECT count(*) FROM listings WHERE category = k) AS n, n_venues, n_dates FROM (VALUES ('Film'), ('Jazz'), ('Music'), ('Opera')) t(k), w")
def selection_totals(spark, sf_dir):
    """Totals per category, distinct venues and dates of a selection; categories without a pick count zero."""
    rows = listings(spark, sf_dir).select("category", "venue", F.col("event_date").alias("date"))
    return select.totals(rows, ["Film", "Jazz", "Music", "Opera"])
