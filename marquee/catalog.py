"""Domain views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text

NOW = "1998-06-01 00:00:00"
FEEDBACK_NOW = "2024-01-31 00:00:00"


def now(value: str = NOW):
    return F.lit(value).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feeds(spark: SparkSession) -> DataFrame:
    """Seven feeds: quality (i + 1) / 10, the first two national, three source types."""
    kinds = ("rss", "ical", "api", "scrape")
    rows = [(f"feed_{i}", (i + 1) / 10, i < 2, kinds[i % 4], i != 5, i == 3) for i in range(7)]
    return spark.createDataFrame(rows, "feed string, quality double, is_national boolean, source_type string, active boolean, structured_ingest boolean")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: an event listing as its feed gave it. ``ord`` is a total order that needs no global sort."""
    li, part, supp, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    joined = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    return joined.select(
        F.concat_ws("-", pad(F.col("l_orderkey"), 12), pad(F.col("l_linenumber"), 3), pad(F.col("l_partkey"), 12), pad(F.col("l_suppkey"), 12), pad(F.round("l_quantity").cast("bigint"), 6), pad(cents, 14)).alias("ord"),
        F.concat("p_name", F.when(F.col("l_linenumber") % 2 == 1, "!").otherwise("")).alias("title"),
        F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).cast("date").alias("event_date"),
        (F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber") * 3)).alias("start"),
        F.concat(F.lit("Venue "), (F.col("l_suppkey") % 10).cast("string")).alias("venue"),
        F.col("n_name").alias("city"),
        F.concat(F.lit("feed_"), (F.col("l_suppkey") % 7).cast("string")).alias("feed"),
        ((F.col("l_suppkey") % 7 + 1) / 10.0).alias("source_quality"),
        F.when(F.col("l_discount") != 0, F.least(cents, F.lit(1_000_000_000)).cast("int")).alias("price_cents"),
        (F.col("l_discount") == 0).alias("is_free"),
        F.when(F.col("p_size") % 3 == 0, "Music").when(F.col("p_size") % 3 == 1, "Jazz").otherwise("Film").alias("category"),
        F.concat(F.lit("https://x.example/e/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("link"),
        F.col("l_shipdate").cast("date").cast("string").alias("published_raw"),
    )


#: the same view for the oracle
LISTINGS_SQL = """
WITH listings AS (
  SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-'
         || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(CAST(round(l_quantity) AS BIGINT) AS VARCHAR), 6, '0') || '-' || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 14, '0') AS ord,
    p_name || CASE WHEN l_linenumber % 2 = 1 THEN '!' ELSE '' END AS title,
    CAST(date_trunc('week', l_shipdate) AS DATE) AS event_date,
    l_shipdate + to_hours(l_linenumber * 3) AS start,
    'Venue ' || CAST(l_suppkey % 10 AS VARCHAR) AS venue,
    n_name AS city,
    'feed_' || CAST(l_suppkey % 7 AS VARCHAR) AS feed,
    CAST((l_suppkey % 7 + 1) / 10.0 AS DOUBLE) AS source_quality,
    CASE WHEN l_discount <> 0 THEN CAST(least(CAST(round(l_extendedprice * 100) AS BIGINT), 1000000000) AS INTEGER) END AS price_cents,
    l_discount = 0 AS is_free,
    CASE WHEN p_size % 3 = 0 THEN 'Music' WHEN p_size % 3 = 1 THEN 'Jazz' ELSE 'Film' END AS category,
    'https://x.example/e/' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS link,
    CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS published_raw
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)
"""


def with_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_id", text.event_id(F.col("title"), F.col("event_date").cast("string"), F.col("venue")))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and errors as signals: user, category number, time."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'error')")
    return e.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", "click").otherwise("negative").alias("signal"), F.coalesce(k % 24, F.lit(0)).alias("category_no"))


FEEDBACK_SQL = """
WITH feedback AS (
  SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN 'click' ELSE 'negative' END AS signal,
         coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER) % 24, 0) AS category_no
  FROM events WHERE event_type IN ('click', 'error')
)
"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as past recommendations of the event ``props.k``."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.get_json_object("props", "$.k").alias("event_key"), F.col("ts").alias("recommended_at"), "user_id", F.col("event_id").alias("token"))


HISTORY_SQL = """
WITH history AS (
  SELECT json_extract_string(props, '$.k') AS event_key, ts AS recommended_at, user_id, event_id AS token FROM events WHERE event_type = 'purchase'
)
"""
