"""Candidates to normalised events: one row per kept occurrence, one reason per discarded candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import categories, text, vocab
from ..functions.schedule import schedule


def expand(candidates: DataFrame, now: str, horizon_days: int = vocab.HORIZON_DAYS) -> DataFrame:
    """Candidates with ``reason`` (null if kept) and ``occurrences`` (array of struct<start, end>): festivals that overlap the horizon, or
    the first five single starts inside it. Reasons by precedence: unparseable_date, missing_venue, invalid_url, outside_window."""
    low = F.lit(now).cast("timestamp")
    high = low + F.make_dt_interval(days=F.lit(horizon_days))
    spans = F.arrays_zip(F.col("_s.starts").alias("start"), F.col("_s.ends").alias("end"))
    overlaps = F.filter(spans, lambda x: (x["start"] <= high) & (x["end"] >= low))
    inside = F.slice(F.filter(spans, lambda x: x["start"].between(low, high)), 1, vocab.MAX_OCCURRENCES)
    kept = F.when(F.col("_s.kind") == "festival", overlaps).otherwise(inside)
    out = candidates.withColumn("_s", schedule(F.col("date"), F.col("time"), now)).withColumn("occurrences", kept)
    reason = (
        F.when(F.col("_s.kind").isNull(), "unparseable_date")
        .when(text.clean_venue(F.col("venue")).isNull(), "missing_venue")
        .when(~text.is_http_url(F.col("url")), "invalid_url")
        .when(F.size("occurrences") == 0, "outside_window")
    )
    return out.withColumn("reason", reason).withColumn("kind", F.col("_s.kind")).withColumn("time_dropped", F.col("_s.time_dropped")).drop("_s")


def normalize(candidates: DataFrame, feeds: DataFrame, now: str, horizon_days: int = vocab.HORIZON_DAYS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Events of the kept candidates, with the candidates' columns ``carry``. ``candidates``: title, date, time, venue, city, url, price, description, categories, feed;
    ``feeds``: feed, quality (0.5 where a feed isn't listed)."""
    kept = expand(candidates, now, horizon_days).where("reason is null").withColumn("o", F.explode("occurrences"))
    venue, day = text.clean_venue(F.col("venue")), F.date_format(F.col("o.start"), "yyyy-MM-dd")
    id_date = F.when(F.col("kind").isin("series", "list"), day).otherwise(F.coalesce(F.nullif(F.col("date"), F.lit("")), day))
    base = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("title"))
    joined = kept.join(feeds.select("feed", "quality"), "feed", "left")
    return joined.select(
        text.event_id(F.col("title"), id_date, venue).alias("event_id"),
        text.strip(F.col("title")).alias("title"),
        F.col("o.start").alias("start"),
        F.col("o.end").alias("end"),
        venue.alias("venue"),
        text.strip(F.col("city")).alias("city"),
        text.strip(F.col("url")).alias("url"),
        text.price_cents(F.col("price")).alias("price_cents"),
        text.is_free(F.col("price")).alias("is_free"),
        text.strip(text.with_schedule(base, F.col("date"), F.col("time"))).alias("description"),
        categories.standardize(F.col("categories")).alias("categories"),
        "feed",
        F.coalesce("quality", F.lit(0.5)).alias("source_quality"),
        "kind",
        "time_dropped",
        *carry,
    )
