"""The weekly run as one composition of operators: raw entries in, each user's list out.

Every stage is a DataFrame; ``run`` can stop after any of them, and stages that are costly to repeat are written to a
folder and picked up again when the run resumes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import categories, scoring, text, vocab
from ..operators import dedup, enrich, groups, keyed, normalize, select

STAGES = ("entries", "candidates", "events", "filtered", "enriched", "ranked", "picks")


@dataclass
class Inputs:
    """Tables of a run. ``entries``: feed, source_type, title, link, description, published_raw, categories, venue, city, and ``ord`` (string), their
    order, where that matters;
    ``feeds``: feed, quality, source_type, structured_ingest; ``profiles``: user_id, home_city, category_weights (array of
    struct<key, weight>), vibe_preferences, preferred_neighborhoods, excluded_categories; ``seen``: feed, entry_hash, expires_at;
    ``history``: user_id, event_id, recommended_at; ``seen_events``: what the cache keeps of seen entries, feed, entry_hash and an event's columns; ``liked``:
    user_id, embedding.

    Strategies answer prompts with JSON: ``strategy`` extracts events, ``vibes`` gives vibe_tags, ``performers`` gives performers, ``neighborhoods`` gives
    neighborhood and confidence for a venue and city; ``embed`` turns a text into a vector. What has no strategy stays empty. ``max_extraction``
    caps the entries that the extractor is asked about."""

    entries: DataFrame
    feeds: DataFrame
    profiles: DataFrame
    seen: DataFrame
    history: DataFrame
    now: str
    horizon_days: int = vocab.HORIZON_DAYS
    strategy: Callable[[str], str] | None = None
    seen_events: DataFrame | None = None
    max_extraction: int | None = None
    vibes: Callable[[str], str] | None = None
    performers: Callable[[str], str] | None = None
    neighborhoods: Callable[[str], str] | None = None
    embed: Callable[[str], list[float]] | None = None
    liked: DataFrame | None = None
    checkpoint: str | None = None
    made: dict[str, DataFrame] = field(default_factory=dict)


def _kept(inputs: Inputs, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table: what an earlier run wrote, else what is made now (and written, where there is a folder for it)."""
    if inputs.checkpoint:
        spark: SparkSession = inputs.entries.sparkSession
        path = f"{inputs.checkpoint.rstrip('/')}/{name}"
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            make().write.mode("overwrite").parquet(path)
        inputs.made[name] = spark.read.parquet(path)
    else:
        inputs.made[name] = make()
    return inputs.made[name]


def _hashed(inputs: Inputs) -> DataFrame:
    rows = inputs.entries.withColumn("entry_hash", text.entry_hash(F.col("link"), F.col("published_raw")))
    return rows if "ord" in rows.columns else rows.withColumn("ord", F.sha2(F.concat_ws("|", "feed", "link", "title", "published_raw"), 256))


def candidates(inputs: Inputs) -> DataFrame:
    """Entries that no live cache row answers: structured ones as they are, with a confidence of 1 and categories read from their text where they have
    none, then others through the extractor (none without one)."""
    at = F.lit(inputs.now).cast("timestamp")
    _, misses = keyed.hits_and_misses(_hashed(inputs), inputs.seen, ["feed", "entry_hash"], at)
    known = misses.join(inputs.feeds.select("feed", "structured_ingest"), "feed", "left")
    kind = F.col("source_type").isin("api", "ical") | ((F.col("source_type") == "scrape") & F.coalesce("structured_ingest", F.lit(False)))
    there = [F.coalesce(text.strip(F.col(c)), F.lit("")) != "" for c in ("title", "venue", "city", "published_raw")]
    whole = there[0] & there[1] & there[2] & there[3] & text.is_http_url(F.col("link"))
    routed = known.withColumn("bypass", F.coalesce(kind & whole, F.lit(False)))
    columns = ["feed", "title", "date", "time", "venue", "city", "url", "price", "description", "categories", "extraction_confidence", "ord"]
    none = F.lit(None).cast("string")
    kinds = F.when(F.size("categories") > 0, F.col("categories")).otherwise(categories.infer(F.col("title"), F.col("description")))
    structured = routed.where("bypass").select(
        "feed", "title", F.col("published_raw").alias("date"), none.alias("time"), "venue", "city", F.col("link").alias("url"), none.alias("price"), "description",
        kinds.alias("categories"), F.lit(1.0).alias("extraction_confidence"), F.concat(F.lit("0"), "ord").alias("ord"),
    )
    if inputs.strategy is None:
        return structured.select(*columns)
    asked = keyed.first_rows(routed.where("not bypass"), "ord", inputs.max_extraction)
    extracted = enrich.extract(asked, inputs.strategy, carry=("ord",)).withColumn("ord", F.concat(F.lit("1"), "ord"))
    return structured.select(*columns).unionByName(extracted.select(*columns))


def events(inputs: Inputs, found: DataFrame) -> DataFrame:
    """What the cache keeps of seen entries, then normalised events; duplicates merged, quality scored."""
    rows = normalize.normalize(found, inputs.feeds, inputs.now, inputs.horizon_days, carry=("ord",)).drop("time_dropped")
    rows = rows.withColumn("ord", F.concat_ws("|", F.lit("1"), "ord", F.date_format("start", "yyyyMMddHHmmss")))
    if inputs.seen_events is not None:
        at = F.lit(inputs.now).cast("timestamp")
        hits = keyed.hits_and_misses(_hashed(inputs), inputs.seen, ["feed", "entry_hash"], at)[0].select("feed", "entry_hash", F.concat(F.lit("0|"), "ord").alias("ord"))
        kept = inputs.seen_events.join(hits, ["feed", "entry_hash"])
        rows = kept.select(*rows.columns).unionByName(rows)
    rows = rows.withColumn("event_date", F.to_date("start"))
    merged = dedup.merge(rows.join(dedup.clusters(rows), "event_id"), "cluster")
    signals = scoring.quality_signals(*(F.col(c) for c in ("title", "description", "venue", "start", "end", "categories", "url", "price_cents", "is_free")))
    return merged.withColumn("description_quality", scoring.quality(signals)).withColumn("low_information", F.col("description_quality") < vocab.LOW_INFORMATION_BELOW)


def filtered(inputs: Inputs, rows: DataFrame) -> DataFrame:
    """Events with enough information that start within the horizon."""
    low = F.lit(inputs.now).cast("timestamp")
    return rows.where(~F.col("low_information") & F.col("start").between(low, low + F.make_dt_interval(days=F.lit(inputs.horizon_days))))


def enriched(inputs: Inputs, rows: DataFrame) -> DataFrame:
    """Events with vibe tags, performers, neighbourhood and vector, as far as there are strategies for them. Venues are asked once each."""
    none = F.lit(None)
    if inputs.vibes:
        prompt = F.concat_ws("\n", "title", "description", F.array_join("categories", ", "))
        rows = enrich.complete(rows, prompt, inputs.vibes, "vibe_tags array<string>").withColumn("vibe_tags", categories.validate_vibes(F.col("answer.vibe_tags"))).drop("answer")
    else:
        rows = rows.withColumn("vibe_tags", none.cast("array<string>"))
    if inputs.performers:
        names = text.performer_names(F.col("title"), F.col("description"))
        answer = "performers array<struct<name:string,confidence:double,affinity_score:double,one_line_summary:string>>"
        rows = enrich.complete(rows, F.when(F.size(names) > 0, F.array_join(names, "\n")), inputs.performers, answer)
        rows = rows.withColumn("performers", enrich.prepare_performers(F.col("answer.performers"))).drop("answer")
    else:
        rows = rows.withColumn("performers", none.cast("array<struct<name:string,confidence:double,affinity_score:double,one_line_summary:string>>"))
    if inputs.neighborhoods:
        rows = enrich.complete(rows, F.concat_ws("|", F.lower("venue"), F.lower("city")), inputs.neighborhoods, "neighborhood string, confidence double")
        rows = rows.withColumn("neighborhood", enrich.clear_unsure(F.col("answer.neighborhood"), F.col("answer.confidence"))).drop("answer")
    else:
        rows = rows.withColumn("neighborhood", none.cast("string"))
    rows = rows.withColumn("vibe_tags", F.coalesce("vibe_tags", F.array().cast("array<string>"))).withColumn("top_affinity", enrich.top_affinity(F.col("performers")))
    if inputs.embed:
        turn = F.udf(inputs.embed, "array<double>", useArrow=True)
        named = F.coalesce(F.transform("performers", lambda p: p["name"]), F.array().cast("array<string>"))
        return rows.withColumn("embedding", turn(text.embedding_text(F.col("title"), F.col("description"), F.col("categories"), F.col("vibe_tags"), named)))
    return rows.withColumn("embedding", none.cast("array<double>"))


def add_liked(liked: DataFrame, rows: DataFrame) -> DataFrame:
    """The liked vectors (user_id, event_id, embedding) after new ones; the last of an event holds."""
    both = liked.withColumn("_at", F.lit(0)).unionByName(rows.select("user_id", "event_id", "embedding").withColumn("_at", F.lit(1)))
    return keyed.latest_per_key(both, ["user_id", "event_id"], "_at").drop("_at")


def ranked(inputs: Inputs, rows: DataFrame) -> DataFrame:
    """Events of each user's city, scored and ranked, without what they exclude or were given within 14 days."""
    at = F.lit(inputs.now).cast("timestamp")
    last = inputs.history.groupBy("user_id", "event_id").agg(F.max("recommended_at").alias("last_at"))
    at_home = inputs.profiles.withColumn("_city", F.lower(F.trim(F.col("home_city"))))
    pairs = groups.spread_join(rows.withColumn("_city", F.lower("city")), at_home, ["_city"], "user_id").join(last, ["user_id", "event_id"], "left")
    days = (F.unix_micros(at) - F.unix_micros(F.col("last_at").cast("timestamp"))) / 86_400e6
    pairs = pairs.where(~enrich.excluded(F.col("categories"), F.col("excluded_categories")) & F.coalesce(days > vocab.HARD_RECENCY_DAYS, F.lit(True)))
    none = F.array().cast("array<string>")
    if inputs.liked is not None:  # a user's liked events are few; the greatest of their cosines counts
        alike = pairs.select("user_id", "event_id", "embedding").join(inputs.liked.select("user_id", F.col("embedding").alias("other")), "user_id")
        alike = alike.groupBy("user_id", "event_id").agg(F.max(scoring.cosine(F.col("embedding"), F.col("other"))).alias("similarity"))
        pairs = pairs.join(alike, ["user_id", "event_id"], "left")
    else:
        pairs = pairs.withColumn("similarity", F.lit(None).cast("double"))
    parts = {
        "category_fit": scoring.category_fit(F.col("categories"), F.col("category_weights"), none),
        "vibe_fit": scoring.vibe_fit(F.col("vibe_tags"), F.col("vibe_preferences")),
        "semantic_similarity": scoring.clamp(F.coalesce("similarity", F.lit(0.0))),
        "performer_affinity": scoring.clamp(F.col("top_affinity")),
        "location": scoring.location_fit(F.col("neighborhood"), F.col("preferred_neighborhoods")),
        "novelty": scoring.novelty(days, F.col("categories"), F.transform("category_weights", lambda w: F.lower(text.strip(w["key"]))), F.col("vibe_tags"), F.col("vibe_preferences")),
        "source_quality": scoring.clamp(F.col("source_quality")),
        "source_coverage": scoring.source_coverage(F.col("source_count")),
        "description_quality": scoring.clamp(F.col("description_quality")),
    }
    scored = pairs.select("user_id", "event_id", "ord", "title", "venue", "categories", "event_date", "start", "price_cents", "is_free", "description", "top_affinity", F.struct(*(c.alias(n) for n, c in parts.items())).alias("breakdown"))
    scored = scored.withColumn("score", scoring.rank_score({n: F.col("breakdown")[n] for n in parts})).withColumn("novelty", F.col("breakdown.novelty"))
    out = select.ranked(scored)
    out = out.withColumn("wildcard", select.wildcards(out))
    risk = scoring.risk_score(scoring.risk_parts(F.col("venue"), F.col("price_cents"), F.col("is_free"), F.col("start"), F.col("description"), F.col("top_affinity"), at))
    return out.withColumn("sellout_risk", scoring.risk_band(risk))


def picks(inputs: Inputs, rows: DataFrame) -> DataFrame:
    """Each user's list, with the reason and the token of each pick; explanations are made for picks only."""
    keyed_rows = rows.withColumn("venue", text.venue_group_key(F.col("venue")))
    chosen = select.curate(keyed_rows)
    back = chosen.join(rows.select("user_id", "event_id", "title", "start", "sellout_risk"), ["user_id", "event_id"])
    return back.withColumn("explanation", enrich.fallback_explanation(F.col("title"))).withColumn("token", F.sha2(F.concat_ws(":", F.lit(inputs.now), "user_id", "event_id"), 256))


def run(inputs: Inputs, stop_after: str = "picks") -> DataFrame:
    """The table of the stage ``stop_after`` (one of ``STAGES``); all stages' tables are in ``inputs.made``."""
    if stop_after not in STAGES:
        raise ValueError(f"stages: {', '.join(STAGES)}")
    makers = {"entries": lambda _: inputs.entries, "candidates": lambda _: candidates(inputs), "events": lambda x: events(inputs, x), "filtered": lambda x: filtered(inputs, x), "enriched": lambda x: enriched(inputs, x), "ranked": lambda x: ranked(inputs, x), "picks": lambda x: picks(inputs, x)}
    table = inputs.entries
    for name in STAGES:
        before = table
        table = _kept(inputs, name, lambda m=makers[name], x=before: m(x))
        if name == stop_after:
            break
    return table


def funnel(inputs: Inputs) -> dict[str, int]:
    """Rows of each stage that was made."""
    return {name: df.count() for name, df in inputs.made.items()}
