"""Quality, ranking, risk and recency scores as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import collapse, is_http_url, names_performer, strip


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


# ---- listing quality ----


def quality_signals(title, description, venue, start, end, categories, url, cents, free) -> dict[str, Column]:
    n = F.length(strip(F.coalesce(description, F.lit(""))))
    v = F.lower(strip(venue))
    midnight = (F.hour(start) == 0) & (F.minute(start) == 0) & (F.second(start) == 0)
    return {
        "description_length": F.when(n == 0, 0.0).when(n < 50, 0.3).when(n < 150, 0.7).otherwise(1.0),
        "venue_presence": F.when(v.isNull() | (v == "") | v.isin(*vocab.GENERIC_VENUES), 0.0).otherwise(1.0),
        "date_time_present": F.when(start.isNull(), 0.0).when(end.isNotNull(), 1.0).when(midnight, 0.5).otherwise(1.0),
        "performer_named": F.when(names_performer(title, description), 1.0).otherwise(0.0),
        "category_coverage": F.when(F.exists(categories, lambda c: ~F.lower(strip(c)).isin(*vocab.GENERIC_CATEGORIES)), 1.0).otherwise(0.0),
        "url_validity": F.when(is_http_url(url), 1.0).otherwise(0.0),
        "price_clarity": F.when(F.coalesce(free, F.lit(False)) | cents.isNotNull(), 1.0).otherwise(0.0),
    }


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + parts[name] * F.lit(weight)
    return total


def quality(signals: dict[str, Column]) -> Column:
    return F.round(weighted(signals, vocab.QUALITY_WEIGHTS), 4)


# ---- ranking ----


def label(c: Column) -> Column:
    return F.lower(strip(c))


def labels(c: Column) -> Column:
    """Labels of an array as ``matches`` compares them; worth doing once per row before rows meet in a join."""
    return F.transform(c, label)


def matches(a: Column, b: Column, plain: bool = False) -> Column:
    """Either label holds the other, case and outer white space aside; ``plain`` labels are normalised already."""
    x, y = (a, b) if plain else (label(a), label(b))
    return x.contains(y) | y.contains(x)


def category_fit(categories: Column, weights: Column, interests: Column, plain: bool = False) -> Column:
    """Mean weight of each category's first matching key; without weights the share of categories with a stated interest;
    without either 0.5. ``weights``: array of struct<key, weight>, in order."""
    hits = F.filter(F.transform(categories, lambda c: F.get(F.filter(weights, lambda w: matches(c, w["key"], plain)), 0)["weight"]), lambda x: x.isNotNull())
    # sum and number in one pass: what names ``hits`` twice works it out twice
    nothing = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    by_weight = F.aggregate(hits, nothing, lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] == 0, 0.0).otherwise(a["sum"] / a["n"]))
    share = F.size(F.filter(categories, lambda c: F.exists(interests, lambda i: matches(c, i, plain)))) / F.size(categories)
    return F.when(F.size(categories) <= 0, 0.0).when(F.size(weights) > 0, clamp(by_weight)).when(F.size(interests) > 0, clamp(share)).otherwise(vocab.NEUTRAL_FIT)


def vibe_fit(tags: Column, preferred: Column) -> Column:
    have = F.size(tags) > 0
    overlap = F.size(F.array_intersect(tags, preferred)) / F.size(F.array_distinct(preferred))
    return F.when(F.size(preferred) <= 0, F.when(have, vocab.NEUTRAL_FIT).otherwise(0.0)).when(~have, 0.0).otherwise(clamp(overlap))


def location_fit(neighborhood: Column, preferred: Column, plain: bool = False) -> Column:
    n = F.coalesce(neighborhood, F.lit("")) if plain else label(F.coalesce(neighborhood, F.lit("")))
    near = F.exists(preferred, lambda p: matches(n, p if plain else label(p), True))
    return F.when(F.size(preferred) <= 0, vocab.NEUTRAL_FIT).when((n != "") & near, 1.0).otherwise(0.0)


def recency_factor(days: Column) -> Column:
    """0.5 up to the hard limit, back to 1 at the soft one, exponentially between."""
    rate = -math.log(1 - vocab.NOVELTY_RECOVERY) / (vocab.SOFT_RECENCY_DAYS - vocab.HARD_RECENCY_DAYS)
    back = 1 - F.exp(F.lit(-rate) * (days - vocab.HARD_RECENCY_DAYS))
    floor = vocab.NOVELTY_FLOOR
    return F.when(days.isNull() | (days >= vocab.SOFT_RECENCY_DAYS), 1.0).when(days <= vocab.HARD_RECENCY_DAYS, floor).otherwise(floor + (1 - floor) * back)


def novelty(days: Column, categories: Column, known_categories: Column, vibes: Column, known_vibes: Column, plain: bool = False) -> Column:
    unseen = F.exists(categories, lambda c: ~F.array_contains(known_categories, c if plain else label(c))) | F.exists(vibes, lambda v: ~F.array_contains(known_vibes, v))
    factor = recency_factor(days)
    return F.when(unseen, clamp(factor + vocab.UNSEEN_BONUS)).otherwise(factor)


def source_coverage(count: Column) -> Column:
    return F.when(count < 1, 0.0).otherwise(clamp(count / vocab.SOURCE_COVERAGE_MAX))


def rank_score(parts: dict[str, Column]) -> Column:
    return clamp(weighted(parts, vocab.RANK_WEIGHTS))


def recency_band(days: Column) -> Column:
    return F.when(days.isNull() | (days > vocab.SOFT_RECENCY_DAYS), "none").when(days <= vocab.HARD_RECENCY_DAYS, "hard").otherwise("soft")


def soft_recency(score: Column, days: Column) -> Column:
    """Lowered in the soft band, else as it is."""
    return F.when(recency_band(days) == "soft", clamp(score * vocab.SOFT_RECENCY_MULTIPLIER)).otherwise(score)


# ---- sell-out risk ----


def _any(text: Column, tokens: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for t in tokens:
        hit = hit | text.contains(t)
    return hit


def venue_size(venue: Column) -> Column:
    v = strip(collapse(F.lower(F.coalesce(venue, F.lit("")))))
    return F.when(_any(v, vocab.LARGE_VENUES), "large").when(_any(v, vocab.SMALL_VENUES), "small").when(_any(v, vocab.MEDIUM_VENUES), "medium").otherwise("unknown")


def risk_parts(venue, cents, free, start, description, affinity, now) -> dict[str, Column]:
    size = venue_size(venue)
    pressure = F.lit(None).cast("double")
    for kind, value in vocab.VENUE_PRESSURE.items():
        pressure = F.when(size == kind, value).otherwise(pressure)
    days = (F.unix_micros(start.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 86_400e6
    text = strip(collapse(F.lower(F.coalesce(description, F.lit("")))))
    high = sum((text.contains(p).cast("int") for p in vocab.HIGH_URGENCY), F.lit(0))
    low = sum((text.contains(p).cast("int") for p in vocab.LOW_URGENCY), F.lit(0))
    return {
        "venue_size": pressure,
        "price": F.when(free | (cents <= 0), 0.85).when(cents.isNull(), 0.50).when(cents < 2000, 0.75).when(cents < 6000, 0.55).otherwise(0.35),
        "date_proximity": F.when(days < 0, 0.20).when(days <= 2, 0.95).when(days <= 7, 0.75).when(days <= 14, 0.55).when(days <= 30, 0.40).otherwise(0.25),
        "description_language": F.when((text == "") | ((high == 0) & (low == 0)), 0.50).when(high >= low, clamp(0.55 + 0.15 * high)).otherwise(clamp(0.45 - 0.10 * low)),
        "performer_affinity": clamp(affinity),
    }


def risk_score(parts: dict[str, Column]) -> Column:
    return clamp(weighted(parts, vocab.RISK_WEIGHTS))


def risk_band(score: Column) -> Column:
    return F.when(score >= vocab.RISK_HIGH, "high").when(score >= vocab.RISK_MEDIUM, "medium").otherwise("low")


# ---- vectors, decay ----


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ, or one is empty or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def feedback_decay(age_days: Column) -> Column:
    return F.exp(F.lit(-math.log(2) / vocab.HALF_LIFE_DAYS) * F.greatest(F.lit(0.0), age_days))
