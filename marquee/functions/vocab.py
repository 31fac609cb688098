"""Controlled vocabularies and policy constants. Results depend on them."""

from __future__ import annotations

CATEGORIES = ("Art", "Classical", "Comedy", "Community", "Country", "Dance", "Education", "Electronic", "Family", "Fashion", "Film", "Folk", "Food", "Hip-Hop", "Jazz", "Literature", "Music", "Nightlife", "Outdoor", "Rock", "Sports", "Technology", "Theater", "Wellness")

#: label in lower case -> category
CATEGORY_ALIASES = {
    "art": "Art", "arts": "Art", "baseball": "Sports", "comedy": "Comedy", "community": "Community", "concert": "Music", "concerts": "Music",
    "country": "Country", "dance": "Dance", "education": "Education", "electronic": "Electronic", "family": "Family", "fashion": "Fashion",
    "film": "Film", "films": "Film", "food": "Food", "hip hop": "Hip-Hop", "hip-hop": "Hip-Hop", "indie": "Film", "independent": "Film",
    "jazz": "Jazz", "legends": "Community", "literature": "Literature", "music": "Music", "nightlife": "Nightlife", "outdoor": "Outdoor",
    "pool": "Outdoor", "rock": "Rock", "sport": "Sports", "sports": "Sports", "tech": "Technology", "technology": "Technology",
    "theater": "Theater", "theatre": "Theater", "wellness": "Wellness",
}

#: (category, keywords of which one in the text is enough), in order
CATEGORY_KEYWORDS = (
    ("Comedy", ("comedy", "stand-up", "standup", "improv", "open mic")),
    ("Jazz", ("jazz", "bebop", "swing night")),
    ("Classical", ("classical", "orchestra", "symphony", "philharmonic")),
    ("Theater", ("theater", "theatre", "broadway", "musical", "playwright")),
    ("Dance", ("dance", "ballet", "club night", "dj set", "techno", "house music")),
    ("Sports", ("sports", "baseball", "basketball", "soccer", "marathon", "game")),
    ("Film", ("film", "screening", "cinema", "movie")),
    ("Art", ("art", "gallery", "museum", "exhibition")),
    ("Food", ("food", "tasting", "brunch", "dinner series")),
    ("Nightlife", ("nightlife", "club", "late night", "afterparty")),
    ("Music", ("concert", "live music", "band", "tour", "festival", "show")),
)

VIBES = ("intimate", "high-energy", "experimental", "social", "introspective", "outdoor", "late-night", "family-friendly", "industry", "touristy", "immersive", "underground", "high-production", "free-spirited", "niche", "single-friendly", "pretentious", "exclusive", "inclusive")
MIN_VIBES, MAX_VIBES = 2, 5

GENERIC_VENUES = ("tba", "tbd", "venue", "location", "online", "various", "n/a", "los angeles", "la")
GENERIC_CATEGORIES = ("event", "events", "general", "other", "misc", "uncategorized")
GENERIC_PERFORMERS = ("local artists", "local artist", "special guests", "special guest", "the dj", "various artists", "tba")
FREE_PRICES = ("free", "no cover", "gratis", "complimentary")
ENTITY_TYPES = ("musician", "band", "filmmaker", "speaker", "artist", "other")

#: seven signals of a listing's quality and their weights
QUALITY_WEIGHTS = {"description_length": 0.20, "venue_presence": 0.20, "date_time_present": 0.20, "performer_named": 0.15, "category_coverage": 0.10, "url_validity": 0.10, "price_clarity": 0.05}
LOW_INFORMATION_BELOW = 0.3

#: nine parts of the ranking score and their weights
RANK_WEIGHTS = {"category_fit": 0.20, "vibe_fit": 0.15, "semantic_similarity": 0.10, "performer_affinity": 0.10, "location": 0.10, "novelty": 0.10, "source_quality": 0.05, "source_coverage": 0.05, "description_quality": 0.15}
SOURCE_COVERAGE_MAX = 3
NEUTRAL_FIT = 0.5

HARD_RECENCY_DAYS, SOFT_RECENCY_DAYS = 14, 28
SOFT_RECENCY_MULTIPLIER = 0.75
NOVELTY_FLOOR, NOVELTY_RECOVERY, UNSEEN_BONUS = 0.5, 0.95, 0.2
WILDCARD_SLOTS, WILDCARD_SCORES, WILDCARD_MIN_NOVELTY = 2, (0.35, 0.65), 0.6

LARGE_VENUES = ("arena", "stadium", "coliseum", "amphitheater", "amphitheatre", "bowl", "convention center", "fairgrounds")
SMALL_VENUES = ("club", "bar", "lounge", "cafe", "gallery", "basement", "attic", "studio", "pub", "speakeasy", "backyard", "house")
MEDIUM_VENUES = ("theater", "theatre", "hall", "ballroom", "auditorium", "museum", "center", "centre", "park")
VENUE_PRESSURE = {"large": 0.25, "medium": 0.55, "small": 0.90, "unknown": 0.50}
HIGH_URGENCY = ("limited tickets", "selling fast", "almost sold out", "few tickets", "last chance", "selling out", "limited availability", "final release", "going fast", "nearly sold out")
LOW_URGENCY = ("plenty of seating", "tickets available", "no cover", "walk-up welcome")
RISK_WEIGHTS = {"venue_size": 0.25, "price": 0.15, "date_proximity": 0.25, "description_language": 0.20, "performer_affinity": 0.15}
RISK_HIGH, RISK_MEDIUM = 0.62, 0.38
URGENCY_NOTE = "Tickets may sell out quickly."

CLICK_DELTA, NEGATIVE_DELTA, HALF_LIFE_DAYS, VIBE_MIN_DECAY = 0.03, -0.05, 30, 0.5
HORIZON_DAYS, MAX_OCCURRENCES = 14, 5
CACHE_TTL_DAYS = {"seen_entries": 14, "performer_cache": 90, "venue_geo": 90, "venue_context": 30, "vibe_cache": 14}
MAX_PICKS, MAX_PER_CATEGORY, MAX_PER_VENUE, MIN_DATES, MIN_WILDCARDS, MAX_WILDCARDS = 10, 3, 2, 2, 1, 2
