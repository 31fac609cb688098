"""Text, URL, price and hash expressions, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; trim() takes spaces only. A run of white space is tried once, from its start."""
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


#: marks that end a venue's name, and amounts in a price. Fixed values.
TRAILING_MARKS, DOLLARS = r"[.,;:!?]+$", r"\$(\d+(?:\.\d{2})?)"


def clean_venue(c: Column) -> Column:
    """Ends stripped, trailing marks dropped, inner white space collapsed; empty becomes null."""
    return empty_to_null(strip(collapse(F.regexp_replace(strip(c), TRAILING_MARKS, ""))))


def venue_key(c: Column) -> Column:
    return F.lower(strip(c))


def venue_group_key(c: Column) -> Column:
    """The selector's key: white space collapsed, empty becomes ``unknown``."""
    return F.coalesce(empty_to_null(F.lower(strip(collapse(c)))), F.lit("unknown"))


def is_http_url(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def is_free(price: Column) -> Column:
    p = F.lower(strip(price))
    return F.coalesce(p.isin(*vocab.FREE_PRICES) | p.contains("donation"), F.lit(False))


def price_cents(price: Column) -> Column:
    """Cents of the first dollar amount; null where there is none, or where the price says free."""
    amount = empty_to_null(F.regexp_extract(F.coalesce(price, F.lit("")), DOLLARS, 1))
    return F.when(~is_free(price), F.round(amount.cast("decimal(18,2)") * 100).cast("int"))


def sha256(*parts: Column) -> Column:
    """Of the parts one after the other, without separators; null parts are empty."""
    return F.sha2(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), 256)


def entry_hash(link: Column, published_raw: Column) -> Column:
    return sha256(link, published_raw)


def event_id(title: Column, date: Column, venue: Column) -> Column:
    return sha256(title, date, venue)


def user_id(email: Column) -> Column:
    return F.sha2(F.lower(strip(email)), 256)


def vibe_hash(description: Column, categories: Column) -> Column:
    """SHA-256 of the description and the compact JSON list of the sorted categories (ASCII categories)."""
    return F.sha2(F.concat(description, F.to_json(F.array_sort(categories))), 256)


def with_schedule(description: Column, date: Column, time: Column) -> Column:
    """The description with the schedule's own words, unless it holds them already."""
    d, t = strip(F.coalesce(date, F.lit(""))), strip(F.coalesce(time, F.lit("")))
    schedule = F.when(t == "", d).otherwise(F.concat_ws(" ", d, t))
    line = F.concat(F.lit("Schedule: "), schedule)
    text = strip(description)
    return F.when((d == "") | description.contains(schedule), description).when(text == "", line).otherwise(F.concat(text, F.lit("\n\n"), line))


def price_label(free: Column, cents: Column) -> Column:
    return F.when(free, "Free").when(cents.isNotNull(), F.format_string("$%.2f", cents / 100))


def time_label(start: Column, end: Column) -> Column:
    """``Fri, Jun 05 · 7:30 PM UTC``, and the end after a dash where it is on another day (UTC)."""
    one = lambda c: F.replace(F.date_format(c, "EEE, MMM dd · hh:mm a 'UTC'"), F.lit(" 0"), F.lit(" "))
    return F.when(end.isNull() | (F.to_date(end) == F.to_date(start)), one(start)).otherwise(F.concat(one(start), F.lit(" – "), one(end)))


def parse_token(raw: Column) -> Column:
    """A feedback token in its usual form, or null: 32 hex digits, with or without hyphens, braces and a ``urn:uuid:`` before them."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(strip(raw)), "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", "")
    parts = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


def parse_signal(raw: Column, expected: str) -> Column:
    return F.when(F.lower(strip(raw)) == expected, F.lit(expected))


def embedding_text(title: Column, description: Column, *lists: Column) -> Column:
    """What stands for an event when it is embedded: title, description and the lists' items, parts without text left out."""
    parts = [title, description, *(F.array_join(x, " ") for x in lists)]
    return F.concat_ws(" ", *(F.nullif(strip(p), F.lit("")) for p in parts))


def tracking_url(token: Column, redirect: Column, base: str) -> Column:
    """Percent-encoding of form values; ``~`` stays and ``*`` is encoded."""
    enc = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit(base.rstrip("/") + "/track?token="), enc(token), F.lit("&redirect="), enc(redirect))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def parse_run_id(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyyMMdd-HHmmss"))


#: patterns of performer names, as detection and extraction see them. Fixed values. A name may go on for the whole text: it is taken by a possessive loop, since
#: Java keeps a stack frame for each word of one that could be given back, which in a long text ends the executor
NAMED_PERFORMER = (
    r"(?iU)\b(?:featuring|feat\.?|starring|presents|presented by)\s+([A-Z][\w'-]+(?:\s+[A-Z][\w'-]+)*+)",
    r"(?iU)\bwith\s+(?:special guest\s+)?([A-Z][\w'-]+(?:\s+[A-Z][\w'-]+)*+)",
    r"(?iU)\bDJ\s+([A-Z][\w'-]+)",
)
PERFORMER_NAMES = (
    r"(?iU)\b(?:featuring|feat\.?|starring|presents|presented by)\s+([A-Z][\w'-]+(?:\s+[A-Z][\w'-]+)?)",
    r"(?iU)\bwith special guest\s+([A-Z][\w'-]+(?:\s+[A-Z][\w'-]+)?)",
    r"(?iU)\bDJ\s+([A-Z][\w'-]+)",
)


def names_performer(title: Column, description: Column) -> Column:
    """Whether the first match of some pattern is more than a generic phrase."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit("")))
    found = F.lit(False)
    for pattern in NAMED_PERFORMER:
        name = F.lower(strip(F.regexp_extract(text, pattern, 1)))
        generic = F.lit(False)
        for phrase in vocab.GENERIC_PERFORMERS:
            generic = generic | (name == phrase) | name.startswith(phrase + " ")
        found = found | ((name != "") & ~generic)
    return found


def performer_names(title: Column, description: Column) -> Column:
    """All names, pattern by pattern in order of place, each once by its key."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit("")))
    found = F.filter(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in PERFORMER_NAMES)), lambda x: strip(x) != "")
    names = F.transform(found, strip)
    keys = F.transform(names, performer_key)
    return F.filter(names, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def performer_key(c: Column) -> Column:
    return F.lower(strip(collapse(c)))
