"""Category and vibe expressions, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import collapse, strip


def _lookup() -> Column:
    known = {c.lower(): c for c in vocab.CATEGORIES} | vocab.CATEGORY_ALIASES
    return F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))


def standardize(labels: Column) -> Column:
    """Labels mapped to the vocabulary, in order, each once; unknown ones dropped."""
    known = _lookup()
    mapped = F.transform(labels, lambda x: F.try_element_at(known, F.lower(strip(x))))
    return F.array_distinct(F.filter(mapped, lambda x: x.isNotNull()))


def infer(title: Column, description: Column, labels: Column | None = None) -> Column:
    """Categories of the labels, then those whose keywords stand in the text."""
    parts = [F.nullif(collapse(F.lower(strip(c))), F.lit("")) for c in (title, description)]
    text = F.concat_ws(" ", *parts)
    found = []
    for category, words in vocab.CATEGORY_KEYWORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        found.append(F.when(hit, F.lit(category)))
    inferred = F.filter(F.array(*found), lambda x: x.isNotNull())
    return inferred if labels is None else F.array_union(standardize(F.transform(labels, collapse)), inferred)


def validate_vibes(tags: Column) -> Column:
    """Distinct tags where 2 to 5 were given, all known, and at least 2 are distinct; else null."""
    known = F.forall(tags, lambda t: t.isin(*vocab.VIBES))
    distinct = F.array_distinct(tags)
    ok = F.size(tags).between(vocab.MIN_VIBES, vocab.MAX_VIBES) & known & (F.size(distinct) >= vocab.MIN_VIBES)
    return F.when(ok, distinct)
