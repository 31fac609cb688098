"""Enrichment: pluggable expensive functions over rows, tolerant reading of their answers, small text builders."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import strip

Strategy = Callable[[str], str]


class Unavailable(RuntimeError):
    """What a strategy raises when nothing can be answered at all (no account, no network): the run fails instead of going on."""


def insistent(strategy: Strategy, attempts: int = 3, first_delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Strategy:
    """Asks again after a failure, waiting twice as long each time. ``Unavailable`` and the last failure are passed on."""

    def ask(prompt: str) -> str:
        for attempt in range(attempts):
            try:
                return strategy(prompt)
            except Unavailable:
                raise
            except Exception:  # noqa: BLE001 - whatever it was may have passed by the next attempt
                if attempt == attempts - 1:
                    raise
                sleep(first_delay * 2**attempt)
        raise ValueError("attempts is 1 or more")

    return ask


def throttled(strategy: Strategy, per_second: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Strategy:
    """At most so many calls a second from one process; with ``parallel=1`` below that holds for the whole run."""
    last = [float("-inf")]

    def ask(prompt: str) -> str:
        wait = last[0] + 1 / per_second - clock()
        if wait > 0:
            sleep(wait)
        last[0] = clock()
        return strategy(prompt)

    return ask


def render(template: str, **values: object) -> str:
    """``{{ name }}`` replaced by its value; a name without a value is an error, not an empty text."""

    def put(found: re.Match) -> str:
        if found[1] not in values:
            raise KeyError(f"no value for {found[1]}")
        return str(values[found[1]])

    return re.sub(r"\{\{\s*(\w+)\s*\}\}", put, template)


def complete(rows: DataFrame, prompt: Column, strategy: Strategy, schema: str, column: str = "answer", parallel: int | None = None) -> DataFrame:
    """Ask a strategy (a model client, a rule, a stub) once per distinct prompt and read its answer as JSON of ``schema``.

    A strategy that raises (see ``insistent`` for attempts), or an answer that can't be read, leaves a null; ``Unavailable`` fails the run. Equal
    prompts are asked once and the answer is joined back, so repeated work is not paid for twice. ``parallel`` bounds the
    tasks that ask at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["prompt"]:
                try:
                    out.append(strategy(text))
                except Unavailable:
                    raise
                except Exception:  # noqa: BLE001 - one failed answer must not stop the others
                    out.append(None)
            yield pdf.assign(raw=out)

    asked = rows.withColumn("_prompt", prompt)
    prompts = asked.select(F.col("_prompt").alias("prompt")).where("prompt is not null").distinct()
    answers = (prompts if parallel is None else prompts.repartition(parallel)).mapInPandas(run, "prompt string, raw string")
    parsed = answers.select(F.col("prompt").alias("_prompt"), F.from_json(json_text(F.col("raw")), schema).alias(column))
    return asked.join(parsed, "_prompt", "left").drop("_prompt")


def json_text(raw: Column) -> Column:
    """The answer itself where it is JSON, else what a code fence in it holds."""
    fence = "`" * 3
    inner = F.trim(F.regexp_extract(raw, rf"(?s){fence}(?:json)?\s*\n?(.*?)\n?{fence}", 1))
    return F.when(F.try_parse_json(raw).isNotNull(), raw).otherwise(F.nullif(inner, F.lit("")))


def extract(entries: DataFrame, strategy: Strategy, carry: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of unstructured entries, with the columns ``carry`` of their entry; what is no event, or gave no readable answer, is dropped."""
    schema = "is_event boolean, title string, date string, time string, venue string, city string, url string, price string, description string, categories array<string>, extraction_confidence double"
    prompt = F.concat_ws("\n", "title", "description", "published_raw", "link")
    found = complete(entries, prompt, strategy, schema).where("answer.is_event")
    return found.select("feed", *carry, "answer.*").drop("is_event")


def clear_unsure(context: Column, confidence: Column, at_least: float = 0.5) -> Column:
    return F.when(confidence >= at_least, context)


def work_counts(todo: DataFrame, cache: DataFrame, key: str, by: list[str], coordinates: str, context: str) -> DataFrame:
    """Per group the places, and of these what the cache answers (a text is there), what must be located (no coordinates either) and what a model
    must be asked. Both tables have one row per key."""
    joined = todo.join(cache, key, "left")
    known, placed = F.col(context).isNotNull(), F.col(coordinates).isNotNull()
    return joined.groupBy(*by).agg(F.count("*").alias("venues"), F.count_if(known).alias("cache_hits"), F.count_if(~known & ~placed).alias("geocode_calls"), F.count_if(~known).alias("llm_calls"))


def prepare_performers(performers: Column, sure_from: float = 0.7) -> Column:
    """Performers (struct with confidence and one_line_summary) without the summaries of unsure ones."""
    return F.transform(performers, lambda p: p.withField("one_line_summary", F.when(p["confidence"] >= sure_from, p["one_line_summary"])))


def top_affinity(performers: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(performers, lambda p: p["affinity_score"])), F.lit(0.0))


def pois(payload: Column) -> Column:
    """array<struct<name, type>> of a map answer: named by name, brand or operator; kind by the first tag there is; each name
    once, whatever its case."""
    elements = F.from_json(payload, "elements array<struct<tags:map<string,string>,lat:double,lon:double>>")["elements"]

    def first(tags: Column, keys: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.nullif(F.try_element_at(tags, F.lit(k)), F.lit("")) for k in keys))

    named = F.transform(elements, lambda e: F.struct(first(e["tags"], ("name", "brand", "operator")).alias("name"), F.coalesce(first(e["tags"], ("amenity", "tourism", "shop", "leisure", "historic", "building")), F.lit("place")).alias("type")))
    named = F.filter(named, lambda x: x["name"].isNotNull())
    keys = F.transform(named, lambda x: F.lower(x["name"]))
    return F.filter(named, lambda x, i: F.array_position(keys, F.lower(x["name"])) == i + 1)


def coordinate_key(lat: Column, lon: Column) -> Column:
    return F.format_string("coord:%.5f:%.5f", lat, lon)


def profile_summary(**parts: Column) -> Column:
    """``Interests: a, b; Vibe preferences: c``, empty parts left out. Keyword order is kept; names lose their underscores."""
    lines = [F.when(F.size(c) > 0, F.concat(F.lit(name.replace("_", " ").capitalize() + ": "), F.array_join(c, ", "))) for name, c in parts.items()]
    return F.coalesce(F.nullif(F.concat_ws("; ", *lines), F.lit("")), F.lit("General event discovery"))


#: fixed value: the sentence that follows an event's title
EXPLANATION = " looks worth your time this week based on your profile signals."


def fallback_explanation(title: Column) -> Column:
    return F.concat(title, F.lit(EXPLANATION))


def fallback_description(description: Column, explanation: Column, title: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(F.nullif(strip(description), F.lit("")), F.nullif(strip(explanation), F.lit("")), title)


def align_descriptions(answers: Column, fallbacks: Column) -> Column:
    """One text per pick: the answer at its place where it isn't blank, else the fallback."""
    return F.transform(fallbacks, lambda f, i: F.coalesce(F.nullif(strip(F.get(answers, i)), F.lit("")), f))


def invalid_profile(rows: DataFrame) -> Column:
    """Why a profile breaks the rules; null if it doesn't."""
    unknown = F.size(F.array_except("vibe_preferences", F.array(*(F.lit(v) for v in vocab.VIBES)))) > 0
    weights = F.exists("category_weights", lambda w: ~w["weight"].between(0, 1))
    return F.when(strip(F.col("home_city")) == "", "home_city").when(unknown, "vibe_preferences").when(weights, "category_weights").when(~F.col("horizon_days").between(1, 60), "horizon_days")


def excluded(categories: Column, unwanted: Column) -> Column:
    """Whether a category is one of those a user excludes, case and outer spaces aside."""
    lower = lambda c: F.transform(c, lambda x: F.lower(strip(x)))
    return F.coalesce(F.arrays_overlap(lower(categories), lower(unwanted)), F.lit(False))
