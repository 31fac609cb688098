"""Feed scans. Payloads (files or a column of bytes) become raw entries; one adapter per kind of source.

Payload files are read by Spark's own reader, so any store it knows works; each file is parsed in one Arrow-batched step,
and a payload that can't be parsed gives a health row instead of failing the others.
"""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from datetime import date, datetime, time, timedelta, timezone
from typing import Any
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import markup

ENTRY = "feed string, title string, link string, description string, published_raw string, author string, categories array<string>, enclosure_url string, venue string, city string, starts_at timestamp, ends_at timestamp"
_FIELDS = ("feed", "title", "link", "description", "published_raw", "author", "categories", "enclosure_url", "venue", "city", "starts_at", "ends_at")


def _text(value: Any) -> str | None:
    """Plain text of a value or of a ``{text: ...}`` object; blank is None."""
    if isinstance(value, dict):
        value = value.get("text")
    return (str(value).strip() or None) if value is not None else None


def _at(value: Any, *keys: str) -> Any:
    for k in keys:
        if not isinstance(value, dict):
            return None
        value = value.get(k)
    return value


# ---- RSS and Atom ----


def rss(payload: bytes, options: dict) -> Iterator[dict]:
    root = ET.fromstring(payload)
    tag = lambda e: e.tag.rpartition("}")[2]
    for item in root.iter():
        if tag(item) not in ("item", "entry"):
            continue
        got: dict[str, list] = {}
        for child in item:
            got.setdefault(tag(child), []).append(child)
        first = lambda *names: next((x for n in names for e in got.get(n, []) if (x := "".join(e.itertext()).strip())), None)  # noqa: E731, B023
        link = first("link") or next((e.get("href") for e in got.get("link", []) if e.get("href") and e.get("rel", "alternate") == "alternate"), None)
        inside = next((a for a in got.get("author", []) if len(a)), None)
        author = next((x.text for x in inside if tag(x) == "name"), None) if inside is not None else first("author", "creator")
        yield {
            "title": first("title"),
            "link": link,
            "description": first("encoded", "content") or first("description", "summary"),
            "published_raw": first("pubDate", "published"),
            "author": author,
            "categories": [x for e in got.get("category", []) if (x := (e.get("term") or e.text or "").strip())],
            "enclosure_url": next((e.get("url") for e in got.get("enclosure", [])), None),
        }


# ---- iCalendar ----


def _ical_time(value: str, params: dict[str, str]) -> tuple[datetime | None, bool]:
    """(UTC time, whether it is a whole day)."""
    try:
        if params.get("VALUE") == "DATE" or re.fullmatch(r"\d{8}", value):
            return datetime.combine(datetime.strptime(value, "%Y%m%d").date(), time(), timezone.utc), True
        found = datetime.strptime(value.rstrip("Z"), "%Y%m%dT%H%M%S")
        if not value.endswith("Z") and "TZID" in params:
            from dateutil import tz

            return found.replace(tzinfo=tz.gettz(params["TZID"]) or timezone.utc).astimezone(timezone.utc), False
        return found.replace(tzinfo=timezone.utc), False
    except ValueError:
        return None, False


def _last_second(day: date) -> datetime:
    return datetime.combine(day, time(23, 59, 59), timezone.utc)


def ical(payload: bytes, options: dict) -> Iterator[dict]:
    """VEVENTs; with ``now`` and ``horizon_days`` only those that overlap the horizon. A DATE end is exclusive."""
    text = re.sub(r"\r?\n[ \t]", "", payload.decode("utf-8", "replace"))
    if "BEGIN:VCALENDAR" not in text:
        raise ValueError("no calendar")
    window = None
    if options.get("now"):
        low = datetime.fromisoformat(options["now"]).replace(tzinfo=timezone.utc)
        window = low, low + timedelta(days=int(options.get("horizon_days", 14)))
    for block in re.findall(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT", text):
        props: dict[str, tuple[str, dict[str, str]]] = {}
        for line in block.splitlines():
            m = re.match(r'([A-Za-z-]+)((?:;[^=:;]+=(?:"[^"]*"|[^:;]*))*):(.*)', line)
            if m:
                params = {k.upper(): v.strip('"') for k, v in re.findall(r';([^=:;]+)=("[^"]*"|[^:;]*)', m[2])}
                props.setdefault(m[1].upper(), (m[3].strip(), params))
        value = lambda n: re.sub(r"\\([,;\\])", r"\1", props[n][0].replace("\\n", "\n")).strip() or None if n in props else None  # noqa: E731, B023
        start, whole = _ical_time(*props["DTSTART"]) if "DTSTART" in props else (None, False)
        end, end_whole = _ical_time(*props["DTEND"]) if "DTEND" in props else (None, False)
        if start is not None:
            if end is None:
                end = _last_second(start.date()) if whole and "DTEND" not in props else start
            elif end_whole:
                end = _last_second(end.date() - timedelta(days=1))
        if window and (start is None or not (start <= window[1] and end >= window[0])):
            continue
        shown = None if start is None else start.date().isoformat() if whole else start.isoformat()
        yield {
            "title": value("SUMMARY"), "link": value("URL"), "description": value("DESCRIPTION"), "published_raw": shown,
            "author": props["ORGANIZER"][1].get("CN") or value("ORGANIZER") if "ORGANIZER" in props else None,
            "categories": [c for x in (value("CATEGORIES") or "").split(",") if (c := x.strip())],
            "venue": value("LOCATION"), "city": options.get("city"), "starts_at": start, "ends_at": end,
        }


# ---- paged event APIs ----


def _with_venue(venue: str | None, body: str | None) -> str | None:
    return f"Venue: {venue}\n\n{body}" if venue and body else venue or body


def paged_events(payload: bytes, options: dict) -> Iterator[dict]:
    """A page of either search API: objects under ``events``, or under ``_embedded.events``."""
    page = json.loads(payload)
    if isinstance(page.get("events"), list):
        for e in filter(lambda x: isinstance(x, dict), page["events"]):
            venue = _text(_at(e, "venue", "name"))
            kind = _text(_at(e, "category", "name"))
            yield {
                "title": _text(e.get("name")), "link": e.get("url"), "description": _with_venue(venue, _text(e.get("description")) or _text(e.get("summary"))),
                "published_raw": _at(e, "start", "local") or _at(e, "start", "utc"), "author": _text(_at(e, "organizer", "name")),
                "categories": [kind] if kind else [], "venue": venue, "city": options.get("city"),
            }
        return
    for e in filter(lambda x: isinstance(x, dict), _at(page, "_embedded", "events") or []):
        places = _at(e, "_embedded", "venues") or [{}]
        place = places[0] if isinstance(places[0], dict) else {}
        venue, when = _text(place.get("name")), _at(e, "dates", "start") or {}
        joined = f"{when['localDate']}T{when['localTime']}" if when.get("localDate") and when.get("localTime") else when.get("localDate")
        labels = [x for c in e.get("classifications") or [] if isinstance(c, dict) for k in ("segment", "genre", "subGenre", "type", "subType") if (x := _text(_at(c, k, "name")))]
        yield {
            "title": _text(e.get("name")), "link": e.get("url"), "description": _with_venue(venue, _text(e.get("info")) or _text(e.get("pleaseNote"))),
            "published_raw": _text(when.get("dateTime")) or joined, "categories": labels, "venue": venue, "city": _text(_at(place, "city", "name")) or options.get("city"),
        }


def next_page(payload: dict, pages_read: int, limit: int = 3) -> int | None:
    """Number of the page to ask for after this one; None at the last page or after ``limit`` pages."""
    if pages_read >= limit:
        return None
    if "pagination" in payload:
        here = payload["pagination"]
        return here.get("page_number", 1) + 1 if here.get("has_more_items") else None
    here = payload.get("page") or {}
    number = here.get("number", 0) + 1
    return number if number < here.get("totalPages", 0) else None


# ---- HTML calendars ----


def items_of(payload: Any, path: str | None = None) -> list[dict]:
    """Objects at a dotted path, or of the first of shows, events, items and results that is a list."""
    if path:
        payload = _at(payload, *path.split("."))
    if isinstance(payload, dict):
        payload = next((payload[k] for k in ("shows", "events", "items", "results") if isinstance(payload.get(k), list)), [])
    return [x for x in payload if isinstance(x, dict)] if isinstance(payload, list) else []


def field(item: dict, spec: str | None) -> str | None:
    """Dotted field as text; ``bands`` joins the bands' names."""
    if spec == "bands":
        names = [b["name"] for b in item.get("bands") or [] if isinstance(b, dict) and b.get("name")]
        return ", ".join(names) or None
    value = _at(item, *spec.split(".")) if spec else None
    return (str(value).strip() or None) if value is not None else None


#: fixed pattern: where a page's script names the JSON that it loads
_LAZY_URL = re.compile(r'"url"\s*:\s*"(/api/[^"]+\.json[^"]*)"', re.IGNORECASE)


def json_url(page: str) -> str | None:
    """Address of the JSON that a page loads lazily: of the first data-lazy object that has one, else in a script."""
    for node in markup.tree(page).select("[data-lazy]"):
        try:
            found = json.loads(node.attrs["data-lazy"])
        except json.JSONDecodeError:
            continue
        if isinstance(found, dict) and isinstance(found.get("url"), str) and found["url"]:
            return found["url"].replace("\\u0026", "&")
    m = _LAZY_URL.search(html.unescape(page))
    return m[1].replace("\\u0026", "&") if m else None


def csrf_token(page: str) -> str | None:
    node = markup.tree(page).first('meta[name="csrf-token"]')
    return node.attrs.get("content") or None if node else None


def lazy_requests(pages: DataFrame) -> DataFrame:
    """(feed, request_url, csrf): what to ask for next where ``pages`` (feed, url, payload) load their events lazily; the address is made absolute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feed, url, payload = (c.to_pylist() for c in batch.columns)
            found = [(json_url(p or ""), csrf_token(p or "")) for p in payload]
            asked = [urljoin(u or "", f) if f else None for u, (f, _) in zip(url, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(feed, pa.string()), pa.array(asked, pa.string()), pa.array([t for _, t in found], pa.string())], names=["feed", "request_url", "csrf"])

    rows = pages.select("feed", "url", F.col("payload").cast("string").alias("payload")).mapInArrow(run, "feed string, request_url string, csrf string")
    return rows.where("request_url is not null")


def html_calendar(payload: bytes, options: dict) -> Iterator[dict]:
    """JSON answer, JSON in script tags, or elements by CSS selectors, whatever ``strategy`` says; rows without title and link go."""
    text = payload.decode("utf-8", "replace")
    kind = options.get("strategy", "json_api")
    if kind == "css":
        rows = list(_by_selector(text, options))
        fields = {"title": "title", "link": "url", "description": "description", "published_raw": "published_raw"}
    else:
        blobs = [text] if kind == "json_api" else re.findall(r'(?s)<script[^>]+type=["\']application/json["\'][^>]*>(.*?)</script>', text)
        rows = []
        for blob in blobs:
            try:
                rows = items_of(json.loads(blob), options.get("items_path"))
            except json.JSONDecodeError:
                if kind == "json_api":
                    raise
            if rows:
                break
        fields = {"title": options.get("title", "bands"), "link": options.get("link", "url"), "description": options.get("description", "venue.name"), "published_raw": options.get("published_raw", "starts_at")}
    parts = urlsplit(options.get("url", ""))
    for row in rows:
        got = {name: field(row, spec) for name, spec in fields.items()}
        if got["title"] or got["link"]:
            if got["link"]:
                got["link"] = urljoin(f"{parts.scheme}://{parts.netloc}", got["link"])
            yield got | {"venue": got["description"], "city": options.get("city")}


def _by_selector(text: str, options: dict) -> Iterator[dict]:
    """Items by ``item_selector``; in each the first tags of title_, link_, description_ and date_selector. A date is its text, else its
    datetime or content attribute."""
    if not options.get("item_selector"):
        raise ValueError("css needs an item_selector")
    for item in markup.tree(text).select(options["item_selector"]):
        title, link, about, when = (item.first(options.get(f"{n}_selector")) for n in ("title", "link", "description", "date"))
        date_text = when and (when.text() or next((when.attrs[a].strip() for a in ("datetime", "content") if when.attrs.get(a)), None))
        yield {"title": title.text() if title else None, "url": link.attrs.get("href") if link else None, "description": about.text() if about else None, "published_raw": date_text or None}


#: adapter of each source type; add to it to plug in another
ADAPTERS: dict[str, Callable[[bytes, dict], Iterator[dict]]] = {"rss": rss, "ical": ical, "api": paged_events, "scrape": html_calendar}


def entries(kind: str, feed: str, payload: bytes, options: dict) -> list[dict]:
    return [{f: row.get(f) for f in _FIELDS} | {"feed": feed, "categories": row.get("categories") or []} for row in ADAPTERS[kind](payload, options)]


_ARROW = pa.struct([(f, pa.list_(pa.string()) if f == "categories" else pa.timestamp("us", tz="UTC") if f.endswith("_at") else pa.string()) for f in _FIELDS])


def parse(payloads: DataFrame, options: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, health) of ``payloads`` (feed, source_type, payload). Status is OK, EMPTY, UNCHANGED (a null payload: nothing new)
    or MALFORMED; one feed's failure is its own."""
    opts = dict(options or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for feed, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, status, error = [], "UNCHANGED", None
                if payload is not None:
                    try:
                        rows = entries(kind, feed, payload, opts)
                        status = "OK" if rows else "EMPTY"
                    except Exception as why:  # noqa: BLE001 - whatever a feed sends must not stop the others
                        status, error = "MALFORMED", f"{type(why).__name__}: {why}"[:200]
                out.append({"feed": feed, "status": status, "error": error, "rows": rows})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("feed", pa.string()), ("status", pa.string()), ("error", pa.string()), ("rows", pa.list_(_ARROW))]))

    parsed = payloads.select("feed", "source_type", F.col("payload").cast("binary").alias("payload")).mapInArrow(run, f"feed string, status string, error string, rows array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>")
    found = parsed.select(F.explode("rows").alias("r")).select("r.*")
    return found, parsed.select("feed", "status", "error", F.size("rows").alias("n_entries"))


def scan(spark: SparkSession, path: str, kind: str, feed: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """Entries and health of the payload files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return parse(files.select(F.lit(feed).alias("feed"), F.lit(kind).alias("source_type"), F.col("content").alias("payload")), options)


def source_type_of(url):
    """ical for addresses whose path ends in .ics, else rss."""
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    return F.when(F.lower(path).endswith(".ics"), "ical").otherwise("rss")


def search_city(is_national, home_city, feed_city):
    """National feeds ask for the user's city, where there is one."""
    home = F.trim(F.coalesce(home_city, F.lit("")))
    return F.when(is_national & (home != ""), home).otherwise(feed_city)


class FeedFiles(DataSource):
    """``spark.read.format("marquee_feed").option("kind", "ical").option("paths", "a;b")``: one partition per file."""

    @classmethod
    def name(cls) -> str:
        return "marquee_feed"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema):
        return _FileReader(dict(self.options))


class _FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        return [InputPartition(p) for p in self.options["paths"].split(";") if p]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            for row in entries(self.options["kind"], self.options.get("feed", "feed"), f.read(), self.options):
                yield tuple(row[f] for f in _FIELDS)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedFiles)
