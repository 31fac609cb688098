"""Queries over sources, schedules, JSON and streams. What feeds would send is made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FEEDBACK_NOW, FEEDBACK_SQL, NOW, feedback, feeds, history, now, table
from ..functions.schedule import schedule
from ..operators import enrich, normalize
from ..sources import feeds as sources
from ..streaming import folds
from .ranking_queries import ORACLES as RANKING

QUERIES, ORACLES = {}, {}
_N = f"TIMESTAMP '{NOW}'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _flat(df):
    return df.select("feed", "title", "link", "description", "published_raw", "author", F.array_join("categories", "|").alias("categories"), "venue", "city")


def _xml(text):
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query(
    "SELECT CAST(page_id AS VARCHAR) AS feed, CASE WHEN i = 0 THEN 'Page ' || page_id || ' & friends' ELSE 'Site' END AS title, CASE WHEN i = 0 THEN url ELSE 'https://x.example/' || page_id END AS link, CASE WHEN i = 0 AND page_id % 2 = 0 THEN 'Long <b>text</b>' ELSE 'Short' END AS description, "
    "CASE WHEN i = 0 THEN 'Mon, 01 Jun 1998 10:00:00 GMT' END AS published_raw, CASE WHEN i = 1 THEN 'Ann' END AS author, CASE WHEN i = 0 THEN 'Jazz|Music' ELSE '' END AS categories, CAST(NULL AS VARCHAR) AS venue, CAST(NULL AS VARCHAR) AS city FROM pages, range(2) t(i) WHERE url IS NOT NULL"
)
def rss_xml(spark, sf_dir):
    """RSS items made of the pages, a feed for each: full content before the summary, terms, first link, authors by creator."""
    k, url = F.col("page_id").cast("string"), _xml(F.col("url"))
    one = F.concat(F.lit("<item><title>Page "), k, F.lit(" &amp; friends</title><link>"), url, F.lit("</link><description>Short</description>"), F.when(F.col("page_id") % 2 == 0, "<content:encoded><![CDATA[Long <b>text</b>]]></content:encoded>").otherwise(""), F.lit("<pubDate>Mon, 01 Jun 1998 10:00:00 GMT</pubDate><category>Jazz</category><category>Music</category></item>"))
    two = F.concat(F.lit("<item><title>Site</title><link>https://x.example/"), k, F.lit("</link><description>Short</description><dc:creator>Ann</dc:creator><category></category></item>"))
    head = '<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>City</title>'
    payloads = table(spark, sf_dir, "pages").where("url is not null").select(k.alias("feed"), F.lit("rss").alias("source_type"), F.concat(F.lit(head), one, two, F.lit("</channel></rss>")).alias("payload"))
    return _flat(sources.parse(payloads)[0])


_WHEN = "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER))"


@query(
    f"WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS kind, CAST(o_orderdate AS DATE) AS d, {_WHEN} AS s, o_orderpriority FROM orders), "
    "e AS (SELECT *, CASE kind WHEN 1 THEN CAST(d AS TIMESTAMP) ELSE s END AS starts, CASE kind WHEN 0 THEN s + INTERVAL 2 HOUR WHEN 1 THEN CAST(d AS TIMESTAMP) + INTERVAL 2 DAY - INTERVAL 1 SECOND ELSE s END AS ends FROM o) "
    "SELECT CAST(o_orderkey AS VARCHAR) AS feed, 'Order with a very long title' AS title, CASE WHEN kind = 0 THEN 'https://x.example/' || o_orderkey END AS link, CAST(NULL AS VARCHAR) AS description, "
    "CASE WHEN kind = 1 THEN strftime(d, '%Y-%m-%d') ELSE strftime(s, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS published_raw, CASE WHEN kind = 0 THEN 'Ann Day' END AS author, CASE WHEN kind = 2 THEN 'Jazz|Music' ELSE '' END AS categories, 'Hall, ' || o_orderpriority AS venue, 'Metro' AS city "
    f"FROM e WHERE starts <= {_N} + INTERVAL 14 DAY AND ends >= {_N}"
)
def ical_window(spark, sf_dir):
    """Calendars made of the orders: those that overlap the horizon. A DATE end is exclusive, an event without an end ends as it begins."""
    k, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    day, hour = F.date_format("o_orderdate", "yyyyMMdd"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    clock = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    until = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 2), "yyyyMMdd")
    times = F.when(kind == 0, F.concat(F.lit("DTSTART:"), clock(hour), F.lit("\r\nDTEND:"), clock(hour + F.make_dt_interval(hours=F.lit(2))), F.lit("\r\nORGANIZER;CN=Ann Day:mailto:a@x.example\r\nURL:https://x.example/"), k))
    times = times.when(kind == 1, F.concat(F.lit("DTSTART;VALUE=DATE:"), day, F.lit("\r\nDTEND;VALUE=DATE:"), until)).otherwise(F.concat(F.lit("DTSTART:"), clock(hour), F.lit("\r\nCATEGORIES:Jazz, Music,")))
    body = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\n"), times, F.lit("\r\nSUMMARY:Order with a very\r\n  long title\r\nLOCATION:Hall\\, "), "o_orderpriority", F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    payloads = table(spark, sf_dir, "orders").select(k.alias("feed"), F.lit("ical").alias("source_type"), body.alias("payload"))
    return _flat(sources.parse(payloads, {"now": NOW, "city": "Metro"})[0])


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS feed, p_name AS title, 'https://x.example/' || p_partkey AS link, CASE WHEN p_partkey % 2 = 0 THEN 'Venue: ' || p_brand || chr(10) || chr(10) || 'Under lights' WHEN p_partkey % 4 = 1 THEN 'Venue: ' || p_brand || chr(10) || chr(10) || 'Loud' ELSE 'Loud' END AS description, "
    "CASE WHEN p_partkey % 2 = 0 THEN '1998-06-03T19:00:00' ELSE '1998-06-05T20:00:00' END AS published_raw, CASE WHEN p_partkey % 2 = 0 THEN 'Org' END AS author, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || '|Rock' END AS categories, CASE WHEN p_partkey % 4 <> 3 THEN p_brand END AS venue, CASE WHEN p_partkey % 4 = 1 THEN 'Metro' ELSE 'Home' END AS city FROM part"
)
def event_api_map(spark, sf_dir):
    """Pages of both event APIs, made of the parts, as raw entries."""
    k, named = F.col("p_partkey"), lambda c: F.struct(F.col(c).alias("name"))
    url = F.concat(F.lit("https://x.example/"), k.cast("string")).alias("url")
    text = lambda c: F.struct(c.alias("text"))
    first = F.struct(text(F.col("p_name")).alias("name"), text(F.lit("Under lights")).alias("summary"), url, F.struct(F.lit("1998-06-03T19:00:00").alias("local")).alias("start"), F.struct(F.lit("Org").alias("name")).alias("organizer"), named("p_brand").alias("venue"), named("p_type").alias("category"))
    eb = F.to_json(F.struct(F.struct(F.lit(False).alias("has_more_items")).alias("pagination"), F.array(first).alias("events")))
    place = F.when(k % 4 == 1, F.struct(F.array(F.struct(F.col("p_brand").alias("name"), F.struct(F.lit("Metro").alias("name")).alias("city"))).alias("venues")))
    kinds = F.array(F.struct(named("p_type").alias("segment"), F.struct(F.lit("Rock").alias("name")).alias("genre")))
    when = F.struct(F.struct(F.lit("1998-06-05").alias("localDate"), F.lit("20:00:00").alias("localTime")).alias("start"))
    second = F.struct(F.col("p_name").alias("name"), url, F.lit("Loud").alias("info"), when.alias("dates"), place.alias("_embedded"), kinds.alias("classifications"))
    tm = F.to_json(F.struct(F.struct(F.lit(1).alias("totalPages"), F.lit(0).alias("number")).alias("page"), F.struct(F.array(second).alias("events")).alias("_embedded")))
    payloads = table(spark, sf_dir, "part").select(k.cast("string").alias("feed"), F.lit("api").alias("source_type"), F.when(k % 2 == 0, eb).otherwise(tm).alias("payload"))
    return _flat(sources.parse(payloads, {"city": "Home"})[0])


@query("SELECT CAST(c_custkey AS VARCHAR) AS feed, c_name || ', B' AS title, 'https://x.example/shows/' || c_custkey AS link, c_mktsegment AS description, '1998-06-03T20:00:00-04:00' AS published_raw, CAST(NULL AS VARCHAR) AS author, '' AS categories, c_mktsegment AS venue, 'Metro' AS city FROM customer")
def html_calendar_json(spark, sf_dir):
    """JSON behind calendar pages, one for each customer, plain or in a script tag; relative links become absolute, rows without title and link go."""
    k, name = F.col("c_custkey"), lambda c: F.struct(c.alias("name"))
    show = F.struct(k.alias("id"), F.concat(F.lit("/shows/"), k.cast("string")).alias("url"), F.lit("1998-06-03T20:00:00-04:00").alias("starts_at"), F.array(name(F.col("c_name")), name(F.lit("B"))).alias("bands"), name(F.col("c_mktsegment")).alias("venue"))
    nothing = F.struct(k.alias("id"), *(F.lit(None).cast(t).alias(n) for n, t in (("url", "string"), ("starts_at", "string"), ("bands", "array<struct<name:string>>"), ("venue", "struct<name:string>"))))
    body = F.to_json(F.struct(F.array(show, nothing).alias("shows")))
    found = []
    for kind, rows, payload in (("json_api", k % 2 == 0, body), ("json_embed", k % 2 == 1, F.concat(F.lit('<html><script type="application/json">{"x": 1}</script><script type="application/json">'), body, F.lit("</script></html>")))):
        payloads = table(spark, sf_dir, "customer").where(rows).select(k.cast("string").alias("feed"), F.lit("scrape").alias("source_type"), payload.alias("payload"))
        found.append(_flat(sources.parse(payloads, {"url": "https://x.example/calendar", "city": "Metro", "strategy": kind})[0]))
    return found[0].unionByName(found[1])


@query(
    "WITH n AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href=\"[^\"]*\">[^<]*</a></li>')) AS li FROM pages) "
    "SELECT CAST(page_id AS VARCHAR) AS feed, trim(regexp_extract(li, '>([^<>]*)</a>', 1)) AS title, 'https://x.example' || regexp_extract(li, 'href=\"([^\"]*)\"', 1) AS link, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS published_raw FROM n "
    "UNION ALL SELECT CAST(page_id AS VARCHAR), 'Page ' || page_id, 'https://x.example/p/' || page_id, 'In the park', CASE WHEN page_id % 2 = 0 THEN '1998-06-03' ELSE 'June 3' END FROM pages WHERE html IS NOT NULL"
)
def calendar_css(spark, sf_dir):
    """Items of whole pages by CSS selectors: the links of the page's own navigation, and an item in which tags of one name are nested."""
    k = F.col("page_id").cast("string")
    date = F.when(F.col("page_id") % 2 == 0, '<time class="d" datetime="1998-06-03"></time>').otherwise('<i class="d">June 3</i>')
    item = F.concat(F.lit('<div class="first item"><div class="box"><div>In</div><div>the park</div></div><div><h3 class="t">Page '), k, F.lit("</h3></div>"), date, F.lit('<a class="more" href="/p/'), k, F.lit('">more</a></div>'))
    payloads = table(spark, sf_dir, "pages").where("html is not null").select(k.alias("feed"), F.lit("scrape").alias("source_type"), F.concat(item, "html").alias("payload"))
    how = {"strategy": "css", "url": "https://x.example/cal", "item_selector": "div.item, nav > ul > li", "title_selector": "h3.t, li a", "link_selector": "a[href]", "description_selector": ".item .box", "date_selector": ".d"}
    return sources.parse(payloads, how)[0].select("feed", "title", "link", "description", "published_raw")


@query(
    "SELECT CAST(page_id AS VARCHAR) AS feed, 'https://x.example' || CASE page_id % 3 WHEN 0 THEN '/shows.json?a=1&b=' || page_id ELSE '/api/v1/' || page_id || '.json' END AS request_url, CASE WHEN page_id % 2 = 0 THEN 'token-' || page_id END AS csrf FROM pages WHERE page_id % 3 < 2"
)
def calendar_discovery(spark, sf_dir):
    """What pages that load their events lazily ask for next: an address in an attribute or a script, and the token to send with it."""
    k = F.col("page_id").cast("string")
    lazy = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<div data-lazy="{&quot;url&quot;: &quot;/shows.json?a=1&amp;b='), k, F.lit('&quot;}"></div>')))
    lazy = lazy.when(F.col("page_id") % 3 == 1, F.concat(F.lit('<script>load({"url": "/api/v1/'), k, F.lit('.json"})</script>'))).otherwise("")
    meta = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta name="csrf-token" content="token-'), k, F.lit('">'))).otherwise("")
    pages = table(spark, sf_dir, "pages").select(k.alias("feed"), F.lit("https://x.example/cal").alias("url"), F.concat(meta, lazy, F.coalesce("html", F.lit(""))).alias("payload"))
    return sources.lazy_requests(pages)


@query("SELECT CAST(page_id AS VARCHAR) AS feed, CASE page_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'EMPTY' WHEN 2 THEN 'MALFORMED' ELSE 'UNCHANGED' END AS status, CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS n_entries FROM pages")
def feed_isolation(spark, sf_dir):
    """A feed for each page; every fourth fails, and leaves the others alone."""
    k = F.col("page_id")
    item = F.concat(F.lit("<rss><channel><item><title>Page "), k.cast("string"), F.lit("</title></item></channel></rss>"))
    kind = F.when(k % 4 == 1, "ical").when(k % 4 == 2, "api").otherwise("rss")
    payload = F.when(k % 4 == 0, item).when(k % 4 == 1, "BEGIN:VCALENDAR\r\nEND:VCALENDAR").when(k % 4 == 2, F.concat(F.lit("{not json "), F.coalesce("html", F.lit(""))))
    payloads = table(spark, sf_dir, "pages").select(k.cast("string").alias("feed"), kind.alias("source_type"), payload.alias("payload"))
    return sources.parse(payloads)[1].select("feed", "status", F.col("n_entries").cast("bigint").alias("n_entries"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 AND ends_with(lower(regexp_extract(replace(url, '.html', '.ICS'), '^[^?#]*')), '.ics') THEN 'ical' ELSE 'rss' END AS kind, CASE WHEN page_id % 2 = 0 THEN 'Metro' ELSE 'city' END AS geo FROM pages")
def source_inference(spark, sf_dir):
    """Kind of a feed by its address's path (every other one is made a calendar's), and the city that a search asks for."""
    address = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit(".html"), F.lit(".ICS"))).otherwise(F.col("url"))
    geo = sources.search_city(F.col("page_id") % 2 == 0, F.lit(" Metro "), F.lit("city"))
    return table(spark, sf_dir, "pages").select("page_id", sources.source_type_of(address).alias("kind"), geo.alias("geo"))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS n_links, list_extract(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) AS first_link FROM pages")
def html_scrape_pages(spark, sf_dir):
    """Title and links of raw pages."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.size(links).cast("bigint").alias("n_links"), F.get(links, F.lit(0)).alias("first_link"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS feed, c_name || '-' || i AS title, 'https://x.example/' || i AS link FROM customer, range(2) t(i) WHERE c_custkey % 3 <> 2 UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name || '-0', 'https://x.example/0' FROM customer WHERE c_custkey % 6 = 5")
def json_items(spark, sf_dir):
    """Objects at a dotted path of a JSON payload, or in the first list that has a usual name; other payloads give none."""
    k = F.col("c_custkey")
    item = lambda i: F.struct(F.concat("c_name", F.lit(f"-{i}")).alias("name"), F.lit(f"/{i}").alias("url"))
    here = F.to_json(F.struct(F.struct(F.array(item(0), item(1)).alias("shows")).alias("data")))
    found = []
    for rows, payload, options in ((k % 3 != 2, here, {"items_path": "data.shows"}), (k % 6 == 5, F.to_json(F.struct(F.array(item(0)).alias("results"))), {}), (k % 6 == 2, F.lit('{"data":"none"}'), {"items_path": "data.shows"})):
        payloads = table(spark, sf_dir, "customer").where(rows).select(k.cast("string").alias("feed"), F.lit("scrape").alias("source_type"), payload.alias("payload"))
        found.append(sources.parse(payloads, {"url": "https://x.example/calendar", "title": "name", **options})[0].select("feed", "title", "link"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1, 2) THEN o_custkey END AS answer, o_orderkey % 4 <> 3 AS parsed FROM orders")
def llm_json_fence(spark, sf_dir):
    """Model answers: bare JSON, JSON in a code fence with or without a tag, or none."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"answer": '), F.col("o_custkey").cast("string"), F.lit("}"))
    fence = "`" * 3
    raw = F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit(f"Sure:\n{fence}json\n"), body, F.lit(f"\n{fence} done"))).when(k % 4 == 2, F.concat(F.lit(f"{fence}\n"), body, F.lit(f"\n{fence}"))).otherwise("no idea")
    rows = table(spark, sf_dir, "orders").select(k, raw.alias("raw")).withColumn("v", F.try_parse_json(enrich.json_text(F.col("raw"))))
    return rows.select(k, F.try_variant_get("v", "$.answer", "bigint").alias("answer"), F.try_variant_get("v", "$.answer", "bigint").isNotNull().alias("parsed"))


def _nights(spark, sf_dir, date):
    return table(spark, sf_dir, "customer").select("c_custkey", schedule(date, F.lit(None).cast("string"), NOW).alias("s"))


@query("SELECT c_custkey, strftime(d, '%Y-%m-%d %H:%M:%S') AS start FROM customer, generate_series(TIMESTAMP '1998-06-01 12:00:00', TIMESTAMP '1998-07-31 12:00:00', INTERVAL 1 DAY) t(d) WHERE isodow(d) = c_custkey % 7 + 1 AND d BETWEEN TIMESTAMP '1998-06-01 12:00:00' + to_days(CAST(c_custkey % 20 AS INTEGER)) AND TIMESTAMP '1998-06-30 12:00:00' + to_days(CAST(c_custkey % 31 + 1 AS INTEGER))")
def schedule_weekday_series(spark, sf_dir):
    """``Tuesdays, June 3 through July 12``: every such weekday of the range."""
    k = F.col("c_custkey")
    days = F.get(F.array(*(F.lit(d) for d in ("Mondays", "Tuesday", "Wednesdays", "thursdays", "Fridays", "SATURDAYS", "Sundays"))), (k % 7).cast("int"))
    date = F.concat(days, F.lit(", June "), (k % 20 + 1).cast("string"), F.lit(" through July "), (k % 31 + 1).cast("string"))
    return _nights(spark, sf_dir, date).select(k, F.explode("s.starts").alias("t")).select(k, F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query(
    "WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1998-06-01 12:00:00' + to_days(CAST(c_custkey % 28 AS INTEGER)) ELSE TIMESTAMP '1998-06-01 12:00:00' + to_days(CAST(c_custkey % 28 AS INTEGER)) END AS a, "
    "CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1998-06-01 23:59:59' + to_days(CAST(c_custkey % 9 AS INTEGER)) ELSE TIMESTAMP '1998-07-01 23:59:59' + to_days(CAST(c_custkey % 9 AS INTEGER)) END AS b FROM customer) "
    "SELECT c_custkey, strftime(least(a, b), '%Y-%m-%d %H:%M:%S') AS start, strftime(greatest(a, b), '%Y-%m-%d %H:%M:%S') AS ends FROM r"
)
def schedule_festival(spark, sf_dir):
    """``June 27-28`` and ``June 27 - July 3``: a range to the last second, swapped where reversed."""
    k = F.col("c_custkey")
    first, last = (k % 28 + 1).cast("string"), (k % 9 + 1).cast("string")
    date = F.when(k % 2 == 0, F.concat(F.lit("June "), first, F.lit(" & "), last)).otherwise(F.concat(F.lit("june "), first, F.lit(" – July "), last))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return _nights(spark, sf_dir, date).select(k, F.date_format(F.get("s.starts", F.lit(0)), fmt).alias("start"), F.date_format(F.get("s.ends", F.lit(0)), fmt).alias("ends"))


@query("SELECT c_custkey, strftime(TIMESTAMP '1998-06-01 19:30:00' + to_days(CAST(c_custkey % 25 + i * 30 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS start FROM customer, range(2) t(i)")
def schedule_date_list(spark, sf_dir):
    """``June 3, July 3`` with a time for both."""
    k = F.col("c_custkey")
    date = F.concat(F.lit("June "), (k % 25 + 1).cast("string"), F.lit(", July "), (k % 25 + 1).cast("string"), F.lit(","))
    rows = table(spark, sf_dir, "customer").select(k, schedule(date, F.lit("7:30pm"), NOW).alias("s"))
    return rows.select(k, F.explode("s.starts").alias("t")).select(k, F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query(
    f"""WITH c AS (SELECT o_orderkey, 'Show ' || o_orderpriority AS title, o_orderdate AS d, CASE o_orderkey % 9 WHEN 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 20:00' END AS date_text, CASE WHEN o_orderkey % 8 = 1 THEN ' !' ELSE 'Hall ' || CAST(o_custkey % 5 AS VARCHAR) END AS venue, o_orderkey % 7 <> 2 AS url_ok FROM orders),
r AS (SELECT *, CAST(CAST(d AS DATE) AS TIMESTAMP) + INTERVAL 20 HOUR AS start, CASE WHEN o_orderkey % 9 = 0 THEN 'unparseable_date' WHEN trim(venue) = '!' THEN 'missing_venue' WHEN NOT url_ok THEN 'invalid_url' WHEN NOT CAST(CAST(d AS DATE) AS TIMESTAMP) + INTERVAL 20 HOUR BETWEEN {_N} AND {_N} + INTERVAL 14 DAY THEN 'outside_window' END AS reason FROM c)
SELECT o_orderkey, reason, CASE WHEN reason IS NULL THEN sha256(title || date_text || venue) END AS event_id, CASE WHEN reason IS NULL THEN 'Schedule: ' || date_text END AS last_line FROM r"""
)
def normalize_candidates(spark, sf_dir):
    """Candidates through the whole normalisation: a reason or an event."""
    k = F.col("o_orderkey")
    cand = table(spark, sf_dir, "orders").select(
        k, F.concat(F.lit("Show "), "o_orderpriority").alias("title"),
        F.when(k % 9 == 0, "soon").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 20:00"))).alias("date"),
        F.lit(None).cast("string").alias("time"),
        F.when(k % 8 == 1, " !").otherwise(F.concat(F.lit("Hall "), (F.col("o_custkey") % 5).cast("string"))).alias("venue"),
        F.lit(" Metro ").alias("city"), F.when(k % 7 == 2, "mailto:x").otherwise("https://x.example").alias("url"),
        F.lit("$5").alias("price"), F.concat(F.lit("About "), k.cast("string")).alias("description"),
        F.array(F.lit("concert")).alias("categories"), F.lit("feed_1").alias("feed"),
    )
    reasons = normalize.expand(cand, NOW).select(k, "reason")
    events = normalize.normalize(cand, feeds(spark), NOW).select(F.regexp_extract("description", r"^About (\d+)", 1).cast("bigint").alias("o_orderkey"), "event_id", F.regexp_extract("description", r"\n\n(.*)$", 1).alias("last_line"))
    return reasons.join(events, "o_orderkey", "left")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_dedup(spark, sf_dir):
    """A stream's first row per key within the state's lifetime, as distinct keys."""
    events = folds.stream_of(spark, f"{sf_dir}/events*.parquet").select("user_id", "event_type", "ts")
    return folds.run_to_end(folds.dedup(events, ["user_id", "event_type"], "ts"), "dedup").select("user_id", "event_type").distinct()


@query(RANKING["feedback_fold"])
def stream_feedback(spark, sf_dir):
    """The feedback fold as a stream gives what the batch gives."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = folds.stream_of(spark, f"{sf_dir}/events*.parquet").where("event_type in ('click', 'error')")
    signals = e.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", "click").otherwise("negative").alias("signal"), F.coalesce(k % 24, F.lit(0)).alias("category_no"))
    return folds.fold_stream(signals, ["user_id", "category_no"], now(FEEDBACK_NOW)).withColumn("weight", F.round("weight", 6))


@query(
    FEEDBACK_SQL.rstrip() + f", last AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 24 AS category_no, max(ts) AS last_at FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) "
    f"SELECT event_id, CASE WHEN last_at IS NULL OR epoch_us(TIMESTAMP '{FEEDBACK_NOW}') - epoch_us(last_at) > 28 * 86400e6 THEN 'none' WHEN epoch_us(TIMESTAMP '{FEEDBACK_NOW}') - epoch_us(last_at) <= 14 * 86400e6 THEN 'hard' ELSE 'soft' END AS band FROM feedback LEFT JOIN last USING (user_id, category_no)"
)
def stream_static_join(spark, sf_dir):
    """A stream of feedback against the whole history, brought to the last recommendation of each user and category."""
    h = history(spark, sf_dir).select("user_id", (F.col("event_key").cast("int") % 24).alias("category_no"), "recommended_at")
    e = folds.stream_of(spark, f"{sf_dir}/events*.parquet").where("event_type in ('click', 'error')")
    signals = e.select("event_id", "user_id", F.coalesce(F.get_json_object("props", "$.k").cast("int") % 24, F.lit(0)).alias("category_no"))
    return folds.run_to_end(folds.with_history(signals, h, ["user_id", "category_no"], now(FEEDBACK_NOW)).select("event_id", "band"), "bands")
