"""Traps of the domain's semantics, with values worked out by hand or by slow functions."""

import random
from collections import Counter
from datetime import date, datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.functions import categories, schedule, scoring, text
from marquee.operators import dedup, keyed, select
from marquee.sources import feeds, markup


def _slow_ratio(a, b):
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return 2 * row[-1] / (len(a) + len(b))


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=20), st.text("abcé ", max_size=20))
def test_indel_ratio(a, b):
    assert dedup.indel_ratio(a, b) == pytest.approx(_slow_ratio(a, b))


def test_near_titles_merge():
    assert dedup.indel_ratio("Great Night Out", "The Great Night Out!") == pytest.approx(30 / 35)  # an edit distance would give 0.75


def _clusters(spark, rows):
    df = spark.createDataFrame(rows, "event_id string, event_date string, venue string, title string").withColumn("event_date", F.to_date("event_date"))
    return sorted(map(tuple, dedup.clusters(df).collect())), sorted((r.left_id, r.right_id, round(r.similarity, 4)) for r in dedup.fuzzy_pairs(df).collect())


def test_equal_titles_of_different_ids_pair(spark):
    clusters, pairs = _clusters(spark, [("x", "2026-07-01", "Hall A", "Jazz Night"), ("y", "2026-07-01", "hall a ", "Jazz Night"), ("z", "2026-07-01", "Hall B", "Jazz Night"), ("n", None, "Hall A", "Jazz Night"), ("m", None, "Hall A", "Jazz Night")])
    assert pairs == [("x", "y", 1.0)]
    assert clusters == [("m", "m"), ("n", "n"), ("x", "x"), ("y", "x"), ("z", "z")]


def test_an_id_of_two_blocks_joins_them(spark):
    """x stands on two days; what is alike on either is one cluster, with one row per id."""
    rows = [("x", "2026-07-01", "Hall", "Jazz Night"), ("x", "2026-07-02", "Hall", "Jazz Night"), ("y", "2026-07-01", "Hall", "Jazz Night!"), ("a", "2026-07-02", "Hall", "Jazz Nights"), ("far", "2026-07-02", "Hall", "Poetry")]
    clusters, pairs = _clusters(spark, rows)
    assert [p[:2] for p in pairs] == [("a", "x"), ("x", "y")]
    assert clusters == [("a", "a"), ("far", "far"), ("x", "a"), ("y", "a")]


def test_a_large_block_is_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(dedup, "_BLOCK", 5)
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("ab") for _ in range(9)) for _ in range(40)})
    rows = [(f"{k:03d}", "2026-07-01", "Hall", t) for k, t in enumerate(names)]
    want = sorted((a[0], b[0], round(_slow_ratio(a[3], b[3]), 4)) for a in rows for b in rows if a[0] < b[0] and _slow_ratio(a[3], b[3]) > 0.85)
    assert _clusters(spark, rows)[1] == want and want


def test_golden_composite(spark):
    """A nine-part score worked out by hand."""
    parts = dict(zip(scoring.vocab.RANK_WEIGHTS, (0.9, 0.5, 0.0, 0.75, 1.0, 1.0, 0.8, 1.0, 0.85)))
    got = spark.range(1).select(scoring.rank_score({k: F.lit(v) for k, v in parts.items()})).first()[0]
    assert got == pytest.approx(0.7475)


def test_recency_edges(spark):
    days = [None, 0.0, 14.0, 14.0001, 21.0, 27.9999, 28.0, 29.0]
    rows = spark.createDataFrame([(d,) for d in days], "d double").select(scoring.recency_factor(F.col("d")), scoring.recency_band(F.col("d"))).collect()
    assert [r[0] for r in rows][:3] == [1.0, 0.5, 0.5] and [r[0] for r in rows][-2:] == [1.0, 1.0]
    assert rows[4][0] == pytest.approx(0.5 + 0.5 * (1 - 0.05**0.5))
    assert [r[1] for r in rows] == ["none", "hard", "hard", "soft", "soft", "soft", "soft", "none"]


def test_text_functions(spark):
    rows = [("  The  Hall.,! ", " $12.5 or $7.25", "HTTPS://x"), ("!!", "No Cover", "https:///x"), (None, None, None), ("", "", "ftp://x")]
    got = spark.createDataFrame(rows, "v string, p string, u string").select(text.clean_venue(F.col("v")), text.price_cents(F.col("p")), text.is_free(F.col("p")), text.is_http_url(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("The Hall", 1200, False, True), (None, None, True, False), (None, None, False, False), (None, None, False, False)]


def test_performers_and_categories(spark):
    row = spark.range(1).select(
        text.performer_names(F.lit("Featuring Beyoncé Knowles-Carter and more"), F.lit("dj Zoë, DJ ZOË; presents The Band now")).alias("names"),
        text.names_performer(F.lit("Night"), F.lit("come with friends")).alias("friends"),
        text.names_performer(F.lit("Night"), F.lit("with special guest TBA")).alias("tba"),
        categories.standardize(F.array(F.lit("Hip Hop"), F.lit("hip-hop"), F.lit("theatre"), F.lit("x"))).alias("cats"),
        categories.validate_vibes(F.array(F.lit("social"), F.lit("social"))).alias("one"),
    ).first()
    assert row.names == ["Beyoncé Knowles-Carter", "The Band", "Zoë"]
    assert (row.friends, row.tba) == (True, False)
    assert (row.cats, row.one) == (["Hip-Hop", "Theater"], None)


NOW = datetime(2026, 7, 10, 9, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "day,time,kind,starts",
    [
        ("Sat, Jun 7 2025", "6:00 PM", "single", ["2025-06-07 18:00"]),
        ("Friday, June 7", "8pm to late", "single", ["2026-06-07 12:00"]),
        ("June 28-27", None, "festival", ["2026-06-27 23:59"]),
        ("August 28 & 29", "7pm", "festival", ["2026-08-28 19:00"]),
        ("June 30 – July 2", None, "festival", ["2026-06-30 12:00"]),
        ("Tuesdays, July 7 through July 22", None, "series", ["2026-07-07 12:00", "2026-07-14 12:00", "2026-07-21 12:00"]),
        ("July 2, July 9", "8pm", "list", ["2026-07-02 20:00", "2026-07-09 20:00"]),
        ("sometime soon", None, None, []),
        (None, None, None, []),
    ],
)
def test_schedules(day, time, kind, starts):
    got = schedule.expand(day, time, NOW)
    assert (got[0], [f"{s.start:%Y-%m-%d %H:%M}" for s in got[1]]) == (kind, starts)


def _pool(rng, n):
    return [
        {"event_id": f"e{k}", "score": round(rng.random(), 3), "categories": rng.sample(["a", "b", "c", "d"], rng.randrange(1, 3)), "venue": f"v{rng.randrange(6)}", "date": date(2026, 1, 1 + rng.randrange(3) * (n > 12)), "wildcard": rng.random() < 0.1}
        for k in range(n)
    ]


def test_choice_keeps_its_caps():
    rng = random.Random(8)
    for n in [0, 1, 2, 5, 12, 13, 40, 80] * 20:
        pool = sorted(_pool(rng, n), key=lambda r: -r["score"])
        picks = select.choose(pool)
        assert len(picks) <= 10 and len({p["event_id"] for p in picks}) == len(picks)
        assert max(Counter(c for p in picks for c in p["categories"]).values(), default=0) <= 3
        assert max(Counter(p["venue"] for p in picks).values(), default=0) <= 2
        assert [p["score"] for p in picks] == sorted((p["score"] for p in picks), reverse=True)


def test_curate_equals_choice_over_the_whole_pool(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for user in range(6):
        pool = sorted(_pool(rng, 60), key=lambda r: -r["score"])
        want[user] = [p["event_id"] for p in select.choose(pool)]
        rows += [(user, k + 1, p["event_id"], p["score"], p["categories"], p["venue"], p["date"], p["wildcard"]) for k, p in enumerate(pool)]
    df = spark.createDataFrame(rows, "user_id int, rank int, event_id string, score double, categories array<string>, venue string, event_date date, wildcard boolean")
    got = {}
    for r in sorted(select.curate(df).collect(), key=lambda r: (r.user_id, r.position)):
        got.setdefault(r.user_id, []).append(r.event_id)
    assert got == want


def test_dedup_is_idempotent_and_accounts_for_every_row(spark):
    rows = [("e1", "1", "Great Night", date(2026, 1, 1), "Hall", "f1", 0.5), ("e1", "2", "Great Night", date(2026, 1, 1), "Hall", "f2", 0.5), ("e2", "3", "Great Night!", date(2026, 1, 1), " hall", "f3", 0.9), ("e3", "4", "Great Night", date(2026, 1, 1), "Other", "f1", 0.5)]
    df = spark.createDataFrame(rows, "event_id string, ord string, title string, event_date date, venue string, feed string, source_quality double")
    merged = dedup.merge(df.join(dedup.clusters(df), "event_id"), "cluster")
    got = {r.cluster: (r.ord, r.source_feeds, r.n_members, r.merge_type) for r in merged.collect()}
    assert got == {"e1": ("3", ["f1", "f2", "f3"], 3, "fuzzy"), "e3": ("4", ["f1"], 1, "none")}
    again = merged.select("event_id", "ord", "title", "event_date", "venue", "feed", "source_quality")
    assert dedup.merge(again.join(dedup.clusters(again), "event_id"), "cluster").count() == 2


def test_first_match_and_upsert(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 9, "late"), ("a", 1, "early"), ("b", 5, "only")], "k string, o int, v string")
    assert {r.k: r.match_v for r in keyed.first_match(left, right, ["k"], "o").collect()} == {"a": "early", "b": "only", "c": None}
    assert {r.k: r.v for r in keyed.upsert(right.where("o < 6"), right.where("o >= 6"), ["k"], "o").collect()} == {"a": "late", "b": "only"}


def test_paging_and_links():
    assert feeds.next_page({"pagination": {"page_number": 1, "has_more_items": True}}, 1) == 2
    assert feeds.next_page({"pagination": {"page_number": 3, "has_more_items": True}}, 3) is None
    assert feeds.next_page({"page": {"number": 0, "totalPages": 2}}, 1) == 1
    assert feeds.next_page({"page": {"number": 1, "totalPages": 2}}, 2) is None


def test_lazy_pages_name_their_next_request(spark):
    assert feeds.json_url("<div data-lazy='{\"url\": \"/shows.json?a=1&amp;b=2\"}'>") == "/shows.json?a=1&b=2"
    assert feeds.json_url("<div data-lazy='no json'></div><p data-lazy='{\"url\": \"/b\"}'>") == "/b"
    assert feeds.json_url('<script>x = {"url": "/api/v1/shows.json?q=1"}</script>') == "/api/v1/shows.json?q=1"
    assert feeds.json_url('<script>{"url": "/other/shows.json"}</script>') is None and feeds.json_url("") is None
    assert feeds.csrf_token('<meta content="abc" name="csrf-token">') == "abc" and feeds.csrf_token("<meta name=x content=abc>") is None
    pages = spark.createDataFrame([("a", "https://x.example/cal/", '<meta name="csrf-token" content="t"><i data-lazy=\'{"url": "more"}\'>'), ("b", None, None)], "feed string, url string, payload string")
    assert feeds.lazy_requests(pages).collect() == [("a", "https://x.example/cal/more", "t")]


def _css(page, **selectors):
    options = {"strategy": "css", "url": "https://x.example/cal", **selectors}
    return [(r["title"], r["link"], r["description"], r["published_raw"]) for r in feeds.entries("scrape", "s", page.encode(), options)]


def test_css_items():
    page = """<main><div class="item one"><div class="item-body"><div>In <b>the</b></div><div> park </div></div><a href="/e/1"><b class="t">A &amp; B</b></a><time class="d" datetime="2026-01-01"></time></div>
      <div class="item"><p class="t"></p></div><div class="items"><a href="/no">no</a></div>
      <div class="item"><a class="more" href="https://y.example/2">Two<br>lines</a><span class="d"> May 3 </span><meta class="d" content="x"></div></main>"""
    how = dict(item_selector="main > div.item", title_selector=".t, a.more", link_selector="a[href]", description_selector=".item-body", date_selector=".d")
    assert _css(page, **how) == [("A & B", "https://x.example/e/1", "In the park", "2026-01-01"), ("Two lines", "https://y.example/2", None, "May 3")]
    with pytest.raises(ValueError, match="item_selector"):
        _css(page, title_selector="b")


@pytest.mark.parametrize(
    "selector, found",
    [("div", ["a", "b", "c", "f"]), ("div div", ["b", "c"]), ("#a > div", ["b"]), ("div div div", ["c"]), ("div p", ["d", "e"]), ("div > p", ["d", "e"]), (".x.y", ["b"]), (".x", ["a", "b"]), ("p.x, #f", ["f"]),
     ("[data-k]", ["c", "d"]), ('[data-k="one two"]', ["d"]), ("[data-k~=two]", ["d"]), ("p[data-k^='one']", ["d"]), ("[data-k$=two]", ["d"]), ("[data-k*='e t']", ["d"]), ("*[lang|=en]", ["e"]), ("section #d", []), ("body div.x > .y p", ["d", "e"])],
)
def test_selectors(selector, found):
    page = "<body><div id=a class='x'><div id=b class=' y  x '><div id=c data-k><p id=d data-k='one two'>t</p></div><p id=e lang=en-US>u</div></section></div><div id=f class=xy></body>"
    assert [n.attrs["id"] for n in markup.tree(page).select(selector)] == found


@pytest.mark.parametrize("selector", ["", "a,", "a:first-child", "> a", "a + b", "[x"])
def test_what_is_no_selector(selector):
    with pytest.raises(ValueError):
        markup.tree("<a>").select(selector)


def test_deep_and_broken_pages():
    deep = markup.tree("<div>" * 5000 + "x" + "</div>" * 4990 + "</p></table>")
    assert len(deep.select("div")) == 5000 and deep.text() == "x"
    assert markup.tree("<p>a<p>b</i>c < d &lt; <!-- no --><br/>e").text() == "a b c < d < e"


def test_feed_data_source(spark, tmp_path):
    f = tmp_path / "a.ics"
    f.write_text("BEGIN:VCALENDAR\nBEGIN:VEVENT\nDTSTART:20260713T180000Z\nSUMMARY:One\nEND:VEVENT\nEND:VCALENDAR\n")
    feeds.register(spark)
    rows = spark.read.format("marquee_feed").option("kind", "ical").option("paths", str(f)).option("now", "2026-07-10 00:00:00").load().collect()
    assert [(r.title, r.published_raw) for r in rows] == [("One", "2026-07-13T18:00:00+00:00")]
    found, health = feeds.scan(spark, str(f), "ical", "f")
    assert found.count() == 1 and health.first().status == "OK"


def _near_titles(seed, count, letters="abcd"):
    rng = random.Random(seed)
    out = set()
    while len(out) < count:
        base = "".join(rng.choices(letters, k=rng.randint(1, 24)))
        out.add(base)
        for _ in range(3):
            t = list(base)
            for _ in range(rng.randint(1, 4)):
                if t and rng.random() < 0.5:
                    t.pop(rng.randrange(len(t)))
                else:
                    t.insert(rng.randint(0, len(t)), rng.choice(letters))
            out.add("".join(t))
    return sorted(out)


def test_similar_titles_share_a_leading_gram():
    """All pairs above the threshold meet, and have the bigrams in common that the bound asks for."""
    for letters in ("ab", "abcdefghijklmnopqrst"):
        titles = _near_titles(len(letters), 500, letters)
        keys = [set(dedup.leading_grams(t)) for t in titles]
        grams = [Counter(zip(t, t[1:])) for t in titles]  # noqa: B905
        met = found = 0
        for i in range(len(titles)):
            for j in range(i):
                met += bool(keys[i] & keys[j])
                if dedup.indel_ratio(titles[i], titles[j]) > dedup.SIMILAR_ABOVE:
                    found += 1
                    assert keys[i] & keys[j], (titles[i], titles[j])
                    assert sum((grams[i] & grams[j]).values()) >= dedup.shared_grams(len(titles[i]), len(titles[j]))
        assert found > 300
        if len(letters) > 2:
            assert met < 0.2 * len(titles) * (len(titles) - 1) / 2


def test_large_blocks_meet_by_grams(spark, monkeypatch):
    titles = _near_titles(3, 150)
    rows = [(f"{v}{k:04d}", t, date(2026, 5, 1), v, "f", 0.5, str(k)) for v in ("Hall", "Club") for k, t in enumerate(titles[: 150 if v == "Hall" else 20])]
    df = spark.createDataFrame(rows, "event_id string, title string, event_date date, venue string, feed string, source_quality double, ord string")
    read = lambda: {(r.left_id, r.right_id): round(r.similarity, 9) for r in dedup.fuzzy_pairs(df).collect()}
    whole = read()
    assert len(whole) > 100
    monkeypatch.setattr(dedup, "_BLOCK", 30)
    assert read() == whole


@pytest.mark.parametrize("seed, k", [(1, 3), (2, 10)])
def test_bounded_top_k_equals_all_pairs_and_scores_few(spark, seed, k):
    """Sums with many ties, cities with fewer events than k, users without events; the fewest pairs are scored."""
    rng = random.Random(seed)
    events = [(f"c{rng.randrange(4)}", f"b{rng.randrange(6)}", f"e{n}", f"{n:05d}", rng.choice([0.0, 0.1, 0.25, 0.5, rng.random()])) for n in range(900)] + [("small", "b1", "s1", "1", 0.5), ("small", "b2", "s2", "0", 0.5)]
    users = [(n, rng.choice(["c0", "c1", "c2", "c3", "small", "nowhere"]), rng.choice([0.2, 0.5, 1.0])) for n in range(60)]
    e = spark.createDataFrame(events, "city string, kind string, event_id string, ord string, value double")
    u = spark.createDataFrame(users, "user_id int, city string, taste double")
    own = F.col("taste") * (F.hash("kind", "user_id") % 7) / 7.0
    seen = []

    def score(pairs):
        seen.append(pairs)
        return pairs.withColumn("score", F.round(own + F.col("value"), 6))

    best = select.top_k_bounded(u, e, k, on="city", block=["kind"], own=own, static=F.col("value"), score=score)
    got = {(r.user_id, r.rank, r.event_id) for r in best.collect()}
    every = e.join(u, "city").withColumn("score", F.round(own + F.col("value"), 6))
    assert got == {(r.user_id, r.rank, r.event_id) for r in select.top_k(every, k).collect()}
    assert seen[0].count() < 0.2 * every.count()
