import json

import pytest
from pyspark.sql import functions as F

from marquee.operators import enrich
from marquee.plans import weekly


def _inputs(spark, checkpoint=None):
    entry = "feed string, source_type string, title string, link string, description string, published_raw string, categories array<string>, venue string, city string"
    rows = [
        ("f1", "api", "Great Night", "https://x.example/1", "A long evening " * 12, "2026-07-12T19:00:00", ["Jazz"], "Blue Club", "Metro"),
        ("f2", "api", "Great Night!", "https://x.example/2", "short", "2026-07-12T19:00:00", ["Music"], "blue club", "Metro"),
        ("f1", "api", "Far Show", "https://x.example/3", "text " * 40, "2026-09-01T19:00:00", ["Film"], "Hall", "Metro"),
        ("f1", "api", "Seen", "https://x.example/4", "text " * 40, "2026-07-13T19:00:00", ["Film"], "Hall", "Metro"),
        ("f3", "rss", "Prose", "https://x.example/5", "about it", None, [], None, None),
        ("f1", "ical", "No venue", "https://x.example/6", "text", "2026-07-12", ["Film"], None, "Metro"),
        ("f1", "api", "Sports day", "https://x.example/7", "text " * 40, "2026-07-14T10:00:00", ["Sports"], "Park", "Metro"),
    ]
    from pyspark.sql import functions as F

    from marquee.functions import text

    seen = spark.createDataFrame([("f1", "https://x.example/4", "2026-07-13T19:00:00")], "feed string, l string, p string").select("feed", text.entry_hash(F.col("l"), F.col("p")).alias("entry_hash"), F.lit("2026-07-20").cast("timestamp").alias("expires_at"))
    profile = "user_id string, home_city string, category_weights array<struct<key:string,weight:double>>, vibe_preferences array<string>, preferred_neighborhoods array<string>, excluded_categories array<string>"

    def extract(prompt):
        return "```json\n" + json.dumps({"is_event": True, "title": "Prose gig", "date": "July 15", "time": "8pm", "venue": "Cellar", "city": "Metro", "url": "https://x.example/5", "price": "$12", "description": "live " * 50, "categories": ["concert"]}) + "\n```"

    return weekly.Inputs(
        entries=spark.createDataFrame(rows, entry),
        feeds=spark.createDataFrame([("f1", 0.9, "api", False), ("f2", 0.4, "api", False), ("f3", 0.5, "rss", False)], "feed string, quality double, source_type string, structured_ingest boolean"),
        profiles=spark.createDataFrame([("u", "metro", [("jazz", 0.9), ("music", 0.8)], [], [], ["sports"])], profile),
        seen=seen,
        history=spark.createDataFrame([], "user_id string, event_id string, recommended_at timestamp"),
        now="2026-07-10 09:00:00",
        strategy=extract,
        checkpoint=checkpoint,
    )


def test_whole_run_and_resume(spark, tmp_path):
    inputs = _inputs(spark, str(tmp_path / "run"))
    got = sorted((r.position, r.title) for r in weekly.run(inputs).collect())
    assert {t for _, t in got} == {"Great Night", "Prose gig"} and [p for p, _ in got] == [1, 2]
    assert weekly.funnel(inputs) == {"entries": 7, "candidates": 6, "events": 3, "filtered": 3, "enriched": 3, "ranked": 2, "picks": 2}
    again = _inputs(spark, str(tmp_path / "run"))
    again.strategy = lambda prompt: 1 / 0  # nothing is asked again
    assert weekly.run(again).count() == 2


def test_stop_points(spark):
    assert weekly.run(_inputs(spark), "candidates").count() == 6


def test_all_nine_parts_are_live(spark):
    inputs = _inputs(spark)
    inputs.vibes = lambda prompt: json.dumps({"vibe_tags": ["social", "niche"]})
    inputs.performers = lambda prompt: json.dumps({"performers": [{"name": prompt, "confidence": 0.9, "affinity_score": 0.75, "one_line_summary": "x"}]})
    inputs.neighborhoods = lambda prompt: json.dumps({"neighborhood": "Old Town", "confidence": 0.9 if prompt.startswith("blue") else 0.1})
    inputs.embed = lambda prompt: [1.0, 0.0] if "Great" in prompt else [0.0, 1.0]
    inputs.liked = spark.createDataFrame([("u", [1.0, 1.0]), ("u", [-1.0, 0.0])], "user_id string, embedding array<double>")
    inputs.entries = inputs.entries.withColumn("description", F.concat("description", F.lit(" featuring Ann Day"))).withColumn("ord", F.col("link"))
    inputs.profiles = inputs.profiles.withColumn("vibe_preferences", F.array(F.lit("social"))).withColumn("preferred_neighborhoods", F.array(F.lit("old town")))
    got = {r.title: r.breakdown for r in weekly.run(inputs, "ranked").collect()}
    great = got["Great Night"]
    assert great.semantic_similarity == pytest.approx(0.5**0.5) and great.performer_affinity == 0.75 and great.location == 1.0 and great.vibe_fit == 1.0
    assert got["Prose gig"].location == 0.0 and 0 < great.category_fit <= 1 and great.source_coverage == pytest.approx(2 / 3)
    assert all(0 < great[k] <= 1 for k in great.asDict())


def test_seen_events_come_back_and_the_cap_holds(spark):
    inputs = _inputs(spark)
    made = weekly.run(_inputs(spark), "events").where("title = 'Prose gig'")
    columns = ["event_id", "title", "start", "end", "venue", "city", "url", "price_cents", "is_free", "description", "categories", "source_quality", "kind"]
    seen = inputs.seen.select("feed", "entry_hash").crossJoin(made.select(*columns)).withColumn("title", F.lit("Seen before")).withColumn("event_id", F.lit("cached"))
    inputs.seen_events = seen.withColumn("venue", F.lit("Other hall"))
    inputs.max_extraction = 1
    found = weekly.run(inputs, "events")
    assert {r.title for r in found.collect()} == {"Great Night", "Prose gig", "Sports day", "Seen before"}
    assert [r.title for r in found.orderBy("ord").limit(1).collect()] == ["Seen before"]
    inputs.max_extraction = 0
    assert "Prose gig" not in {r.title for r in weekly.run(inputs, "events").collect()}


def test_structured_candidates(spark):
    rows = {r.title: r for r in weekly.run(_inputs(spark), "candidates").collect()}
    assert rows["Great Night"].extraction_confidence == 1.0 and rows["Great Night"].ord.startswith("0") and rows["Prose gig"].ord.startswith("1")


def test_liked_events_are_upserted(spark):
    old = spark.createDataFrame([("u", "a", [1.0]), ("u", "b", [2.0])], "user_id string, event_id string, embedding array<double>")
    new = spark.createDataFrame([("u", "a", [3.0]), ("v", "a", [4.0])], "user_id string, event_id string, embedding array<double>")
    assert sorted(map(tuple, weekly.add_liked(old, new).collect())) == [("u", "a", [3.0]), ("u", "b", [2.0]), ("v", "a", [4.0])]


def test_insistence_rate_and_templates():
    waits, calls = [], []

    def shaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert enrich.insistent(shaky, 3, 1.0, waits.append)("x") == "ok" and waits == [1.0, 2.0]
    calls.clear()
    with pytest.raises(OSError):
        enrich.insistent(shaky, 2, 1.0, waits.append)("x")

    def closed(prompt):
        raise enrich.Unavailable("no account")

    with pytest.raises(enrich.Unavailable):
        enrich.insistent(closed, 5, 1.0, lambda s: pytest.fail("waited"))("x")
    clock = [0.0]
    slow = enrich.throttled(str, 2.0, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    assert [slow(k) for k in range(3)] == ["0", "1", "2"] and clock[0] == 1.0
    assert enrich.render("Dear {{ name }}, {{n}}", name="Ann", n=3) == "Dear Ann, 3"
    with pytest.raises(KeyError):
        enrich.render("{{ name }}")
