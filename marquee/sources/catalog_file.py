"""The feed catalog: a YAML file of feeds, validated row by row on the driver (hundreds of rows at most)."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, name string, url string, city string, is_national boolean, source_quality_score double, active boolean, notes string, source_type string, cursor string, scrape map<string,string>"
_KINDS = ("rss", "ical", "api", "scrape")


def load(spark: SparkSession, path: str, home_city: str | None = None) -> DataFrame:
    """Active feeds of the file; with ``home_city`` those of that metro and the national ones. A missing file, a missing ``feeds``
    key or a row that breaks a rule raises."""
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    if not raw or "feeds" not in raw:
        raise ValueError(f"{path} has no 'feeds'")
    rows = [_row(x) for x in raw["feeds"]]
    df = spark.createDataFrame(rows, SCHEMA).where("active")
    return df if home_city is None else for_city(df, home_city)


def _row(x: dict) -> tuple:
    missing = [k for k in ("id", "name", "url", "city", "source_quality_score") if x.get(k) is None]
    if missing:
        raise ValueError(f"feed {x.get('id')}: no {', '.join(missing)}")
    kind = x.get("source_type", "rss")
    if kind not in _KINDS:
        raise ValueError(f"feed {x['id']}: source_type {kind}")
    quality = float(x["source_quality_score"])
    if not 0 <= quality <= 1:
        raise ValueError(f"feed {x['id']}: quality {quality}")
    scrape = {k: str(v) for k, v in x["scrape"].items()} if x.get("scrape") else None
    return x["id"], x["name"], x["url"], x["city"], bool(x.get("is_national", False)), quality, bool(x.get("active", True)), x.get("notes"), kind, x.get("cursor"), scrape


def for_city(feeds: DataFrame, home_city: str) -> DataFrame:
    return feeds.where(F.col("is_national") | (F.col("city") == home_city.strip()))


def subset(feeds: DataFrame, ids: set[str] | None, key: str = "id") -> DataFrame:
    """The feeds asked for, by id; ids that aren't there raise. None asks for all."""
    if ids is None:
        return feeds.orderBy(key)
    wanted = feeds.sparkSession.createDataFrame([(i,) for i in sorted(ids)], f"{key} string")
    unknown = [r[0] for r in wanted.join(feeds, key, "left_anti").collect()]
    if unknown:
        raise ValueError(f"unknown or inactive feeds: {', '.join(sorted(unknown))}")
    return feeds.join(wanted, key, "left_semi").orderBy(key)


def parse_ids(text: str | None) -> set[str] | None:
    found = {p.strip() for p in (text or "").split(",") if p.strip()}
    return found or None
