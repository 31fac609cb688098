"""The library's own queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import enrich_queries, listing_queries, ranking_queries, run_queries, service_queries, source_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**listing_queries.QUERIES, **ranking_queries.QUERIES, **source_queries.QUERIES, **enrich_queries.QUERIES, **run_queries.QUERIES, **service_queries.QUERIES}
ORACLES: dict[str, str] = {**listing_queries.ORACLES, **ranking_queries.ORACLES, **source_queries.ORACLES, **enrich_queries.ORACLES, **run_queries.ORACLES, **service_queries.ORACLES}
