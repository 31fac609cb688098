"""Line dedup by distinct-site spread.

For each line (by a 128-bit hash of its trimmed text) the sites it stands on are counted by HyperLogLog sketches, merged
by aggregation. Only lines whose estimate is near the threshold are brought back and their distinct sites counted exactly, so the
outcome is that of an exact count. A line on ``min_sites`` sites or more is cross-site boilerplate: it stays in the
document with the least id that holds it, and is removed from all others.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import common


def line_hashes(line: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 12) -> tuple[DataFrame, DataFrame]:
    """(boilerplate, its lines): (h1, h2, keeper, n) of the lines on ``min_sites`` distinct sites or more, n times in all, and the rows of
    ``lines`` that may be such a line. ``lines``: h1, h2, site, doc (may be null) and others.

    The sketch's relative standard error is 1.04 / sqrt(2^lg_k); within six of it (and at least one site) of the
    threshold the count is made exact, from the rows of those lines alone: what the sketch puts below that is never looked at again."""
    margin = max(1.0, 6 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k)))
    spread = lines.groupBy("h1", "h2").agg(estimate.alias("sites"), F.min("doc").alias("keeper"), F.count("*").alias("n"))
    spread = common.stage(spread.where(F.col("sites") >= min_sites - margin), "line_spread")
    held = common.stage(common.heavy_join(lines, spread, ["h1", "h2"], "n", lines.count()), "spread_lines")
    near = held.where(F.abs(F.col("sites") - min_sites) <= margin).groupBy("h1", "h2", "site").agg(F.first("keeper").alias("keeper"), F.first("n").alias("n"))
    exact = near.groupBy("h1", "h2").agg(F.count("*").alias("sites"), F.first("keeper").alias("keeper"), F.first("n").alias("n")).where(F.col("sites") >= min_sites)
    sure = spread.where(F.col("sites") > min_sites + margin)
    columns = ["h1", "h2", "keeper", "n"]
    found = common.stage(exact.select(*columns).unionByName(sure.select(*columns)), "boilerplate")
    common.drop(spread)
    return found, held


@F.pandas_udf(StringType())
def without(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines at some positions; a set per text, since array functions would look through them line by line."""
    return pd.Series([None if t is None else "\n".join(p for i, p in enumerate(t.split("\n")) if i not in g) for t, g in zip(text, map(lambda g: () if g is None else frozenset(g), gone), strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", *, min_sites: int = 3, min_chars: int = 10) -> DataFrame:
    """``docs`` with cross-site boilerplate lines removed from ``text_col``, and columns n_lines and n_removed.

    Lines end with a line feed; they are compared without the spaces, tabs and carriage returns around them; lines of
    fewer than ``min_chars`` characters are never removed. All rows stay, also those left with an empty text.

    A null text stays null, with no lines. A null site is one site of its own. A null id never keeps a line for itself; a
    line that only such rows hold is removed from none. Rows that repeat an id and text are treated alike. Empty table:
    no rows. Columns of the results' names are replaced; others, whatever their names, stay. Very long texts are read whole, in
    time linear in their lines.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.col(text_col).cast("string")
    other = [c for c in names if c != text_col]
    base = docs.select(
        F.struct(F.lit(0).alias("_"), *other).alias("row"),
        text.alias("text"),
        F.col(id_col).cast("long").alias("doc"),
        # rows are told apart by id and text, so that rows which share an id keep their own lines
        F.xxhash64(F.col(id_col), text).alias("k1"),
        F.xxhash64(F.lit(1), F.col(id_col), text).alias("k2"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("\x00")).alias("site"),
    )
    parts = F.split("text", "\n", -1)
    each = base.select("doc", "k1", "k2", "site", F.posexplode(parts).alias("at", "line")).withColumn("line", F.trim(F.col("line"), F.lit(" \t\r")))
    each = each.where(F.length("line") >= min_chars).select("doc", "k1", "k2", "site", "at", *line_hashes(F.col("line")))
    lines = common.stage(each, "lines")
    found, held = boilerplate(lines, min_sites)
    hits = common.heavy_join(held.drop("keeper", "sites", "n"), found.where("keeper is not null"), ["h1", "h2"], "n", held.count()).where("not (doc <=> keeper)")
    # a repeated row's lines come twice, which a set doesn't feel
    gone = common.stage(hits.groupBy("k1", "k2").agg(F.collect_set("at").alias("gone")), "line_hits")
    common.drop(lines, held, found)
    joined = base.drop("doc", "site").join(gone, ["k1", "k2"], "left")
    # texts without such lines don't go to Python
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(without(F.when(F.col("gone").isNotNull(), F.col("text")), F.col("gone")))
    return joined.select(
        *(cleaned.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def op9_line_spread(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "source")
    cleaned = dedup_lines(docs)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP9_SQL = """
WITH parts AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), lines AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, pos, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM parts
), spread AS (
  SELECT line, min(doc_id) AS keeper FROM lines WHERE length(line) >= 10 GROUP BY line HAVING count(DISTINCT site) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.raw, s.keeper IS NOT NULL AND l.doc_id <> s.keeper AS gone FROM lines l LEFT JOIN spread s ON l.line = s.line
), docs AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(CAST(n_lines AS BIGINT), 0) AS n_lines, coalesce(CAST(n_removed AS BIGINT), 0) AS n_removed, CAST(length(kept) AS BIGINT) AS n_chars_left, md5(kept) AS text_md5
FROM documents d LEFT JOIN docs USING (doc_id)
"""
