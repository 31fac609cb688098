"""Counts and threshold of the URL models come from all URLs that a rule decides."""

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import urls


def test_all_decided_urls_are_learnt_and_calibrated(spark):
    k = F.col("id")
    name = lambda first: F.translate(F.hex(F.xxhash64(F.lit(first), k)), "0123456789ABCDEF", "abcdefghijklmnop")
    url = F.when(k % 2 == 0, F.concat(F.lit("http://"), name(1), F.lit(".net/de/1"))).otherwise(F.concat(F.lit("http://b"), name(2), F.lit(".org/es/2")))
    pages = spark.range(24_000).select(k.alias("page_id"), url.alias("url"))
    model = urls.train(pages)
    texts = pages.select(urls.model_text(F.col("url")).alias("t"), (F.col("page_id") % 2 == 0).alias("a")).select("t", "a", (F.pmod(F.xxhash64("t"), F.lit(5)) == 0).alias("held")).toPandas()
    ends = model.table.where("part = 258").first()
    counted = texts[~texts.held]
    assert (ends.a, ends.r) == (counted.a.sum(), (~counted.a).sum()) and min(ends.a, ends.r) > 9_000
    score = model.scorer()
    held = texts[texts.held]
    s, a = np.array([score(t) for t in held.t]), held.a.to_numpy()
    values = np.unique(s)
    cuts = [values[0] - 1e-9, *((values[:-1] + values[1:]) / 2), values[-1] + 1e-9]
    right = [(s[a] >= c).mean() + (s[~a] < c).mean() for c in cuts]
    at = (s[a] >= model.threshold).mean() + (s[~a] < model.threshold).mean()
    assert abs(at - max(right)) < 1e-6
