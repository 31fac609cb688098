"""URL filters: host and path rules, and for URLs without a rule the ratio of two character language models.

The models are smoothed variable-order Markov chains over the bytes of a URL, one of accepted and one of rejected URLs: the probability after a
context mixes in that after the next shorter one, with Witten-Bell weights, down to a uniform one over all bytes and the end. They read the host without its
last label and what follows it, query and fragment included, without a path's first segment of two letters: last label and language are
what the rules go by, and would only be learnt back. A URL's score is the difference of both log-likelihoods divided by its length; the
threshold is calibrated on URLs kept out of the counts.

Counts, scores and the threshold are Spark jobs over all URLs: a context of up to five characters and the one after it are one whole number, nine bits a
character, that is counted, joined and summed by. Nothing of them is brought to the driver or to one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: (host, path prefix, verdict). Fixed values.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: beside the 256 bytes
_START, _STOP = chr(256), chr(257)
#: what can follow: a byte or the end
_ALPHABET = 257
#: of a character in a gram's number: 1 to 256 the bytes, 257 the start, 258 the end, 0 none; up to six characters
_BITS = 9


def _rest(url: Column) -> Column:
    """What stands after the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def model_text(url: Column) -> Column:
    """What the models read of a URL; empty for null and without ``://``."""
    host, rest = F.regexp_replace(host_of(url), r"\.[^.]*$", ""), F.regexp_replace(_rest(url), r"^[^/?#]*", "")
    return F.coalesce(F.concat(host, F.regexp_replace(rest, r"^/[A-Za-z]{2}(?=/)", "")), F.lit(""))


def _bytes(text: str) -> str:
    """A character for each UTF-8 byte."""
    return text.encode().decode("latin-1")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent domain and whose path begins the url's;
    null where none fits. The length of a rule is that of host and path together."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


class Markov:
    """Counts of each character after each context of up to ``order`` characters."""

    def __init__(self, order: int = 5):
        self.order = order
        self.after: dict[str, dict[str, int]] = {}

    def add(self, text: str) -> None:
        line = _START + text + _STOP
        for k in range(1, len(line)):
            for n in range(min(k, self.order) + 1):
                seen = self.after.setdefault(line[k - n : k], {})
                seen[line[k]] = seen.get(line[k], 0) + 1

    def probability(self, context: str, char: str) -> float:
        p = 1.0 / _ALPHABET
        for n in range(len(context) + 1):
            seen = self.after.get(context[len(context) - n :])
            if seen is None:
                break
            total, kinds = sum(seen.values()), len(seen)
            p = (seen.get(char, 0) + kinds * p) / (total + kinds)
        return p


@dataclass
class Ratio:
    accepted: Markov
    rejected: Markov
    threshold: float = 0.0

    def scorer(self):
        cache: dict[tuple[str, str], float] = {}

        def score(text: str) -> float:
            line = _START + text + _STOP
            total = 0.0
            for k in range(1, len(line)):
                key = line[max(0, k - self.accepted.order) : k], line[k]
                if (x := cache.get(key)) is None:
                    x = float(np.log(self.accepted.probability(*key)) - np.log(self.rejected.probability(*key)))
                    if len(cache) >= 200_000:
                        cache.clear()
                    cache[key] = x
                total += x
            return total / (len(line) - 1)

        return score


def _grams(texts: DataFrame, order: int, keep: list[str], combine: bool) -> DataFrame:
    """(keep, code): each character of a text and the end, with the context before it. With ``combine`` a batch's rows of equal codes are one, ``keep`` summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [np.concatenate([np.zeros(order, np.int64), [257], np.frombuffer(t, np.uint8).astype(np.int64) + 1, [258]]) for t in common.binary_list(batch.column("text"))]
            line = np.concatenate(lines) if lines else np.zeros(0, np.int64)
            code = line.copy()
            for n in range(1, order + 1):
                code[n:] |= line[:-n] << (_BITS * n)
            at = np.flatnonzero((line > 0) & (line != 257))
            code, row = code[at], np.repeat(np.arange(len(lines)), [len(x) for x in lines])[at]
            columns = [np.asarray(batch.column(c))[row] for c in keep]
            if combine:
                code, of = np.unique(code, return_inverse=True)
                columns = [np.bincount(of, c, len(code)).astype(np.int64) for c in columns]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(code, pa.int64())], names=[*keep, "code"])

    return texts.select("text", *keep).mapInArrow(common.in_slices(run, 2000), ", ".join([*(f"{c} long" for c in keep), "code long"]))


def _parts(grams: DataFrame, order: int) -> DataFrame:
    """Each gram with its ends: of n characters of context, for every n up to what it has."""
    n = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("n")
    cuts = F.element_at(F.array(*(F.lit((1 << _BITS * (k + 1)) - 1) for k in range(order + 1))), F.col("n") + 1)
    top = F.element_at(F.array(*(F.lit(511 << _BITS * k) for k in range(order + 1))), F.col("n") + 1)
    return grams.select("*", n).where(F.col("code").bitwiseAND(top) > 0).withColumn("part", F.col("code").bitwiseAND(cuts))


@dataclass
class Counts:
    """Both models as a table (part, a, r): how often a character follows a context among accepted and rejected URLs, for every length of context."""

    table: DataFrame
    order: int
    threshold: float = 0.0

    def ratios(self, codes: DataFrame) -> DataFrame:
        """(code, x): the difference of the logarithms of both probabilities, in units of 2^-40, so that sums don't depend on their order."""
        kinds = lambda c: F.count(F.when(F.col(c) > 0, 1))
        after = self.table.groupBy(F.shiftright("part", _BITS).alias("context")).agg(F.sum("a").alias("ta"), kinds("a").alias("ka"), F.sum("r").alias("tr"), kinds("r").alias("kr"))
        parts = _parts(codes, self.order)
        # by the part first: a context is looked up once for each part, not for each gram
        each = parts.select("part").distinct().join(self.table, "part", "left").withColumn("context", F.shiftright("part", _BITS)).join(after, "context")
        found = F.array_sort(F.collect_list(F.struct("n", "a", "r", "ta", "ka", "tr", "kr")))
        mixed = lambda p, x, c, t, k: F.when(x[t] > 0, (F.coalesce(x[c], F.lit(0)) + x[k] * p) / (x[t] + x[k])).otherwise(p)
        start = F.struct(F.lit(1.0 / _ALPHABET).alias("p"), F.lit(1.0 / _ALPHABET).alias("q"))
        both = F.aggregate(found, start, lambda s, x: F.struct(mixed(s["p"], x, "a", "ta", "ka").alias("p"), mixed(s["q"], x, "r", "tr", "kr").alias("q")))
        known = parts.join(each, "part", "left").groupBy("code").agg(both.alias("m"))
        return known.select("code", F.round((F.log("m.p") - F.log("m.q")) * float(1 << 40)).cast("bigint").alias("x"))

    def scores(self, texts: DataFrame) -> DataFrame:
        """(id, lm_score) of (id, text): one row for each id."""
        grams = _grams(texts, self.order, ["id"], combine=False)
        x = self.ratios(grams.select("code").distinct())
        return grams.join(x, "code").groupBy("id").agg((F.sum("x") / F.count("*") / float(1 << 40)).alias("lm_score"))

    def scorer(self):
        """The same in plain Python: brings the whole table to the driver, to look at small models."""
        out = Ratio(Markov(self.order), Markov(self.order))
        for part, a, r in self.table.select("part", "a", "r").collect():
            line = "".join(chr((part >> _BITS * k & 511) - 1) for k in range(self.order, -1, -1) if part >> _BITS * k & 511)
            for n, model in ((a, out.accepted), (r, out.rejected)):
                if n:
                    model.after.setdefault(line[:-1], {})[line[-1]] = n
        return out.scorer()


def calibrate(scored: DataFrame, bins: int = 4096) -> float:
    """The threshold with the best balanced accuracy, from (lm_score, a, r): numbers of accepted and rejected URLs; midway between the neighbouring scores, the lowest such on ties.
    Zero where a side is empty. Scores are dealt into bins by their value; the driver gets a row for each bin."""
    values = common.stage(scored.groupBy("lm_score").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "scores")
    low, high, n_a, n_r = values.agg(F.min("lm_score"), F.max("lm_score"), F.sum("a"), F.sum("r")).first()
    if not n_a or not n_r:
        return 0.0
    place = F.least(F.lit(bins - 1), F.floor((F.col("lm_score") - low) / max(high - low, 1e-300) * bins)).cast("int").alias("bin")
    binned = values.select("*", place)
    rows, base, a, r = sorted(binned.groupBy("bin").agg(F.min("lm_score"), F.sum("a"), F.sum("r")).collect()), [], 0, 0
    for k, (at, _, x, y) in enumerate(rows):
        base.append((at, a, r, rows[k + 1][1] if k + 1 < len(rows) else None))
        a, r = a + x, r + y
    w = Window.partitionBy("bin").orderBy("lm_score")
    known = binned.join(F.broadcast(values.sparkSession.createDataFrame(base, "bin int, a0 long, r0 long, next double")), "bin")
    after = F.coalesce(F.lead("lm_score").over(w), "next")
    cut = F.coalesce((F.col("lm_score") + after) / 2, F.col("lm_score") + 1e-9)
    right = (n_a - F.col("a0") - F.sum("a").over(w)) / F.lit(n_a) + (F.col("r0") + F.sum("r").over(w)) / F.lit(n_r)
    best = known.select(right.alias("right"), cut.alias("cut")).orderBy(F.desc("right"), "cut").first()
    return low - 1e-9 if best["right"] <= 1.0 else best["cut"]


def train(pages: DataFrame, url_col: str = "url", *, rules=RULES, order: int = 5) -> Counts | None:
    """Both models, from all URLs that a rule decides, each different text of a verdict once. One in five, by its hash, is kept for the calibration, but
    of fewer than five of a verdict none. None where no rule decided for one of the sides."""
    url = F.col(url_col).cast("string")
    host, path = host_of(url), path_of(url)
    verdict = F.col("verdict")
    side = lambda v: F.max((verdict == v).cast("long"))
    decided = pages.select(rule_of(host, path, rules)[1].alias("verdict"), model_text(url).alias("text")).where("verdict is not null").groupBy("text").agg(side("allow").alias("a"), side("block").alias("r"))
    texts = common.stage(decided.select("text", "a", "r", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held"), F.monotonically_increasing_id().alias("id")), "urls")
    rest = lambda c: F.sum(F.when(F.col("held"), 0).otherwise(F.col(c)))
    n_a, n_r, rest_a, rest_r = texts.agg(F.sum("a"), F.sum("r"), rest("a"), rest("r")).first()
    if not n_a or not n_r:
        return None
    held = {c: F.col("held") if n >= 5 and left else F.lit(False) for c, n, left in (("a", n_a, rest_a), ("r", n_r, rest_r))}
    of = lambda here: [F.when(held[c] if here else ~held[c], F.col(c)).otherwise(0).cast("long").alias(c) for c in held]
    counted = _grams(texts.select("text", *of(False)).where("a + r > 0"), order, ["a", "r"], combine=True)
    sums = F.sum("a").alias("a"), F.sum("r").alias("r")
    out = Counts(common.stage(_parts(counted.groupBy("code").agg(*sums), order).groupBy("part").agg(*sums), "grams"), order)
    kept = texts.select("id", "text", *of(True)).where("a + r > 0")
    out.threshold = calibrate(out.scores(kept).join(kept, "id").select("lm_score", "a", "r"))
    return out


def judge(pages: DataFrame, model: Counts | None, url_col: str = "url", *, rules=RULES, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all of ``pages`` by default), host, path, rule, lm_score, verdict for every row.

    A rule's verdict holds; else block where the score is below the threshold, else allow. Null URLs and those without
    ``://`` have empty host and path and get the score of the empty text. Without a model (one side had no URL) what
    no rule decides is allowed, with a null score. Repeated rows are judged alike, each different text is scored once, very long URLs are scored whole, an empty table gives no
    rows. Columns with the names of results are replaced, others stay."""
    results = ("host", "path", "rule", "lm_score", "verdict")
    keep = [c for c in (columns or pages.columns) if c not in results]
    url = F.col(url_col).cast("string")
    # the text stands beside the kept columns under a name that none of them has
    name = "_text" + "_" * max(map(len, ["", *keep]))
    split = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"), model_text(url).alias(name))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    split = split.withColumn("rule", rule).withColumn("verdict", ruled)
    if model is None:
        return split.select(*keep, "host", "path", "rule", F.lit(None).cast("double").alias("lm_score"), F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    texts = common.stage(pages.select(model_text(url).alias("text")).distinct().withColumn("id", F.monotonically_increasing_id()), "urls")
    known = model.scores(texts).join(texts, "id").select(F.col("text").alias(name), "lm_score")
    scored = split.join(known, name, "left")
    verdict = F.coalesce("verdict", F.when(F.col("lm_score") < model.threshold, "block").otherwise("allow"))
    return scored.select(*keep, "host", "path", "rule", "lm_score", verdict.alias("verdict"))


def op10_url_ratio(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages", "page_id", "url")
    return judge(pages, train(pages), columns=["page_id"])
