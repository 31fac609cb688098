"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, extra ones too. Every stage takes nulls in any column, empty and very long texts, repeated
rows and empty tables; what it does with them is stated by its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import common, decontam, lines, packing, simhash, toxicity

#: documents of this score or more are rejected
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones, does not reject. Without labels nothing is rejected; null and empty
    texts have no feature and stay. Rows that repeat an id or text are judged alike."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="toxicity_score").where(F.col("toxicity_score") < TOXIC).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on several sites; each such line stays in one document. n_chars follows the
    text."""
    cleaned = lines.dedup_lines(docs).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cleaned


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least id: five-word shingles, a Jaccard similarity of 0.8
    or more. Documents without words are one class."""
    return simhash.representatives(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none."""
    found = decontam.contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; a null or empty text is one piece, the end id."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: neither the classifier nor the packing can be written in SQL; tests/llm/test_pipeline.py holds each stage and run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
