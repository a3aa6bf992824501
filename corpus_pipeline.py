"""A corpus pipeline: each stage works on all documents that the stage before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as Parquet and read again as the
next stage's ``docs``.  All but the last keep the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alnspark.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from alnspark.llm.common import fresh, stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the last of them only; a document without any text left goes."""
    return line_dedup.rewrite_documents(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words a shingle, similarity 0.8) the first document stays."""
    return jaccard_join.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.query(spark, docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near duplicates", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: A classifier's fit and tokenizers are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
