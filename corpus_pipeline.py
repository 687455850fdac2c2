"""A corpus from raw documents to token ids: the stages in order, and ``run``, which applies them.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, linededup, mixing, neardup, quality
from spanloom.llm.common import table, work_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the trained verdict rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.apply(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts keep their lines but those that a document with a smaller doc_id holds."""
    return linededup.apply(docs).withColumn("n_chars", F.length("text").cast("long"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, Jaccard similarity 0.8 or more."""
    return neardup.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights."""
    return mixing.apply(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, decoded again for their digests."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("source mixing", source_mixing),
    ("bpe encoding and decoding", bpe_encoding),
]

#: The trained stages can't be written in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
