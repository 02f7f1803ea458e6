"""From raw documents to packed sequences of token ids, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.exact_dedup import keep_first_copies
from lexispark.llm.ngram_join import keep_one_of_each
from lexispark.llm.packing import pack
from lexispark.llm.quality import score_quality
from lexispark.llm.secrets import redact
from lexispark.runtime import checkpointed, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    return score_quality(docs, read_table(spark, sf_dir, "labels")).filter("predicted = 1").select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return keep_first_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by links the one with the least id."""
    return keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of secrets and the length as it then is."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' token ids with their places in sequences of 4096."""
    return pack(docs, with_ids=True)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("secrets", secrets), ("packing", packing)]
#: The stages train a classifier and pack by dynamic programming, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
