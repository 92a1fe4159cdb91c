"""The corpus pipeline: quality rules, exact and near-duplicate removal, source mixing, and encoding.

Each stage takes the session, the documents that the stage before kept, and the folder of tables.  All but the last
return the columns of documents; ``run`` writes what a stage returns and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact, mixing, near, prefix_bpe, quality
from lodestone.llm.queries import tokenizer_file
from lodestone.llm.shared import keep_table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.good_documents(docs)


def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.without_copies(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in order of training position."""
    return mixing.training_order(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and the decoded text of each document of the mix."""
    return prefix_bpe.encoded_digests(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality rules", good), ("exact dedup", once), ("near dedup", apart), ("source mix", mixed), ("byte-pair encoding", encoded)]

#: The stages of near-duplicates and encoding are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep_table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
