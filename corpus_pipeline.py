"""A corpus pipeline: each stage applies one operator to what the stage before it kept.

Language ID (what it rejects goes), exact and near duplicates (one document of each group stays), mixing (documents are
repeated or left out so that sources meet their weights), and encoding (the tokens of each document).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchspark.llm import bpe, exact_dedup, langid, minhash, mixing
from patchspark.llm.store import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those further from all languages than texts are.

    Learns from the rows of docs that have a language; without any, all documents go. Rows that share an id are judged
    one by one.
    """
    return langid.recognised(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the smallest doc_id stays; null ids come last.

    Rows that share the staying id and text all stay.
    """
    return exact_dedup.one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; rows without words or id all stay."""
    return minhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times; a null source is a source, rows of one id share a decision."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source (those there are), n_tokens, ids_sha256, decoded_sha256 and ids of each row of the mix."""
    return bpe.encoded(docs, ["doc_id", "lang", "source"], lasting=False)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("encoding", encode)]

#: Centroids, signatures and merges are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each result written as Parquet and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
