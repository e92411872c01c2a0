"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of documents; the last adds the epoch. Between stages the documents are written as Parquet and read again.

Defined results: a document with a null text is one without words: the classifier scores it as an empty text, it is no
near duplicate, holds no test item and has no tokens. Documents with a null doc_id are never near duplicates; all rows of a
doc_id leave together where one of them does. Repeated rows with one doc_id and text stay or leave together. Columns may
have any names, but for epoch, which the last stage replaces. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.llm import decontam, minhash, mixing, quality
from procweave.llm.shared import bound_batches, materialize, read_table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    bound_batches(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates."""
    bound_batches(spark)
    return minhash.drop_near_duplicates(docs)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    bound_batches(spark)
    return decontam.drop_leaks(docs, decontam.load_items(read_table(spark, sf_dir, "benchmark")))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, one row for each epoch that takes them."""
    domain = mixing.domain_of(F.col("source"))
    return mixing.mix(docs, mixing.WEIGHTS, mixing.SHARE, mixing.MAX_EPOCHS, mixing.SEED, domain=domain)


STAGES = [
    ("quality_classifier", good_documents),
    ("minhash_near_dedup", distinct_documents),
    ("benchmark_decontamination", unseen_documents),
    ("source_mixing", mixed_documents),
]

#: SQL cannot express the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = materialize(docs, name) if number < len(STAGES) else docs
    return docs
