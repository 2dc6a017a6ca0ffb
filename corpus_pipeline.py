"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the
next stage's docs. All but the last give the columns of documents; n_chars follows the text.

Nulls, empty tables and repeated rows are treated as the operators say: of equal rows, and of rows
with the same doc_id among near copies, one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import fertility, packing, pseudonyms, queries, simhash, sparse_suffix
from tracemill.llm.shared import table, written


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands."""
    measured = fertility.measured(docs, queries.BYTE_BPE, queries.PIECES)
    return fertility.judge(measured, fertility.BANDS).filter("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, that of the smallest doc_id."""
    return simhash.without_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words only where they come first; documents with no word left go."""
    return counted(sparse_suffix.without_repeats(docs)).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by format-preserving pseudonyms."""
    return counted(pseudonyms.pseudonymised(docs, queries.KEY)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most 1024 tokens."""
    return packing.pack(packing.cut_and_encode(docs, queries.BYTE_BPE))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("personal_data", personal_data), ("packing", packed)]

#: Fertility, fingerprints and token ids have no SQL form; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
