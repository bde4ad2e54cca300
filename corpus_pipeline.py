"""A training corpus from raw documents: the operators of ``tidemark.llm`` as stages.

Each stage takes (spark, docs, sf_dir) and returns the rows that stay, with the columns they came with; the last one
returns tokens. Between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, naming, pieces, simhash
from tidemark.llm.common import fresh, select
from tidemark.session import new_path, remove, scratch

#: Documents are rejected that have no letter or whose best language has less than this share of their trigrams.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; filters are learned from the documents that carry a language."""
    name, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = language.with_language(docs, language.learn(docs), "text", name, score)
    return select(found.filter((F.col(name) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)), docs.columns)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id."""
    return naming.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near-equal fingerprints the one with the smallest id."""
    return simhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item occurs within its error budget."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document left."""
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", without_exact_copies),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece", tokens),
]

#: Learned language filters, XXH64 fingerprints and subword merges aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage staged, and its input, go once its rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, function in STAGES:
        path = new_path(spark, "pipeline")
        with scratch(spark):
            function(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
