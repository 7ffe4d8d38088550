"""A pipeline over `documents`: language ID, quality rules, near-duplicates, benchmark decontamination,
SentencePiece encoding. Each stage takes (spark, docs, sf_dir), works on all rows of docs, and all but
the last return the columns of documents.

Models are learned from the whole tables in sf_dir, not from what the stages before have kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, language_id, near_dedup, quality, spm
from textloom.llm.common import dealt, written
from textloom.llm.queries import table, tokenizer_model


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that resemble no learned language, go."""
    learned = dealt(table(spark, sf_dir, "documents"))
    return language_id.in_learned_language(dealt(docs), language_id.calibrated(language_id.learn(learned), learned))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or have anomalous statistics go."""
    return quality.good_rows(docs, quality.learn(dealt(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 % of their five-word shingles, in chains, the first stays."""
    return near_dedup.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited or not, go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each document."""
    out = spm.transcode(docs, tokenizer_model(spark))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", in_known_language),
    ("quality_rules", of_quality),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: SQL expresses neither the classifiers nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
