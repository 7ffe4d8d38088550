"""The engine's tables: explicit schemas, and readers that give them from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_PAGES = "url string, url_norm string, html string, source_name string, fetched_at_unix bigint, etag string, last_modified string, content_hash string"
CLEAN_DOCS = "doc_id bigint, src_id string, url_norm string, url_clean string, source_name string, title string, clean_text string"
SEEDS = "url string, title string, page_id bigint, namespace int, source string"
POSTINGS = "term string, doc_id bigint"
LEXICON = "rank bigint, term string, freq bigint, df bigint"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clean_docs(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, clean_text, source_name) of the documents."""
    return table(spark, folder, "documents").select("doc_id", F.col("text").alias("clean_text"), F.col("source").alias("source_name"))


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt to all cores if they lie in fewer partitions than there are cores (a file with one row group would be one
    task's work); where there are many files nothing is shuffled."""
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def universe(docs: DataFrame) -> DataFrame:
    """All document ids, in order."""
    return docs.select("doc_id").orderBy("doc_id")


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """The keys that occur more than once: an upsert's result must have none."""
    return df.groupBy(key).count().where("count > 1")
