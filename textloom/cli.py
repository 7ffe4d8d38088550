"""Queries from the command line: python -m textloom.cli DOCUMENTS [POSTINGS]; !q or the end of input ends it."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import index, search
from textloom.plans.boolean import QueryError


def answer(postings: DataFrame, docs: DataFrame, line: str, shown: int = 5) -> list[str]:
    """The lines to print for a query: the number of hits and the first ones, or what is wrong with it."""
    try:
        hits = search.search(postings, docs, line).persist()
    except QueryError as e:
        return [f"error: {e}"]
    try:
        rows = search.display(hits, docs, shown).orderBy("doc_id").collect()
        return [f"{hits.count()} found", *[f"{r.doc_id} ({r.source_name}): {r.snippet}" for r in rows]]
    finally:
        hits.unpersist()


def main(arguments: list[str]) -> int:
    if not arguments:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    docs = spark.read.parquet(arguments[0]).select("doc_id", F.col("text").alias("clean_text"), F.col("source").alias("source_name"))
    postings = spark.read.parquet(arguments[1]) if len(arguments) > 1 else index.postings(docs).persist()
    for line in sys.stdin:
        if line.strip() == "!q":
            break
        print("\n".join(answer(postings, docs, line)), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
