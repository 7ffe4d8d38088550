"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]: one JSON line with the seconds of each.

Each query is run to the end (its rows are counted by a noop write), once to warm up on the smallest tables
and then once on the given ones."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from textloom import queries
from textloom.operators import index, search
from textloom.sources.tables import clean_docs

HEADLINES = ["postings_long", "term_frequency", "zipf_rank", "zipf_fit", "bool_nested", "search_top5", "search_many", "html_clean_native", "html_clean_tree", "url_normalize", "recrawl_decision", "upsert_snapshot", "category_bfs"]
WARM = "/root/testdata/sf0.001"


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    all_queries, took = queries.queries(), {}

    def timed(name: str, df) -> None:
        began = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)

    for name in HEADLINES:
        all_queries[name](spark, WARM).write.format("noop").mode("overwrite").save()
        timed(name, lambda name=name: all_queries[name](spark, folder))
    # The same search over an index that is stored, sorted by term so that row groups can be skipped.
    docs, store = clean_docs(spark, folder), tempfile.mkdtemp(prefix="textloom-bench-")
    began = time.perf_counter()
    index.postings(docs).repartitionByRange(int(cpus), "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{store}/postings")
    took["index_build_stored"] = round(time.perf_counter() - began, 3)
    stored = spark.read.parquet(f"{store}/postings")
    for state in ("cold", "warm"):
        timed(f"bool_nested_stored_{state}", lambda: search.search(stored, docs, queries.FLAGSHIP))
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
