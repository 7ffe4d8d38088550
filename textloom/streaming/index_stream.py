"""The index and the page store kept up to date from streams.

Each micro-batch is written under its number, so one that is run again after a failure replaces its own
output (idempotent), and reads of the whole see each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.index import postings, term_frequencies
from textloom.operators.ingest import newest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the document files that appear in a folder; the source remembers what it has read."""
    rows = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.select("doc_id", F.col("text").alias("clean_text"), F.col("source").alias("source_name"))


def index_stream(docs: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Postings and term counts of each micro-batch, under store/postings and store/counts. Runs until the
    folder is read (availableNow); starting it again resumes behind the last committed batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        postings(batch).write.mode("overwrite").parquet(f"{store}/postings/batch={number}")
        term_frequencies(batch).write.mode("overwrite").parquet(f"{store}/counts/batch={number}")
        batch.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_postings(spark: SparkSession, store: str) -> DataFrame:
    """(term, doc_id) of all batches, each once even if a document came in several."""
    return spark.read.parquet(f"{store}/postings").select("term", "doc_id").distinct()


def stored_frequencies(spark: SparkSession, store: str) -> DataFrame:
    """(term, freq) of all batches."""
    return spark.read.parquet(f"{store}/counts").groupBy("term").agg(F.sum("freq").alias("freq"))


def page_stream(results: DataFrame, store: str, checkpoint: str, compact_every: int = 20) -> StreamingQuery:
    """Rows of raw pages merged into a store: each batch adds store/delta=<batch>, with its own keys alone; every
    compact_every batches all before are merged into store/base=<batch>. snapshot() reads the whole."""
    spark = results.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        newest(batch, KEY, TIME).write.mode("overwrite").parquet(f"{store}/delta={number}")
        if (number + 1) % compact_every == 0:
            _merged(spark, store, number).write.mode("overwrite").parquet(f"{store}/base={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


KEY, TIME = "url_norm", "fetched_at_unix"


def _merged(spark: SparkSession, store: str, last: int | None) -> DataFrame | None:
    """One row for each key of the last whole base and the batches after it, up to `last`."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(store)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
    whole = {kind: sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}=") and files.exists(hadoop.Path(f"{store}/{n}/_SUCCESS"))) for kind in ("base", "delta")}
    bases = [n for n in whole["base"] if last is None or n < last]
    base = bases[-1] if bases else -1
    paths = [f"{store}/base={base}"] * bool(bases) + [f"{store}/delta={n}" for n in whole["delta"] if n > base and (last is None or n <= last)]
    if not paths:
        return None
    parts = [spark.read.parquet(p) for p in paths]  # one by one, as folder names would become columns
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return newest(both, KEY, TIME) if len(parts) > 1 else both


def snapshot(spark: SparkSession, store: str) -> DataFrame | None:
    """The pages of a store, None if there are none. Keys that only ever were said to be unchanged are none."""
    found = _merged(spark, store, None)
    if found is None:
        return None
    there = F.lit(False)
    for c in found.columns:
        if c not in (KEY, TIME, "url"):
            there = there | F.col(c).isNotNull()
    return found.where(there)


def source_counts(docs: DataFrame, time_col: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, source_name, n) of a stream with times: counts by source and window, late rows within the watermark."""
    own = docs.withWatermark(time_col, late)
    return own.groupBy(F.window(time_col, window).alias("w"), "source_name").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "source_name", "n")
