"""The inverted index: postings, document and corpus frequencies, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import folded, raw_tokens, stem
from textloom.sources.scratch import written
from textloom.sources.tables import spread


def token_rows(docs: DataFrame, text_col: str = "clean_text") -> DataFrame:
    """(doc_id, token): all tokens in a row each, without their stems."""
    return docs.select("doc_id", F.explode(raw_tokens(F.col(text_col))).alias("token")).select("doc_id", folded(F.col("token")).alias("token"))


def postings(docs: DataFrame, text_col: str = "clean_text") -> DataFrame:
    """(term, doc_id), each once. A document's repeated tokens go before anything is stemmed or shuffled."""
    distinct = spread(docs.select("doc_id", text_col)).select("doc_id", F.explode(F.array_distinct(raw_tokens(F.col(text_col)))).alias("token"))
    return distinct.select(stem(folded(F.col("token"))).alias("term"), "doc_id").distinct()


def postings_of(docs: DataFrame, terms: list[str], text_col: str = "clean_text") -> DataFrame:
    """postings() of some terms alone, without an index: a stem is the beginning of its token (and the token itself if
    that begins with an ASCII character), so other tokens go before anything is stemmed or shuffled."""
    token = F.col("token")
    plain, stems = [t for t in terms if t < "\x80"], [t for t in terms if t >= "\x80"]
    may = token.isin(plain) if plain else F.lit(False)
    for t in stems:
        may = may | token.startswith(t)
    rows = spread(docs.select("doc_id", text_col)).select("doc_id", F.explode(raw_tokens(F.col(text_col))).alias("token")).select("doc_id", folded(token).alias("token")).where(may)
    return rows.select(stem(token).alias("term"), "doc_id").where(F.col("term").isin(terms)).distinct()


def term_frequencies(docs: DataFrame, text_col: str = "clean_text") -> DataFrame:
    """(term, freq). Tokens are counted first (with partial counts before the shuffle), so stems are worked
    out once for each distinct token."""
    counted = token_rows(spread(docs.select("doc_id", text_col)), text_col).groupBy("token").agg(F.count("*").alias("n"))
    return counted.groupBy(stem(F.col("token")).alias("term")).agg(F.sum("n").alias("freq"))


def document_frequencies(of: DataFrame) -> DataFrame:
    """(term, df) of postings."""
    return of.groupBy("term").agg(F.count("*").alias("df"))


def ranked(frequencies: DataFrame) -> DataFrame:
    """frequencies with rank from 1: by freq descending, then term.

    A window without a partition would sort all terms in one task. Instead a histogram of the distinct
    frequencies, which are far fewer than terms, gives each frequency's first rank, and terms of equal
    frequency are numbered among themselves. Rare terms, of which there are many of one frequency, are
    dealt by their first letters as well."""
    own = frequencies.withColumn("_slot", F.substring("term", 1, 2))
    # (freq, slot) pairs in rank order; their running sum is the rank before each.
    sizes = own.groupBy("freq", "_slot").agg(F.count("*").alias("_n"))
    by_freq = sizes.groupBy("freq").agg(F.sum("_n").alias("_of_freq"))
    before_freq = by_freq.select("freq", (F.sum("_of_freq").over(Window.orderBy(F.desc("freq"))) - F.col("_of_freq")).alias("_before"))
    before_slot = F.sum("_n").over(Window.partitionBy("freq").orderBy("_slot")) - F.col("_n")
    starts = sizes.withColumn("_inside", before_slot).join(before_freq, "freq").select("freq", "_slot", (F.col("_before") + F.col("_inside")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("freq", "_slot").orderBy("term"))
    return own.withColumn("_place", place).join(starts, ["freq", "_slot"]).withColumn("rank", F.col("_start") + F.col("_place")).drop("_slot", "_place", "_start")


def frequencies(docs: DataFrame, text_col: str = "clean_text") -> DataFrame:
    """(term, freq, df) in one scan: texts are dealt by id, so that a document's tokens, and the terms made of them,
    are counted where they are, and only counts by term are shuffled again."""
    # A number of partitions keeps small texts from being read by one task; large ones have as many as shuffles have.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", F.col(text_col).alias("_text")).repartition(parts, "doc_id")
    counted = token_rows(dealt, "_text").groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    terms = counted.groupBy("doc_id", stem(F.col("token")).alias("term")).agg(F.sum("n").alias("n"))
    return terms.groupBy("term").agg(F.sum("n").alias("freq"), F.count("*").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "clean_text") -> DataFrame:
    """(rank, term, freq, df). The counts are written once, since ranking reads them more than once."""
    return ranked(written(frequencies(docs, text_col), "frequencies")).select(F.col("rank").cast("long"), "term", "freq", "df")
