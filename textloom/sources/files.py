"""Seed lists, index exports and table dumps as files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.sources.tables import SEEDS


def write_seeds(seeds: DataFrame, path: str) -> None:
    """Tab-separated seeds with a header."""
    seeds.select("url", "title", "page_id", "namespace", "source").write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def read_seeds(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(url, source): the first and the last field of each line with two fields or more. Lines may be ragged."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("parts"))
    out = lines.where(F.size("parts") >= 2).select(F.trim(F.col("parts")[0]).alias("url"), F.trim(F.element_at("parts", -1)).alias("source"))
    out = out.where((F.col("url") != "") & (F.col("source") != ""))
    return out.where(~((F.col("url") == "url") & (F.col("source") == "source"))) if header else out


def seed_schema() -> str:
    return SEEDS


def write_postings(postings: DataFrame, path: str) -> None:
    """term, df, docs: the ids of each term joined by bars, in order. The wide form is for exchange only."""
    wide_postings(postings).write.mode("overwrite").option("header", True).csv(path)


#: Ids of a line at most: a term that more documents have, or a universe, takes several lines.
IDS_OF_A_LINE = 1 << 20


def wide_postings(postings: DataFrame) -> DataFrame:
    """(term, df, docs string), a row for each term and IDS_OF_A_LINE ids; df counts all documents of the term."""
    ids = F.array_sort(F.collect_list("doc_id"))
    block = F.floor(F.col("doc_id") / F.lit(IDS_OF_A_LINE))
    grouped = postings.groupBy("term", block.alias("_block")).agg(F.count("*").alias("_n"), ids.alias("_ids"))
    lines = grouped.select("term", "_block", "_n", F.concat_ws("|", F.col("_ids").cast("array<string>")).alias("docs"))
    return lines.select("term", F.sum("_n").over(Window.partitionBy("term")).alias("df"), "docs")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """The long form of an export; lines whose df is no number are skipped."""
    rows = spark.read.schema("term string, df string, docs string").option("header", True).csv(path)
    rows = rows.where(F.expr("try_cast(df AS bigint)").isNotNull())
    ids = F.split(F.regexp_replace("docs", "\r$", ""), r"\|").cast("array<bigint>")
    return rows.select("term", F.explode(ids).alias("doc_id"))


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """rank, term, freq in rank order."""
    lexicon.select("rank", "term", "freq").orderBy("rank").write.mode("overwrite").option("header", True).csv(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(rank, term, freq); rows whose numbers cannot be read are dropped, and none left is an error."""
    rows = spark.read.option("header", True).csv(path)
    if missing := {"rank", "freq"} - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    out = rows.select(F.expr("try_cast(rank AS double)").alias("rank"), F.col("term") if "term" in rows.columns else F.lit(None).cast("string").alias("term"), F.expr("try_cast(freq AS double)").alias("freq"))
    out = out.dropna(subset=["rank", "freq"])
    if out.isEmpty():
        raise ValueError("no readable rows")
    return out


def write_universe(docs: DataFrame, path: str) -> None:
    """All ids, joined by bars, IDS_OF_A_LINE on a line."""
    block = F.floor(F.col("doc_id") / F.lit(IDS_OF_A_LINE))
    joined = docs.groupBy(block.alias("_block")).agg(F.concat_ws("|", F.array_sort(F.collect_list("doc_id")).cast("array<string>")).alias("value"))
    joined.select("value").write.mode("overwrite").text(path)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    ids = F.split("value", r"\|").cast("array<string>")
    return spark.read.text(path).select(F.explode(ids).alias("id")).select(F.expr("try_cast(id AS bigint)").alias("doc_id")).where("doc_id is not null")


_VALUE = re.compile(rb"'((?:[^'\\]|\\.|'')*)'|([^,()']+)", re.DOTALL)
_ESCAPES = {b"0": b"\0", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"Z": b"\x1a", b"b": b"\b"}


def _tuples(line: bytes) -> Iterator[list[bytes | None]]:
    """The value tuples of an INSERT statement."""
    at = line.find(b"VALUES")
    if at < 0:
        return
    row: list[bytes | None] | None = None
    at += 6
    while at < len(line):
        c = line[at : at + 1]
        if c == b"(" and row is None:
            row = []
        elif c == b")" and row is not None:
            yield row
            row = None
        elif row is not None and c not in b", " and (m := _VALUE.match(line, at)):
            if m[1] is not None:
                row.append(re.sub(rb"\\(.)|''", lambda e: b"'" if e[1] is None else _ESCAPES.get(e[1], e[1]), m[1], flags=re.DOTALL))
            else:
                row.append(None if m[2].strip() == b"NULL" else m[2].strip())
            at = m.end()
            continue
        at += 1


def read_dump(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """The rows of a table dump (SQL text, gzipped or not) as strings; values that are not UTF-8 get U+FFFD.
    A gzipped dump cannot be split, so one task reads a file; the files of many projects are read side by side."""
    lines = spark.read.format("text").load(path).where(F.startswith("value", F.lit(f"INSERT INTO `{table}`"))).select(F.col("value").cast("binary"))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for line in frame["value"]:
                yield pd.DataFrame([[None if v is None else v.decode("utf-8", "replace") for v in r[: len(columns)]] for r in _tuples(line)], columns=columns)

    return lines.mapInPandas(rows, ", ".join(f"{c} string" for c in columns))


def new_files(spark: SparkSession, path: str, marker: DataFrame) -> DataFrame:
    """(path, size, modified) of the files that a marker table of the same columns does not have yet."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.join(marker, ["path", "size", "modified"], "left_anti")
