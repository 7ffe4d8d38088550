"""Profiles of a page or document table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_source(rows: DataFrame, source_col: str = "source_name") -> DataFrame:
    """(source_name, n), the most first."""
    return rows.groupBy(F.col(source_col).alias("source_name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_name")


def lengths(rows: DataFrame, text_col: str = "html", short: int = 1000) -> DataFrame:
    """(min_len, max_len, avg_len, n_empty, n_short) in UTF-8 bytes; null counts as empty, empty as short."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    return rows.agg(
        F.min(size).cast("long").alias("min_len"), F.max(size).cast("long").alias("max_len"), F.avg(size).alias("avg_len"), F.count_if(size == 0).alias("n_empty"), F.count_if(size < short).alias("n_short")
    )


def missing(rows: DataFrame, required: list[str]) -> DataFrame:
    """(n_missing): rows that lack any of the required columns' values."""
    lacks = F.lit(False)
    for c in required:
        lacks = lacks | F.col(c).isNull()
    return rows.agg(F.count_if(lacks).alias("n_missing"))


def latest(rows: DataFrame, time_col: str, id_col: str, n: int = 30) -> DataFrame:
    """The n latest rows; ties by id."""
    return rows.orderBy(F.desc(time_col), id_col).limit(n)


def count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def describe_tables(spark, names: list[str], required: list[str] | None = None) -> DataFrame:
    """(table, column, type, position) of catalog tables; a required table that is absent is an error."""
    there = {t.name for t in spark.catalog.listTables()}
    if lacking := [n for n in required or [] if n not in there]:
        raise ValueError(f"missing tables: {lacking}")
    rows = [(n, c.name, c.dataType, i) for n in names if n in there for i, c in enumerate(spark.catalog.listColumns(n))]
    return spark.createDataFrame(rows, "table string, column string, type string, position int")


def table_sizes(spark, names: list[str]) -> DataFrame:
    """(table, rows, bytes) as the optimiser estimates them, without reading the tables; rows is null where no statistics
    say (ANALYZE TABLE makes them)."""
    found = []
    for n in names:
        stats = spark.table(n)._jdf.queryExecution().optimizedPlan().stats()
        rows = stats.rowCount()
        found.append((n, int(str(rows.get())) if rows.isDefined() else None, int(str(stats.sizeInBytes()))))
    return spark.createDataFrame(found, "table string, rows long, bytes long")


def sample(rows: DataFrame, preferred: list[str], n: int = 5) -> DataFrame:
    """n rows with the preferred columns that exist, else the first six."""
    own = [c for c in preferred if c in rows.columns] or rows.columns[:6]
    return rows.select(*own).orderBy(*own[:1]).limit(n)
