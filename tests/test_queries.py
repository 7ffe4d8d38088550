"""Every query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from textloom import queries as own

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query(spark, duck, name):
    got = own.queries()[name](spark, FOLDER)
    relation = duck.execute(own.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    expected = sorted(str([_plain(r[names.index(c)]) for c in sorted(names)]) for r in relation.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert sorted(str([_plain(r[c]) for c in sorted(names)]) for r in got.collect()) == expected


@pytest.mark.parametrize("name", ["crawl_counters", "upsert_snapshot"])
def test_pages_of_one_url_and_time(spark, tmp_path, name):
    """As above on pages that say the same URL several times, some of them at one time: the first page counts."""
    pages = [(n, f"https://ex.com/{n % 7}", f"<p>{n}</p>" if n % 5 else "<p>same</p>") for n in range(400)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = own.queries()[name](spark, str(tmp_path))
    connection = duckdb.connect(config={"threads": 1})  # several threads leave open which of such pages arg_max() sees first
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet' ORDER BY page_id")
    relation = connection.execute(own.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(str([_plain(r[c]) for c in names]) for r in got.collect()) == sorted(str([_plain(x) for x in r]) for r in relation.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
