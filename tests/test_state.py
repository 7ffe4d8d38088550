import datetime

import pytest
from pyspark.sql import functions as F

from textloom.operators import profile
from textloom.sources.config import Http
from textloom.sources.files import new_files
from textloom.streaming.crawl import host_waits, retries
from textloom.streaming.index_stream import source_counts


def test_retries_keep_state_over_batches(spark, tmp_path):
    schema = "host string, url_norm string, status int, retry_after double, at double"
    for n in range(4):
        spark.createDataFrame([("h", "u", 429, 5.0 if n == 0 else None, float(n)), ("h", "v", 200 if n else 429, None, float(n))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = retries(stream, Http(too_many_retries=3)).writeStream.format("memory").queryName("retried").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.url_norm, r.attempts, r.dead) for r in spark.table("retried").collect())
    assert got == [("u", 1, False), ("u", 2, False), ("u", 3, False), ("u", 4, True), ("v", 1, False)]


def test_waits_of_hosts(spark):
    schema = "host string, url_norm string, status int, retry_after double, at double"
    rows = spark.createDataFrame([("h", f"u{i}", 429, 5.0, float(i)) for i in range(2000)] + [("h", "x", 200, 99.0, 9999.0), ("g", "v", 429, None, 1.0)], schema)
    assert {r.host: r.until for r in host_waits(rows).collect()} == {"h": 2004.0, "g": 16.0}


def test_counts_by_window(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, 10, m), "s") for m in (1, 2, 59)] + [(datetime.datetime(2024, 1, 1, 13, 0), "s")]
    spark.createDataFrame(rows, "ts timestamp, source_name string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, source_name string").parquet(f"{tmp_path}/in")
    query = source_counts(stream).writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.n for r in spark.table("counted").collect()] == [3]


def test_profiles(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é", "a"), (2, None, "b"), (3, "x" * 1000, "a")], "id long, html string, source_name string")
    assert tuple(profile.lengths(rows).first()) == (0, 1000, pytest.approx(1002 / 3), 1, 2)
    assert [tuple(r) for r in profile.by_source(rows).collect()] == [("a", 2), ("b", 1)]
    assert profile.missing(rows, ["id", "html"]).first()[0] == 1
    assert [r.id for r in profile.latest(rows, "id", "id", 2).collect()] == [3, 2]
    assert profile.sample(rows, ["nothing", "id"], 1).columns == ["id"] and profile.sample(rows, ["nothing"], 1).columns == rows.columns
    rows.createOrReplaceTempView("profiled")
    assert [(r.column, r.position) for r in profile.describe_tables(spark, ["profiled"]).orderBy("position").collect()] == [("id", 0), ("html", 1), ("source_name", 2)]
    rows.write.mode("overwrite").parquet(f"{tmp_path}/t")
    spark.read.parquet(f"{tmp_path}/t").createOrReplaceTempView("sized")
    (size,) = profile.table_sizes(spark, ["sized"]).collect()
    assert size.table == "sized" and size.bytes > 100
    with pytest.raises(ValueError):
        profile.describe_tables(spark, [], ["absent_table"])


def test_new_files(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    none = spark.createDataFrame([], "path string, size long, modified timestamp")
    first = new_files(spark, str(tmp_path), none)
    assert first.count() == 1
    marker = spark.createDataFrame(first.collect(), none.schema)
    (tmp_path / "b").write_text("2")
    assert [r.path.rpartition("/")[2] for r in new_files(spark, str(tmp_path), marker).select(F.col("path")).collect()] == ["b"]


def test_tables_in_between_have_bounded_row_groups(spark):
    import glob

    import pyarrow.parquet as pq

    from textloom.sources.scratch import DECODED_ROWS, GROUP_BYTES, limit_batches, written

    text = F.concat(*[F.sha2(F.concat("id", F.lit(f"-{k}")), 512) for k in range(8)])
    back = written(spark.range(0, 48_000, 1, 1).select("id", text.alias("text")), "groups")
    (file,) = glob.glob(f"{back.inputFiles()[0].removeprefix('file://').rpartition('/')[0]}/*.parquet")
    groups = [pq.ParquetFile(file).metadata.row_group(k).total_byte_size for k in range(pq.ParquetFile(file).num_row_groups)]
    assert len(groups) > 1 and max(groups) <= 1.25 * GROUP_BYTES
    assert back.agg(F.count("*"), F.countDistinct("text")).first() == (48_000, 48_000)
    limit_batches(spark)
    assert 0 < int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= DECODED_ROWS
