"""Tables in between: what one stage writes for the next, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch between the JVM and Python.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
#: Bytes of a Parquet row group of the tables in between, and rows that a reader decodes at once. Spark's own values (128 MB,
#: 4096 rows) let what a task holds in the heap grow with the input, as writers and readers hold whole row groups.
GROUP_BYTES, DECODED_ROWS = 16 << 20, 512

_own_dir: list[str] = []


def limit_batches(spark: SparkSession) -> None:
    """Bound what an Arrow batch and a batch of the Parquet reader hold, so that many long texts never meet in one. The
    settings are the session's, as Spark has no others for it; fewer rows, if set, stay as they are."""
    for rows, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", DECODED_ROWS)):
        if not 0 < int(spark.conf.get(rows)) <= most:
            spark.conf.set(rows, most)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where executors share the driver's disk (a local master, as in tests)
    it may be unset; then it is a temporary one that goes when Python ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="textloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage, so that later
    stages neither repeat the work nor depend on any executor that did it."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> None:
    """Delete all tables that written() has made in this application. Results that were not saved cannot be read then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
