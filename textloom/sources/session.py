"""What a session needs before Python runs on executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, unless the driver's settings let their Python find it anyway."""
    root = Path(__file__).resolve().parents[2]
    if _shipped == [spark.sparkContext.applicationId] or os.getcwd() == str(root) or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped[:] = [spark.sparkContext.applicationId]
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='textloom-')}/textloom", "zip", root, "textloom"))
