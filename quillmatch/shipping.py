"""Gives executors this package, so that functions of it run there without an installation."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Once for a Spark context. Sessions whose Arrow batches have Spark's own bound of bytes get a smaller one: a batch is held in the JVM and twice in the Python worker."""
    context = spark.sparkContext
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, str(64 << 20)).rstrip("b") == str(64 << 20):
        spark.conf.set(bound, str(BATCH_BYTES))
    if getattr(context, "_quillmatch_shipped", False):
        return
    package = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="quillmatch-")), "quillmatch.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(path)
    context._quillmatch_shipped = True
