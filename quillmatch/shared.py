"""Tables in the folder that a cluster shares: lineage is cut there, and a lost executor loses none of it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and Spark runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context = spark.sparkContext  # the setting is fixed once a session runs, so the folder is kept here
        folder = getattr(context, "_quillmatch_folder", None) or tempfile.mkdtemp(prefix="quillmatch-")
        context._quillmatch_folder = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that no table has."""
    return f"{shared_folder(spark)}/quillmatch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table of the shared folder (at ``path``, if given), read again."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table; whatever still reads it must be consumed before."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes the tables that this application wrote; results that still read them must be consumed before."""
    delete(spark, f"{shared_folder(spark)}/quillmatch-{spark.sparkContext.applicationId}")
