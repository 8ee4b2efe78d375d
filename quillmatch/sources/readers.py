"""Reading a string column from any source that Spark reads, and writing results beside their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmatch.session import Strings


def read_strings(spark: SparkSession, path: str, column: str, format: str = "parquet", read_options: dict | None = None, **strings) -> Strings:
    """Only the columns that a match needs are read."""
    df = spark.read.format(format).options(**(read_options or {})).load(path)
    needed = dict.fromkeys([column, *filter(None, [strings.get("id"), strings.get("key")]), *strings.get("index", ()), *strings.get("order_by", ())])
    return Strings(df.select(*[f"`{c}`" for c in needed]), column, **strings)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", **options) -> None:
    df.write.format(format).mode(mode).options(**options).save(path)
