"""Dense row numbers without a single task that sorts all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.shared import written


def with_positions(df: DataFrame, to: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Adds 0, 1, 2, ... in the order of ``order_by``, or in the order in which the rows are read."""
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    # ranges are sampled, and the order of a reading may change: both hold for one reading only
    marked = written(df.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    # As many rows as partitions.
    counts = sorted((r[0], r[1]) for r in marked.groupBy(F.shiftright("__at", 33).alias("p")).count().collect())
    begin, rows = 0, []
    for p, n in counts:
        rows.append((int(p), begin))
        begin += int(n)
    begins = df.sparkSession.createDataFrame(rows or [(0, 0)], "__p long, __begin long")
    placed = marked.withColumn("__p", F.shiftright("__at", 33)).join(F.broadcast(begins), "__p")
    return placed.withColumn(to, F.col("__begin") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__p", "__begin")
