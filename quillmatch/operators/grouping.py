"""Groups of matching rows and their representatives, and the nearest master of each duplicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.operators.components import components
from quillmatch.operators.matching import ranked


def groups(matches: DataFrame, rows: DataFrame, group_rep: str) -> DataFrame:
    """(pos, group, rep): every row's group (its least position) and the position of the group's representative.

    first: the least position. centroid: the greatest sum of similarities, of equal ones the least position.
    """
    linked = components(matches, "left_pos", "right_pos")
    grouped = rows.select("pos").join(linked.select(F.col("node").alias("pos"), F.col("component").alias("group")), "pos", "left").withColumn("group", F.coalesce("group", "pos"))
    if group_rep == "first":
        return grouped.withColumn("rep", F.col("group"))
    weights = matches.groupBy(F.col("left_pos").alias("pos")).agg(F.sum("similarity").alias("weight"))
    weighted = grouped.join(weights, "pos", "left").withColumn("weight", F.coalesce(ranked("weight"), F.lit(0.0)))
    # an aggregate, not a window: a group of any size is combined map-side
    reps = weighted.groupBy("group").agg(F.min_by("pos", F.struct((-F.col("weight")).alias("w"), "pos")).alias("rep"))
    return grouped.join(reps, "group").select("pos", "group", "rep")


def nearest(matches: DataFrame) -> DataFrame:
    """(right_pos, left_pos): for each right row the most similar left row, of equals the first."""
    order = F.struct((-ranked("similarity")).alias("s"), "left_pos")
    return matches.groupBy("right_pos").agg(F.min_by("left_pos", order).alias("left_pos"))
