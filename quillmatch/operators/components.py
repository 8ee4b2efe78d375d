"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.shared import delete, new_path, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (or itself)."""
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("least"))
    return both.join(least, "n").where("m > n").select(F.col("m").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them. ``edges`` has a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return linked.union(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node of its component. Nodes without an edge are not returned.

    Each round is written to the shared folder, so neither the plan nor a node's links grow with the rounds, and no node or
    link reaches the driver. A round's table is deleted once the next one is written, so two are there at most. Null ends and self-links are ignored.
    """
    left, right = F.col(f"`{a}`"), F.col(f"`{b}`")
    links = edges.where(left.isNotNull() & right.isNotNull() & (left != right)).select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct()
    spark = edges.sparkSession
    path = new_path(spark, "links")
    links, before = written(links, path=path), None
    for _ in range(most_rounds):
        last, path = path, new_path(spark, "links")
        links = written(_small_star(_large_star(links)), path=path)
        delete(spark, last)
        # All stars point at their least node once no link changes; the sum over links tells.
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b"), F.col("b")).distinct())
