"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours move to its least neighbour; small: its smaller ones and itself."""
    if large:
        around = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
    else:
        around = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("o"))
    least = around.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"))
    if large:  # written, so that the join shuffles both sides and the neighbours of a hot centre can be split
        least = durable(least)
    moved = around.join(least, "n")
    if large:
        out = moved.where("o > n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("o").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """node, root (the least node of its component) of every node that has an edge.

    Every round is a few joins and partial aggregations, cut through the shared
    checkpoint folder; no edge or label reaches the driver.
    """
    now = durable(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    for _ in range(rounds):
        now = durable(_star(_star(now, True), False))
        fresh = mark(now)
        if fresh == seen:
            break
        seen = fresh
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
