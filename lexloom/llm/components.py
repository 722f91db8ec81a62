"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, spread_join, written

#: Edges up to so many: then the least neighbours of all nodes are broadcast (two longs each).
BROADCAST_EDGES = 100_000


def _star(edges: DataFrame, count: int, small: bool) -> DataFrame:
    """Edges (u, v), u > v. Large: u's larger neighbours go to u's least; small: its smaller ones do."""
    near = edges.select("u", "v") if small else edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("rows"))
    if count <= BROADCAST_EDGES:
        joined = near.join(F.broadcast(least.select("u", "m")), "u")
    else:  # a hub's edges are dealt over many tasks
        joined = spread_join(near, least.select("u", "m"), ["u"], least.select("u", "rows"), total=count * (1 if small else 2))
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge and no centre has one itself; then the centres are the least of their components."""
    if not edges.groupBy("u").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge (a, b).

    Null ends and loops are ignored; no edges give no rows. A step is written to the shared
    folder, so a lost executor repeats one step at most.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = written(e, "edges")
    while not _are_stars(e):
        for small in (False, True):
            step, new = written(_star(e, e.count(), small), "edges")
            remove(spark, path)
            e, path = step, new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
