"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every linked node; root is the smallest node of its component.

    Each round points the neighbours of a node to the smallest of them: first the larger neighbours,
    then the others. A node's neighbours are only aggregated (minimum), never gathered in one place,
    and rounds grow with the logarithm of the longest chain. Lineage is cut by a written table.
    """
    edges = written(links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x <> y").distinct(), "edges")
    while True:
        # large star: the larger neighbours v of u go to the least of u and its neighbours
        both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        # small star: u and its smaller neighbours go to the least of them
        large = written(large.distinct(), "star")
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(low.select("x", F.col("m").alias("y"))).where("x <> y").distinct()
        new = written(small, "edges")
        # done when every node points to a root: no target points on, and each node has one target
        tail = new.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
        moving = tail.where("c > 1").limit(1).union(new.select("y").distinct().join(new.select(F.col("x").alias("y")).distinct(), "y", "left_semi").withColumn("c", F.lit(1).cast("long")).limit(1))
        edges = new
        if moving.isEmpty():
            break
    roots = edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
