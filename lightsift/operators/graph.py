"""Connected components, and work inside of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightsift.session import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every linked node; root is the least node of its component.

    Rounds alternate: the larger neighbours of a node are pointed to the least of them, then the others. Neighbours
    are only aggregated, so no node is too large for a task, and a chain halves in each round.
    """
    edges = written(links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x <> y").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        larger = written(both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        low = larger.groupBy("x").agg(F.min("y").alias("m"))
        smaller = larger.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        edges = written(smaller.unionByName(low.select("x", F.col("m").alias("y"))).where("x <> y").distinct())
        # settled when each node has one target and no target points on
        many = edges.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x")
        on = edges.select(F.col("y").alias("x")).join(edges.select("x"), "x", "left_semi")
        if many.unionByName(on).isEmpty():
            break
    found = edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
