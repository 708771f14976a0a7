"""Semantic search: a query vector against the vectors of all frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lightsift.functions.vectors import dot


def search(frames: DataFrame, query: list[float] | DataFrame, grouped: bool = False, picks: DataFrame | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Frames by descending similarity to the query vector (a list, or one row with column q).

    frames are filtered before; grouped keeps the best hit of each burst, and picks then keeps hits whose
    burst (grouped) or very frame (else) is picked.
    """
    if isinstance(query, DataFrame):
        scored = frames.crossJoin(F.broadcast(query.select("q"))).withColumn("similarity", dot(F.col("emb"), F.col("q"))).drop("q")  # one row
    else:
        scored = frames.withColumn("similarity", dot(F.col("emb"), F.array(*[F.lit(float(x)) for x in query])))
    scored = scored.drop("emb")
    order = [F.desc("similarity"), F.asc("path")]
    if grouped:
        scored = scored.withColumn("_n", F.row_number().over(Window.partitionBy("burst_id").orderBy(*order))).where("_n = 1").drop("_n")
    if picks is not None:
        if grouped:
            held = frames.join(picks.select("path").distinct(), "path", "left_semi").select("burst_id").distinct()
            scored = scored.join(held, "burst_id", "left_semi")
        else:
            scored = scored.join(picks.select("path").distinct(), "path", "left_semi")
    return scored.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))
