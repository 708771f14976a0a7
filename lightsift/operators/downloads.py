"""What may be served and downloaded: allowed paths, selections with their sizes, and names inside an archive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allowed(asked: DataFrame, frames: DataFrame) -> DataFrame:
    """asked (path) with allowed: true for paths of the run's frames, compared without '.', '..' and doubled slashes."""
    known = frames.select(plain("path").alias("_p")).distinct().withColumn("allowed", F.lit(True))
    out = asked.withColumn("_p", plain("path")).join(known, "_p", "left").drop("_p")
    return out.withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def plain(path: str) -> F.Column:
    """A path with its '.' and '..' parts resolved and single slashes."""
    parts = F.filter(F.split(F.col(path).cast("string"), "/+"), lambda p: (p != "") & (p != "."))
    walk = F.aggregate(parts, F.array().cast("array<string>"), lambda up, p: F.when(p == "..", F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(0)))).otherwise(F.concat(up, F.array(p))))
    return F.concat(F.when(F.col(path).cast("string").startswith("/"), "/").otherwise(""), F.array_join(walk, "/"))


def selection(wanted: DataFrame, frames: DataFrame, files: DataFrame) -> DataFrame:
    """The wanted paths (path, pos) that the run knows, each once at its first place, with size; missing: no such file now."""
    once = wanted.groupBy("path").agg(F.min("pos").alias("pos")).join(frames.select("path").distinct(), "path", "left_semi")
    return once.join(files.select("path", "size"), "path", "left").withColumn("missing", F.col("size").isNull())


def selection_total(selected: DataFrame) -> DataFrame:
    """One row: count and bytes of what is there, and how many are missing."""
    return selected.agg(F.count_if(~F.col("missing")).alias("count"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.count_if("missing").alias("missing"))


def archive_names(files: DataFrame, written: Callable[[DataFrame], DataFrame], name: str = "name", order: str = "pos") -> DataFrame:
    """files with `archived`: the name, or where an earlier file took that, the name with the first free _2, _3, ...

    As if files were named one after the other in the (total) order. Files of one name are numbered; in each round
    the later one of two files with one new name takes its next number, and so do those of its name that follow it
    without a gap. A name once lost stays held by an earlier file, so rounds end; there are as many as real names
    that look like numbered ones clash in a chain.
    """
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    rank = F.row_number().over(Window.partitionBy(name).orderBy(order)).cast("long")
    rows = files.withColumn("_r", rank).withColumns({"_k": F.col("_r"), "_stem": stem, "_ext": ext})
    made = F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat("_stem", F.lit("_"), F.col("_k").cast("string"), "_ext"))
    while True:
        rows = written(rows.withColumn("archived", made))
        held = rows.groupBy("archived").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        beaten = rows.join(held, "archived").where(F.col(order) > F.col("_first"))
        least = beaten.groupBy(name).agg(F.min_by(F.struct(F.col(order).alias("_from"), (F.col("_k") - F.col("_r")).alias("_gap")), order).alias("_at"))
        moving = written(least.select(F.col(name).alias("_name"), "_at.*"))
        if moving.isEmpty():
            return rows.select(*files.columns, "archived")
        on = rows.join(moving, F.col(name) == F.col("_name"), "left")
        step = F.when((F.col(order) >= F.col("_from")) & (F.col("_k") - F.col("_r") == F.col("_gap")), 1).otherwise(0)
        rows = on.withColumn("_k", F.col("_k") + step).select(*files.columns, "_r", "_k", "_stem", "_ext")
