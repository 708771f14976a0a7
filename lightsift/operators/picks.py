"""Picks: who starred which frame, as a relation (path, viewer) without repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replayed(log: DataFrame) -> DataFrame:
    """Picks left by a log of (path, viewer, wanted, ts, seq): the last entry of each path and viewer counts."""
    last = F.row_number().over(Window.partitionBy("path", "viewer").orderBy(F.desc("ts"), F.desc("seq")))
    return log.withColumn("_last", last).where("_last = 1 AND wanted").select("path", "viewer")


def accepted(wishes: DataFrame, frames: DataFrame) -> DataFrame:
    """Requested changes (path, viewer, wanted, ts, seq) with `ok`: whether the path is one of the run. Only those enter the log."""
    known = frames.select("path").distinct().withColumn("ok", F.lit(True))
    return wishes.join(known, "path", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def cleared_count(picks: DataFrame, viewer: str) -> DataFrame:
    """One row: how many picks of the viewer clearing takes away."""
    return picks.agg(F.count_if(F.col("viewer") == viewer).alias("n_cleared"))


def latest_names(log: DataFrame) -> DataFrame:
    """(viewer, name) left by a log of (viewer, name, ts, seq): the last entry of each viewer, trimmed, 40 characters; an empty one deletes."""
    last = log.groupBy("viewer").agg(F.max_by("name", F.struct("ts", "seq")).alias("name"))
    return last.select("viewer", F.nullif(F.substring(F.trim("name"), 1, 40), F.lit("")).alias("name")).where("name IS NOT NULL")


def cleared(picks: DataFrame, viewer: str) -> DataFrame:
    return picks.where(F.col("viewer") != viewer)


def named(viewers: DataFrame, names: DataFrame) -> DataFrame:
    """Viewers with display names, trimmed to 40 characters; without one (or an empty one) the viewer's id."""
    own = names.select("viewer", F.nullif(F.substring(F.trim("name"), 1, 40), F.lit("")).alias("_name"))
    return viewers.join(own, "viewer", "left").withColumn("name", F.coalesce("_name", "viewer")).drop("_name")


def per_frame(picks: DataFrame, viewer: str) -> DataFrame:
    return picks.groupBy("path").agg(F.count_distinct("viewer").alias("n_picks"), F.max(F.col("viewer") == viewer).alias("mine"), F.max(F.col("viewer") != viewer).alias("others"), F.array_join(F.array_sort(F.collect_set("viewer")), ",").alias("owners"))


def pick_flags(frames: DataFrame, picks: DataFrame, viewer: str) -> DataFrame:
    """frames with n_picks, starred, mine, others and owners."""
    out = frames.join(per_frame(picks, viewer), "path", "left")
    zero = {"n_picks": F.lit(0).cast("long"), "mine": F.lit(False), "others": F.lit(False), "owners": F.lit("")}
    return out.withColumns({c: F.coalesce(c, v) for c, v in zero.items()}).withColumn("starred", F.col("n_picks") > 0)


def picked_per_burst(frames: DataFrame, picks: DataFrame) -> DataFrame:
    return frames.join(picks.select("path").distinct(), "path", "left_semi").groupBy("burst_id").agg(F.count(F.lit(1)).alias("n_picked"))


def starred(frames: DataFrame, picks: DataFrame, owner: str = "all", viewer: str = "", sort: str = "rank", matching: Callable[[DataFrame], DataFrame] = lambda f: f) -> DataFrame:
    """Picked frames by owner: all, mine or others; a frame picked by both is in both. matching: filters by shot, subject and
    hero (those of a page's query); no quality cut applies here."""
    want = {"all": F.lit(True), "mine": F.col("viewer") == viewer, "others": F.col("viewer") != viewer}[owner]
    out = pick_flags(matching(frames).join(picks.where(want).select("path").distinct(), "path", "left_semi"), picks, viewer)
    order = {"rank": [F.asc("burst_rank"), F.asc("within_burst_rank"), F.asc("path")], "stars": [F.desc("n_picks"), F.asc("burst_rank"), F.asc("path")], "time": [F.asc_nulls_last("captured_at"), F.asc("path")]}[sort]
    return out.orderBy(*order)
