"""Bursts: each camera's timeline cut where time gaps and embedding similarity say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightsift.functions.vectors import cosine
from lightsift.session import written

from .ordering import row_numbers, running, value_ranks

SHORT_GAP, LONG_GAP, ALIKE = 0.6, 8.0, 0.92
TIME_ONLY_GAP = 2.5


def gap_seconds(before: Column, now: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", before, now) / 1e6


def burst_ids(frames: DataFrame, short: float = SHORT_GAP, long: float = LONG_GAP, alike: float = ALIKE, similarity: bool = True) -> DataFrame:
    """frames (path, camera_id, captured_at, emb, ...; one row per path) with burst_id.

    A frame starts a burst if it is its camera's first, or comes more than `long` seconds after the frame
    before it, or more than `short` and does not look alike (a missing vector never does). Ids count
    bursts by camera and time; frames without a time get one burst each after all others, by path.
    Keys alone are sorted, in ranges, so one camera with all frames is the work of many tasks; vectors are
    fetched for the gaps between `short` and `long` only.
    """
    narrow = written(frames.select("camera_id", "captured_at", "path"))  # frames may be the result of joins: they are read for keys once
    keys = narrow.where(F.col("captured_at").isNotNull())
    placed = row_numbers(keys, [F.asc_nulls_first("camera_id"), F.asc("captured_at"), F.asc("path")], "_i")
    before = placed.select((F.col("_i") + 1).alias("_i"), F.col("camera_id").alias("_camera"), F.col("captured_at").alias("_at"), F.col("path").alias("_path"))
    pairs = placed.join(before, "_i", "left").withColumn("_gap", F.when(F.col("_path").isNotNull() & F.col("camera_id").eqNullSafe(F.col("_camera")), gap_seconds(F.col("_at"), F.col("captured_at"))))
    start = F.when(F.col("_gap") <= short, 0)
    if similarity:
        open_ = pairs.where((F.col("_gap") > short) & (F.col("_gap") <= long)).select("path", "_path")
        own, other = frames.select("path", F.col("emb").alias("_a")), frames.select(F.col("path").alias("_path"), F.col("emb").alias("_b"))
        looks = open_.join(own, "path").join(other, "_path").where(cosine(F.col("_a"), F.col("_b")) >= alike).select("path", F.lit(True).alias("_alike"))
        pairs = pairs.join(looks, "path", "left")
        start = start.when(F.col("_alike"), 0)
    starts = pairs.select("path", "_i", start.otherwise(1).cast("long").alias("_start"))
    ids = running(starts, ["_i"], {"burst_id": "_start"}).select("path", (F.col("burst_id") + F.col("_start") - 1).alias("burst_id"), "_start")
    total = ids.agg(F.coalesce(F.sum("_start"), F.lit(0)).alias("_total"))  # one row
    untimed = row_numbers(narrow.where(F.col("captured_at").isNull()).select("path"), ["path"], "burst_id")
    single = untimed.crossJoin(F.broadcast(total)).select("path", (F.col("burst_id") + F.col("_total") - 1).alias("burst_id"))
    return frames.join(ids.select("path", "burst_id").unionByName(single), "path").select(*frames.columns, "burst_id")


def burst_summary(bursts: DataFrame) -> DataFrame:
    sizes = bursts.groupBy("burst_id").count()
    return sizes.agg(F.count(F.lit(1)).alias("n_bursts"), F.count_if(F.col("count") > 1).alias("n_multi"), F.count_if(F.col("count") == 1).alias("n_singleton"))


def burst_columns(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of keys (path, burst_id, score without NaN, _reject): (path, within_burst_rank, is_representative, burst_size, burst_id),
    and (burst_id, score of its representative). Rows are placed by burst in ranges; a burst is only aggregated."""
    placed = row_numbers(keys, [F.asc("burst_id"), F.desc_nulls_last("score"), F.asc("path")], "_at")
    best = F.min(F.struct("_reject", F.col("score").isNull().alias("_last"), (-F.col("score")).alias("_minus"), "path", "score"))
    sizes = written(placed.groupBy("burst_id").agg(F.count(F.lit(1)).alias("burst_size"), F.min("_at").alias("_first"), best.alias("_best")))
    own = sizes.select("burst_id", "burst_size", "_first", F.col("_best.path").alias("_best"))
    rows = placed.join(own, "burst_id").select("path", (F.col("_at") - F.col("_first") + 1).alias("within_burst_rank"), (F.col("path") == F.col("_best")).alias("is_representative"), "burst_size", "burst_id")
    return rows, sizes.select("burst_id", F.col("_best.score").alias("score"))


def rank_keys(frames: DataFrame) -> DataFrame:
    reject = F.coalesce(F.col("tech_hard_reject"), F.lit(False)) if "tech_hard_reject" in frames.columns else F.lit(False)
    return written(frames.select("path", F.when(~F.isnan("score"), F.col("score")).alias("score"), "burst_id", reject.alias("_reject")))


def ranked(frames: DataFrame) -> DataFrame:
    """frames with burst_id and score: rank, score_rank, within_burst_rank, is_representative, burst_size and burst_rank.

    rank is the place by score and path, score_rank that by score alone (ties share the best). The representative of
    a burst is its best frame that is not rejected, and bursts are ranked by the score of theirs, ties sharing the
    best rank. A frame without a score (null or NaN) comes after all others. Keys alone are sorted, in ranges, and a burst is only
    aggregated: neither all frames nor those of one burst meet in a task.
    """
    keys = rank_keys(frames)
    rows, firsts = burst_columns(keys)
    burst_rank = firsts.join(value_ranks(firsts, "score", "burst_rank").withColumnRenamed("score", "_score"), F.col("score").eqNullSafe(F.col("_score"))).select("burst_id", "burst_rank")
    places = row_numbers(keys.select("path", "score"), [F.desc_nulls_last("score"), F.asc("path")], "rank")
    ties = places.groupBy(F.col("score").alias("_score")).agg(F.min("rank").alias("score_rank"))
    places = places.join(ties, F.col("score").eqNullSafe(F.col("_score"))).select("path", "rank", "score_rank")
    out = rows.join(burst_rank, "burst_id").drop("burst_id").join(places, "path")
    return frames.join(out.select("path", "rank", "score_rank", "within_burst_rank", "is_representative", "burst_size", "burst_rank"), "path")
