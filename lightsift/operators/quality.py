"""Tags and technical quality over decoded image numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightsift.functions import scalars as S
from lightsift.functions.vectors import dot, minus

from .ordering import quantiles


def prototype(vectors: DataFrame, emb: str = "emb") -> DataFrame:
    """One row, v: the normalised mean of all vectors."""
    mean = vectors.select(F.posexplode(F.col(emb).cast("array<double>")).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    listed = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("m"))  # one value per dimension
    length = F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x)
    return listed.select(F.transform("m", lambda x: x / F.greatest(F.sqrt(length), F.lit(1e-12))).alias("v"))


def shot_tags(frames: DataFrame, wide: DataFrame, close: DataFrame) -> DataFrame:
    """frames with shot_closeness and shot_type from the wide and close prototypes (one row each)."""
    axis = wide.select(F.col("v").alias("w")).crossJoin(close.select(F.col("v").alias("c"))).select(minus(F.col("c"), F.col("w")).alias("axis"))
    out = frames.crossJoin(F.broadcast(axis)).withColumn("shot_closeness", dot(F.col("emb"), F.col("axis"))).drop("axis")
    return out.withColumn("shot_type", S.shot_of(F.col("shot_closeness")))


def box_summary(images: DataFrame, boxes: str = "areas", floor: float = 0.02) -> DataFrame:
    """Largest and second box area and the number of prominent boxes of each image."""
    down = F.sort_array(F.col(boxes), asc=False)
    return images.withColumns({"area": F.coalesce(F.get(down, 0), F.lit(0.0)), "second": F.coalesce(F.get(down, 1), F.lit(0.0)), "n_prominent": F.size(F.filter(F.col(boxes), lambda x: x >= floor)).cast("long")})


def tech_scores(frames: DataFrame) -> DataFrame:
    """Component scores and the technical score; the sharpness range is the run's 5 to 95 percent quantiles."""
    log_sharp = F.log1p(F.greatest(F.col("sharpness"), F.lit(0.0)))
    q = quantiles(frames, log_sharp, S.SHARP_SHARES).select(F.coalesce(F.get("q", 0), F.lit(0.0)).alias("lo"), F.coalesce(F.get("q", 1), F.lit(1.0)).alias("hi"))
    ff = F.col("face_frac")
    out = frames.crossJoin(F.broadcast(q)).withColumns({
        "tech_sharpness_norm": S.unit(log_sharp, F.col("lo"), F.col("hi")),
        "tech_exposure_penalty": S.unit(F.col("clipped"), *S.EXPOSURE_RANGE),
        "tech_eye_open_penalty": (1 - S.unit(F.col("ear"), *S.EAR_RANGE)) * S.unit(ff, *S.EYE_FACE_RANGE),
        "tech_composition_bonus": 0.5 * S.unit(ff, *S.FACE_RANGE) + 0.5 * F.col("centeredness"),
    })
    score = S.W_SHARP * F.col("tech_sharpness_norm") - S.W_EXPOSURE * F.col("tech_exposure_penalty") - S.W_EYES * F.col("tech_eye_open_penalty") + S.W_COMPOSITION * F.col("tech_composition_bonus")
    return out.withColumn("tech_score", score).drop("lo", "hi")


def hard_rejects(frames: DataFrame, enabled: bool = False) -> DataFrame:
    reason = S.reject_reason(F.col("face_frac"), F.col("ear"), F.col("face_detected"), F.col("sharpness"), F.col("clipped")) if enabled else F.lit("")
    return frames.withColumn("tech_hard_reject_reason", reason).withColumn("tech_hard_reject", F.col("tech_hard_reject_reason") != "")


def stage_combine(frames: DataFrame, alpha: float = 0.0) -> DataFrame:
    """z(score_s1) + alpha * z(tech_score); rejected frames get -1e9; no spread means z = 0."""
    stats = frames.agg(*[f(c).alias(f"_{n}{i}") for i, c in enumerate(("score_s1", "tech_score")) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c, i: F.when(F.col(f"_s{i}") < 1e-8, 0.0).otherwise((F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}"))
    out = frames.crossJoin(F.broadcast(stats)).withColumn("score_s12", z("score_s1", 0) + alpha * z("tech_score", 1)).drop("_m0", "_s0", "_m1", "_s1")
    return out.withColumn("score_s12_after_hard", F.when(F.col("tech_hard_reject"), S.REJECTED_SCORE).otherwise(F.col("score_s12"))).withColumn("score_s3_final", F.col("score_s12_after_hard"))
