"""A run from decoded frames: dedup, scores, tags, times, bursts, ranks and one published generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsift.functions import scalars as S
from lightsift.session import written
from lightsift.sources import snapshots

from . import bursts as BU
from . import dedup as D
from . import quality as Q
from .browse import thresholds

#: What a frame needs: its file, content, vector, ranker's score, face numbers, person boxes and capture data.
FRAME = "path, sha1, emb, score_s1, face_detected, face_frac, ear, sharpness, clipped, centeredness, areas, bg_bright, camera_id, captured_at, modified_at"


def times(frames: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """frames with captured_at from the run before (path, sha1, captured_at) where the content is the same, else as read,
    else the file's own time."""
    known = frames.withColumn("_was", F.lit(None).cast("timestamp_ntz")) if prior is None else frames.join(prior.select("path", "sha1", F.col("captured_at").alias("_was")), ["path", "sha1"], "left")
    return known.withColumn("captured_at", F.coalesce("_was", "captured_at", F.col("modified_at").cast("timestamp_ntz"))).drop("_was")


def derived(frames: DataFrame, prototypes: tuple[DataFrame, DataFrame] | None = None, prior: DataFrame | None = None, alike: float = D.ALIKE, alpha: float = 0.0, reject: bool = False, gaps: tuple[float, float, float] = (BU.SHORT_GAP, BU.LONG_GAP, BU.ALIKE)) -> DataFrame:
    """The run's table: one frame per content and look, with scores, tags, burst and rank columns."""
    once = D.first_of_content(frames, "sha1", [F.asc("path")])
    once = written(once.join(D.greedy(once, "path", written(D.alike_edges(once, "path", "emb", alike))), "path"))
    scored = Q.stage_combine(Q.hard_rejects(Q.tech_scores(once), enabled=reject), alpha)
    scored = scored.withColumn("score", F.col("score_s3_final"))
    tagged = Q.shot_tags(scored, *prototypes) if prototypes else scored.withColumns({"shot_closeness": F.lit(0.0), "shot_type": F.lit("")})
    boxed = Q.box_summary(tagged)
    boxed = boxed.withColumn("subject_class", S.subject_of(F.col("area"))).withColumn("is_hero", S.hero_of(F.col("area"), F.col("n_prominent"), F.col("second"), F.col("bg_bright")))
    return BU.ranked(written(BU.burst_ids(written(times(boxed, prior)), *gaps)))


def bursts_table(run: DataFrame) -> DataFrame:
    """One row per burst, by rank: its representative and size."""
    cols = [c for c in ("burst_rank", "burst_id", "burst_size", "path", "shot_type", "subject_class", "is_hero", "score_s1", "score_s12_after_hard", "score_s3_final") if c in run.columns]
    return run.where("is_representative").select(*cols).orderBy("burst_rank", "path")


def ingest(spark: SparkSession, root: str, frames: DataFrame, progress: Callable[[int, str], None] = lambda percent, message: None, encoder: str | None = None, text_tower: bool = True, **options: object) -> int:
    """Derive the run anew from all its frames and publish it as the next generation, whose number is returned.

    No frame, or a failure anywhere, leaves the generation before as it is. Times already known are taken from there. With an
    encoder's id the search index has it beside itself, and there is none without a text tower or where a frame lacks its vector.
    """
    if frames.isEmpty():
        raise ValueError("no frames to ingest")
    prior = snapshots.read(spark, root, "frames") if snapshots.current(spark, root) else None
    progress(5, "Deriving the run")
    run = written(derived(frames, prior=prior, **options))
    progress(90, "Writing outputs")
    counts = run.agg(F.count(F.lit(1)).alias("n_frames"), F.count_distinct("burst_id").alias("n_bursts"), F.count_if(F.col("emb").isNull()).alias("n_missing"), F.coalesce(F.max(F.size("emb")), F.lit(0)).alias("dim")).first()
    tables = {"frames": run, "bursts": bursts_table(run), "thresholds": thresholds(run)}
    if encoder is None:
        tables["index"] = run.select("path", "emb")
    elif text_tower and not counts["n_missing"]:
        tables["index"] = run.select("path", "emb")
        tables["meta"] = spark.createDataFrame([(encoder, "emb_full", counts["dim"], counts["n_frames"])], "context_encoder string, kind string, dim int, n long")
    version = snapshots.publish(spark, root, tables, {k: counts[k] for k in ("n_frames", "n_bursts")})
    progress(100, f"Done: version {version}")
    return version
