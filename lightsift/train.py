"""Train a ranker from labelled folders: python -m lightsift.train ROOT --model FILE [--encoder NAME] ..."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsift.operators import learn as L
from lightsift.operators.bursts import burst_ids
from lightsift.session import written
from lightsift.sources import encoders as E
from lightsift.sources.exif import with_capture_data
from lightsift.sources.features import training_source
from lightsift.sources.images import scan_images


def training_frames(spark: SparkSession, root: str, encoder: str = "stub", must_find: tuple[str, ...] = (), analyse: Callable[[DataFrame], DataFrame] | None = None, groups: dict[str, bool] | None = None, bursts: bool = False) -> tuple[DataFrame, dict[str, bool]]:
    """(path, y, must_find, x and, where asked for, burst_id; the groups of features that x is made of).

    x holds the named encoder's vector and what `analyse` says of the files (path, content): any of emb_face, emb_body, va
    and quality by path, as a registered analyser gives them. Groups that nothing gives are off; a frame that lacks a vector of
    a group has zeros there, and defaults for what was not measured. Bursts come from capture data and the vectors.
    """
    by = E.encoder(encoder)
    files = scan_images(spark, root, content=True)
    frames = training_source(spark, root, must_find).join(E.embed(files, by).where("error IS NULL").select("path", F.col("emb").alias("emb_full")), "path")
    given = {"emb_full"}
    if analyse is not None:
        said = analyse(files)
        given |= set(said.columns) & set(L.GROUPS)
        frames = frames.join(said.select("path", *sorted(given - {"emb_full"})), "path", "left")
    used = {g: on and g in given for g, on in (L.GROUPS | (groups or {})).items()}
    frames = written(frames)
    missing = [g for g in used if used[g] and g not in ("emb_full", "quality")]
    sizes = frames.agg(*[F.max(F.size(g)).alias(g) for g in missing]).first() if missing else {}  # one row
    for g in missing:
        frames = frames.withColumn(g, F.coalesce(g, F.array_repeat(F.lit(0.0), max(sizes[g] or 0, 0))))
    if used["quality"]:
        frames = frames.withColumn("quality", F.coalesce("quality", F.create_map().cast("map<string,double>")))
    if bursts:
        shot = frames.select("path", F.col("emb_full").alias("emb")).join(with_capture_data(files), "path")
        frames = frames.join(burst_ids(shot).select("path", "burst_id"), "path")
    kept = ["path", "y", "must_find", L.feature_vector(used).alias("x"), *(["burst_id"] if bursts else [])]
    return frames.select(*kept), used


def trained(spark: SparkSession, root: str, encoder: str = "stub", must_find: tuple[str, ...] = (), analyse: Callable[[DataFrame], DataFrame] | None = None, groups: dict[str, bool] | None = None, within: float = 0.0, **options: object) -> tuple[DataFrame, str]:
    """(AUC by part, model file text): labels by folder, one row per content, folds and final fit on the frames' feature vectors.

    With `within`, that share of the pairs comes from one burst each. The model file says what its features are made of.
    """
    frames, used = training_frames(spark, root, encoder, must_find, analyse, groups, within > 0)
    frames = written(frames)
    parts, layers = L.cross_validate(frames, "y", "x", within=within, **options)
    counts = {r["y"]: r["count"] for r in frames.groupBy("y").count().collect()}  # two rows
    flags = {"context_encoder": E.encoder(encoder).encoder_id, "groups": used, "n_pos": counts.get(1, 0), "n_neg": counts.get(0, 0)}
    return parts, L.model_json(layers, flags)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("root")
    p.add_argument("--model", required=True)
    p.add_argument("--encoder", default="stub")
    p.add_argument("--must-find", nargs="*", default=[])
    p.add_argument("--holdout", type=float, default=0.2)
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--pairs", type=int, default=4096)
    p.add_argument("--epochs", type=int, default=L.EPOCHS)
    p.add_argument("--within", type=float, default=0.0)
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("lightsift-train").getOrCreate()
    parts, model = trained(spark, o.root, o.encoder, tuple(o.must_find), share=o.holdout, folds=o.folds, n_pairs=o.pairs, epochs=o.epochs, within=o.within)
    Path(o.model).write_text(model)
    print(json.dumps({r["part"]: r["auc"] for r in parts.collect()}))


if __name__ == "__main__":
    main()
