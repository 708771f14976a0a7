"""From a folder of images to a published run in one call; what is stored of a content is never computed again."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsift.session import written
from lightsift.sources import encoders as E
from lightsift.sources import exif as X
from lightsift.sources import features as FE
from lightsift.sources import snapshots
from lightsift.sources.images import scan_images
from lightsift.sources.manifest import changed, reused

from . import learn as L
from .ingest import ingest

#: What an analyser says of an image: face vector, expression, face numbers, person boxes and background.
ANALYSIS = "emb_face array<double>, emb_body array<double>, va array<double>, quality map<string,double>, face_detected boolean, face_frac double, ear double, sharpness double, clipped double, centeredness double, areas array<double>, bg_bright double"
#: Up to so many files are opened by name; for more the folder is read and joined.
NAMED = 10_000


@dataclass(frozen=True)
class Models:
    """What looks at the images: an encoder, an analyser (its key says which settings made the numbers), and a saved ranker."""

    encoder: E.Encoder
    analyser: str
    make_analyser: Callable[[], Callable[[bytes], dict]]
    ranker: str
    groups: dict[str, bool] | None = None

    def layers(self) -> L.Layers:
        """The ranker's network; one that was trained with another encoder, or with other groups of features, is an error."""
        flags = json.loads(self.ranker)["flags"]
        own = {"context_encoder": self.encoder.encoder_id} | ({"groups": L.GROUPS | self.groups} if self.groups is not None else {})
        if wrong := {k: flags.get(k) for k, v in own.items() if flags.get(k) != v}:
            raise ValueError(f"the model was trained with {wrong}, not {own}")
        return L.model_from(self.ranker, flags)


def contents(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(path, name, content) of the wanted paths; other files are not opened unless very many are wanted."""
    paths = [r["path"] for r in wanted.select("path").limit(NAMED + 1).collect()]
    if not paths:
        return spark.createDataFrame([], "path string, name string, content binary")
    if len(paths) <= NAMED:
        found = spark.read.format("binaryFile").load(paths)
        return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return scan_images(spark, folder, content=True, paired=True).join(wanted.select("path"), "path", "left_semi").select("path", "name", "content")


def digests(spark: SparkSession, store: str, folder: str, files: DataFrame) -> DataFrame:
    """(path, size, mtime, sha1) of files; only those whose size or time is not the stored one are read. The result is stored."""
    known = snapshots.read(spark, store, "digests") if snapshots.current(spark, store) else spark.createDataFrame([], "path string, size long, mtime long, sha1 string")
    new = changed(files, known)
    fresh = contents(spark, folder, new).select("path", F.sha1("content").alias("sha1")).join(new, "path").select("path", "size", "mtime", "sha1")
    now = written(reused(files, known).select("path", "size", "mtime", "sha1").unionByName(fresh))
    if not new.isEmpty() or now.count() != known.count():
        snapshots.publish(spark, store, {"digests": now})
    return now


def stored(spark: SparkSession, store: str, folder: str, files: DataFrame, kind: str, by: str, look: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """files (path, sha1) with what `look` says of their contents under kind and by; contents not stored yet are looked at once.

    look gets (path, name, content) and returns path, error and its columns; a failure is stored too, as nulls with the error.
    """
    features, wanted = FE.Store(spark, f"{store}/{kind}", kind, by), files.groupBy("sha1").agg(F.min("path").alias("path"))
    before = features.entry()
    todo = written(wanted.join(features.missing(wanted, before), "sha1", "left_semi"))
    if before is None or not todo.isEmpty():
        seen = look(contents(spark, folder, todo))
        features.put(seen.join(todo, "path").drop("path"), before)
    return files.join(features.rows(), "sha1")


def folder_frames(spark: SparkSession, store: str, folder: str, models: Models, progress: Callable[[int, str], None] = lambda percent, message: None) -> DataFrame:
    """The frames of a folder as `ingest` takes them, with the ranker's score. Files that can't be decoded are left out."""
    layers = models.layers()  # before anything is looked at
    listed = scan_images(spark, folder).select("path", "name", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"), F.col("modificationTime").alias("modified_at"))
    files = written(listed)
    if files.isEmpty():
        raise ValueError(f"no images in {folder}")
    progress(10, "Reading files")
    known = digests(spark, f"{store}/files", folder, files.select("path", "size", "mtime")).select("path", "sha1")
    progress(30, "Looking at images")
    good = stored(spark, store, folder, known, "context", models.encoder.encoder_id, lambda c: E.embed(c, models.encoder)).where("error IS NULL").withColumnRenamed("emb", "emb_full").drop("error")
    good = stored(spark, store, folder, good, "analysis", models.analyser, lambda c: E.analysed(c, models.make_analyser, ANALYSIS, models.analyser)).where("error IS NULL").drop("error")
    told = stored(spark, store, folder, known, "capture", "exif", lambda c: X.with_capture_data(c).drop("name").withColumn("error", F.lit(None).cast("string"))).select("path", "camera_id", "captured_at")
    # a camera that the file doesn't name goes by the file's own name
    camera = F.when(F.col("camera_id").startswith("unknown:"), F.concat(F.lit("unknown:"), "name")).otherwise(F.col("camera_id"))
    whole = written(good.join(told, "path").join(files.select("path", "name", "modified_at"), "path").withColumn("camera_id", camera))
    progress(60, "Scoring")
    vector = whole.withColumn("x", L.feature_vector(models.groups))
    scores = L.score_mlp(vector, "x", layers, ["path"]).withColumnRenamed("score", "score_s1")
    return written(whole.join(scores, "path").withColumnRenamed("emb_full", "emb"))


def ingest_folder(spark: SparkSession, store: str, run: str, folder: str, models: Models, progress: Callable[[int, str], None] = lambda percent, message: None, **options: object) -> int:
    """Publish the run of a folder: scan, digests, stored features of new contents, scores, dedup, bursts and ranks. Returns the version.

    store holds digests and features of any number of folders, run the run's generations. An unchanged folder opens no file and
    looks at none. An error anywhere leaves the run as it is; what was looked at stays stored.
    """
    frames = folder_frames(spark, store, folder, models, progress)
    return ingest(spark, run, frames, progress=lambda n, m: progress(60 + 4 * n // 10, m), encoder=models.encoder.encoder_id, text_tower=models.encoder.text is not None, **options)
