"""The memo of digests, validated files, the search index and labelled folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsift.operators.dedup import training_rows

from . import snapshots
from .feature_store import Store, get_features, put_features, with_features  # noqa: F401
from .images import scan_images
from .manifest import changed, reused


def memoized(files: DataFrame, memo: DataFrame) -> DataFrame:
    """The next memo (path, size, mtime, sha1) of files (path, size, mtime, content): digests of files whose size and time
    are unchanged come from the memo; only the others' contents are read and hashed."""
    known = reused(files.select("path", "size", "mtime"), memo).select("path", "size", "mtime", "sha1")
    fresh = changed(files, memo).select("path", "size", "mtime", F.sha1("content").alias("sha1"))
    return known.unionByName(fresh)


def upserted(memo: DataFrame, now: DataFrame) -> DataFrame:
    """memo with the rows of now in place of its own for the same paths."""
    return memo.join(now.select("path"), "path", "left_anti").unionByName(now.select(*memo.columns))


def validated(files: DataFrame, signatures: DataFrame, decodable: Callable[[DataFrame], DataFrame], restat: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The usable ones of files (path, size, mtime): unchanged since they were found usable, or decodable now.

    decodable gets the other files and returns the paths that open; restat lists files anew after that, and one
    that changed meanwhile is left out. The result is also the table of signatures for the next time.
    """
    same = files.select("path", "size", "mtime").join(signatures.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_semi")
    rest = changed(files.select("path", "size", "mtime"), signatures)
    out = same.unionByName(rest.join(decodable(rest).select("path"), "path", "left_semi"))
    return out if restat is None else out.join(restat(out).select("path", "size", "mtime"), ["path", "size", "mtime"], "left_semi")


def write_search_index(spark: SparkSession, root: str, frames: DataFrame, embeddings: DataFrame, encoder: str, has_text_tower: bool = True) -> bool:
    """Publish the vectors (path, emb) of all frames as the run's index, with its encoder and size beside it.

    Nothing is written without a text tower, or where a frame lacks its vector.
    """
    if not has_text_tower or not frames.join(embeddings.where("emb IS NOT NULL"), "path", "left_anti").isEmpty():
        return False
    index = frames.select("path").join(embeddings.select("path", "emb"), "path")
    meta = index.agg(F.lit(encoder).alias("context_encoder"), F.lit("emb_full").alias("kind"), F.coalesce(F.max(F.size("emb")), F.lit(0)).alias("dim"), F.count(F.lit(1)).alias("n"))
    snapshots.publish(spark, root, {"index": index, "meta": meta})
    return True


def read_search_index(spark: SparkSession, root: str, encoder: str) -> DataFrame:
    """path, emb of the current index; one made by another encoder is an error."""
    got = snapshots.read(spark, root, "meta").first()
    if got["context_encoder"] != encoder:
        raise ValueError(f"the index was made by {got['context_encoder']}, not {encoder}")
    return snapshots.read(spark, root, "index")


#: Folders of a training root and their labels: whatever is in one of the must-find folders is good as well.
LABELS = {"Good": 1, "Bad": 0}


def labelled_files(files: DataFrame, must_find: tuple[str, ...] = ()) -> DataFrame:
    """files (path, folder, sha1) of labelled folders with y and must_find, one row per content: any good copy makes it good."""
    label = F.coalesce(*[F.when(F.col("folder") == k, v) for k, v in LABELS.items()], F.when(F.col("folder").isin(*must_find), 1) if must_find else F.lit(None).cast("int"))
    rows = files.withColumn("y", label).where("y IS NOT NULL")
    top = rows.groupBy("sha1").agg(F.max(F.col("folder").isin(*must_find) if must_find else F.lit(False)).alias("must_find"))
    return training_rows(rows, "sha1", "path", "y").join(top, "sha1")


def training_source(spark: SparkSession, root: str, must_find: tuple[str, ...] = ()) -> DataFrame:
    """path, y, must_find and sha1 of the images under root/Good, root/Bad and the must-find folders."""
    files = scan_images(spark, root, content=True)
    folder = F.element_at(F.split("dir", "/"), -1)
    return labelled_files(files.select("path", folder.alias("folder"), F.sha1("content").alias("sha1")), must_find)


def picks_from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """(path, viewer) of stored pick maps {"version": 2, "stars": {path: [viewer]}}; older lists {"starred": [path]} are 'legacy'."""
    got = rows.select(F.from_json(column, "stars map<string,array<string>>, starred array<string>").alias("j"))
    new = got.select(F.explode("j.stars").alias("path", "viewers")).select("path", F.explode("viewers").alias("viewer"))
    old = got.where("j.stars IS NULL").select(F.explode("j.starred").alias("path"), F.lit("legacy").alias("viewer"))
    return new.unionByName(old).distinct()


def picks_to_json(picks: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """One stored pick map, `json`, per group (of a run): paths and viewers sorted."""
    keys = groups or []
    owners = picks.groupBy(*keys, "path").agg(F.array_sort(F.collect_set(F.col("viewer").cast("string"))).alias("v"))
    by = owners.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("path").cast("string").alias("path"), "v"))).alias("e"))
    return by.select(*keys, F.to_json(F.struct(F.lit(2).alias("version"), F.map_from_entries("e").alias("stars"))).alias("json"))
