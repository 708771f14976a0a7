"""A run that follows its folder: a batch of arrivals and removals touches the cameras and score ranges it falls into only.

A run's tables are cut into pieces, and a generation names for each piece the version that holds it, so what a batch
doesn't touch is neither read nor written again:
  vectors  pieces of cameras, added to but never rewritten: path, camera_id, emb
  frames   pieces of cameras: keys, score, number of the burst within its camera, columns of the burst
  places   pieces of score ranges: path, and rank and score_rank within the range
  cameras  (camera_id, n_bursts) beside frames
Burst ids and ranks of the whole run are these numbers plus the sums over all cameras, or ranges, before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsift.session import written
from lightsift.sources import snapshots

from .bursts import ALIKE, LONG_GAP, SHORT_GAP, burst_columns, burst_ids, rank_keys
from .ordering import row_numbers, running, value_ranks

FRAME = "path, camera_id, captured_at, emb, score"
#: Pieces of cameras, and of scores.
PIECES = 64
TABLES = ("vectors", "frames", "places", "cameras")


def camera_piece(pieces: int) -> Column:
    return F.pmod(F.xxhash64("camera_id"), F.lit(pieces)).cast("int").alias("piece")


def score_piece(bounds: list[float]) -> Column:
    """Number of the score range: 0 for the best; frames without a score are in the last one."""
    score = F.when(~F.isnan("score"), F.col("score"))
    at = sum((F.when(score < b, 1).otherwise(0) for b in bounds), F.lit(0))
    return F.when(score.isNull(), len(bounds) + 1).otherwise(at).cast("int").alias("piece")


def store(df: DataFrame, root: str, name: str, version: int) -> set[int]:
    """Write df's pieces as those of a version; the numbers of the pieces that have rows."""
    at = f"{root}/{name}/v={version}"
    df.hint("rebalance", "piece").write.mode("overwrite").partitionBy("piece").parquet(at)
    fs, path = snapshots._fs(df.sparkSession, at)
    return {int(s.getPath().getName()[6:]) for s in fs.listStatus(path(at)) if s.getPath().getName().startswith("piece=")}


def pieces_of(spark: SparkSession, root: str) -> list[tuple[str, int, int]]:
    """(table, piece, version) of the current generation: at most some pieces a table, and versions of vectors not yet compacted."""
    if not snapshots.current(spark, root):
        return []
    return [tuple(r) for r in snapshots.read(spark, root, "pieces").select("name", "piece", "version").collect()]


def load(spark: SparkSession, root: str, name: str, schema: str, held: list[tuple[str, int, int]], only: set[int] | None = None) -> DataFrame:
    """A table of the generation, or some of its pieces: no other file is listed."""
    paths = [f"{root}/{name}/v={v}/piece={p}" for n, p, v in held if n == name and (only is None or p in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def kinds(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def schemas(frames: DataFrame) -> dict[str, str]:
    keys = kinds(frames, "path", "camera_id")
    return {
        "vectors": f"{keys}, emb array<double>",
        "frames": f"{keys}, captured_at timestamp_ntz, score double, local long, within_burst_rank long, is_representative boolean, burst_size long",
        "places": f"{kinds(frames, 'path')}, score double, rank long, score_rank long",
        "cameras": f"{kinds(frames, 'camera_id')}, n_bursts long",
        "pieces": "name string, piece int, version int",
        "bounds": "i int, bound double",
    }


def cut_cameras(frames: DataFrame, vectors: DataFrame, gaps: tuple[float, float, float]) -> DataFrame:
    """Rows of the frames table for whole cameras; frames without a time have no local number and are bursts of their own."""
    timed = frames.where("captured_at IS NOT NULL")
    cut = written(burst_ids(timed.join(vectors, "path", "left"), *gaps).drop("emb"))
    cols = burst_columns(rank_keys(cut))[0].drop("burst_id")
    first = cut.groupBy("camera_id").agg(F.min("burst_id").alias("_first")).withColumnRenamed("camera_id", "_camera")
    local = cut.join(first, F.col("camera_id").eqNullSafe(F.col("_camera"))).select("path", "camera_id", "captured_at", "score", (F.col("burst_id") - F.col("_first")).alias("local"))
    alone = frames.where("captured_at IS NULL").select("path", "camera_id", "captured_at", "score", F.lit(None).cast("long").alias("local"), F.lit(1).cast("long").alias("within_burst_rank"), F.lit(True).alias("is_representative"), F.lit(1).cast("long").alias("burst_size"))
    return local.join(cols, "path").unionByName(alone)


def placed(rows: DataFrame, bounds: list[float]) -> DataFrame:
    """Rows of the places table for whole ranges: ranks count within each range."""
    keys = rows.select("path", F.when(~F.isnan("score"), F.col("score")).alias("score"), score_piece(bounds))
    order = row_numbers(keys, [F.asc("piece"), F.desc_nulls_last("score"), F.asc("path")], "_at")
    ties = order.groupBy("piece", "score").agg(F.min("_at").alias("_tie")).withColumnsRenamed({"piece": "_p", "score": "_s"})
    first = order.groupBy("piece").agg(F.min("_at").alias("_first"))
    out = order.join(ties, (F.col("piece") == F.col("_p")) & F.col("score").eqNullSafe(F.col("_s"))).join(first, "piece")
    return out.select("path", "score", (F.col("_at") - F.col("_first") + 1).alias("rank"), (F.col("_tie") - F.col("_first") + 1).alias("score_rank"), "piece")


def numbers(df: DataFrame, column: str) -> set[int]:
    return {r[0] for r in df.select(column).distinct().collect()}


def update_run(spark: SparkSession, root: str, added: DataFrame, removed: DataFrame | None = None, gaps: tuple[float, float, float] = (SHORT_GAP, LONG_GAP, ALIKE), pieces: int = PIECES) -> int:
    """Publish the run without the removed paths (path) and with the added frames (path, camera_id, captured_at, emb, score).

    A path that is added again replaces its frame. Cameras that gain or lose a frame are cut anew, with their own vectors only;
    score ranges that do are ranked anew; all else is carried over. Returns the version; a failure leaves the one before.
    """
    kind = schemas(added)
    held, version = pieces_of(spark, root), snapshots.current(spark, root) + 2
    added = written(added.select(*FRAME.split(", ")))
    gone = added.select("path") if removed is None else added.select("path").unionByName(removed.select("path"))
    old = load(spark, root, "frames", kind["frames"], held)
    # the narrow frames that go, to find what they touch
    leaving = written(old.select("path", "camera_id", "score").join(gone.distinct(), "path", "left_semi"))
    if held:
        bounds = [r.bound for r in snapshots.read(spark, root, "bounds").orderBy("i").collect()]
    else:
        cuts = added.where("NOT isnan(score)").agg(F.percentile_approx("score", [i / pieces for i in range(pieces - 1, 0, -1)])).first()[0]
        bounds = sorted(set(cuts or []), reverse=True)
    moved = added.select("path", "camera_id", "score").unionByName(leaving)
    cameras = written(moved.select("camera_id").distinct())
    own = camera_piece(pieces)
    in_cameras, in_scores = numbers(cameras.select(own), "piece"), numbers(moved.select(score_piece(bounds)), "piece")

    touched = load(spark, root, "frames", kind["frames"], held, in_cameras)
    named, same = cameras.withColumnRenamed("camera_id", "_camera"), F.col("camera_id").eqNullSafe(F.col("_camera"))
    stay = touched.join(named, same, "left_anti")
    again = touched.join(named, same, "left_semi").join(gone, "path", "left_anti")
    stored = last_vectors(spark, root, kind["vectors"], held, in_cameras, named)
    mine = stored.join(gone, "path", "left_anti").unionByName(added.select("path", F.col("emb").cast("array<double>").alias("emb")))
    narrow = again.select("path", "camera_id", "captured_at", "score").unionByName(added.select("path", "camera_id", "captured_at", "score"))
    frames = written(cut_cameras(written(narrow), mine, gaps).unionByName(stay))
    new = {"frames": store(frames.withColumn("piece", own), root, "frames", version)}
    new["vectors"] = store(added.select("path", "camera_id", F.col("emb").cast("array<double>").alias("emb"), own), root, "vectors", version)
    counts = frames.groupBy("camera_id").agg((F.max("local") + 1).alias("n_bursts"))
    new["cameras"] = store(counts.withColumn("piece", own), root, "cameras", version)
    ranges = load(spark, root, "places", kind["places"], held, in_scores).join(gone, "path", "left_anti")
    new["places"] = store(placed(ranges.select("path", "score").unionByName(added.select("path", "score")), bounds), root, "places", version)
    redone = {"frames": in_cameras, "cameras": in_cameras, "places": in_scores, "vectors": set()}
    kept = [(n, p, v) for n, p, v in held if p not in redone[n]] + [(n, p, version) for n, ps in new.items() for p in sorted(ps)]
    tables = {"pieces": spark.createDataFrame(kept, kind["pieces"]), "bounds": spark.createDataFrame(list(enumerate(bounds)), kind["bounds"])}
    return snapshots.publish(spark, root, tables)


def read_run(spark: SparkSession, root: str, like: DataFrame) -> DataFrame:
    """The whole run's narrow table: path, camera_id, captured_at, score, burst_id, rank, score_rank, within_burst_rank,
    is_representative, burst_size, burst_rank; `like` has the types of path and camera_id."""
    kind, held = schemas(like), pieces_of(spark, root)
    frames, cameras, places = (load(spark, root, n, kind[n], held) for n in ("frames", "cameras", "places"))
    before = running(cameras.withColumn("n", F.coalesce("n_bursts", F.lit(0))), [F.asc_nulls_first("camera_id")], {"_before": "n"})
    total = before.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_total"))  # one row
    timed = frames.where("local IS NOT NULL").join(before.select(F.col("camera_id").alias("_camera"), "_before"), F.col("camera_id").eqNullSafe(F.col("_camera"))).withColumn("burst_id", F.col("_before") + F.col("local"))
    single = row_numbers(frames.where("local IS NULL").select("path"), ["path"], "_n").crossJoin(F.broadcast(total)).select("path", (F.col("_n") + F.col("_total") - 1).alias("burst_id"))
    cut = timed.drop("_camera", "_before").unionByName(frames.where("local IS NULL").join(single, "path"))
    ranges = written(places.select("path", "score", "rank", "score_rank", score_piece([r.bound for r in snapshots.read(spark, root, "bounds").orderBy("i").collect()])))
    upto = running(ranges.groupBy("piece").agg(F.count(F.lit(1)).alias("n")), ["piece"], {"_upto": "n"}).select("piece", "_upto")  # one row a range
    whole = ranges.join(F.broadcast(upto), "piece").select("path", (F.col("rank") + F.col("_upto")).alias("rank"), (F.col("score_rank") + F.col("_upto")).alias("score_rank"))
    cut = written(cut)
    best = cut.where("is_representative").select("burst_id", F.when(~F.isnan("score"), F.col("score")).alias("_score"))
    burst = best.join(value_ranks(best, "_score", "burst_rank").withColumnRenamed("_score", "_s"), F.col("_score").eqNullSafe(F.col("_s"))).select("burst_id", "burst_rank")
    return cut.drop("local").join(whole, "path").join(burst, "burst_id")


def last_vectors(spark: SparkSession, root: str, schema: str, held: list[tuple[str, int, int]], only: set[int] | None = None, cameras: DataFrame | None = None) -> DataFrame:
    """(path, emb) of some pieces, and of some cameras (_camera) there; of a path that was added again the vector that came last."""
    out = spark.createDataFrame([], schema).select("path", "emb", F.lit(0).alias("_v"))
    for v in sorted({v for n, _, v in held if n == "vectors"}):
        part = load(spark, root, "vectors", schema, [h for h in held if h[2] == v], only)
        part = part if cameras is None else part.join(cameras, F.col("camera_id").eqNullSafe(F.col("_camera")), "left_semi")
        out = out.unionByName(part.select("path", "emb", F.lit(v).alias("_v")))
    return out.groupBy("path").agg(F.max_by("emb", "_v").alias("emb"))


def read_vectors(spark: SparkSession, root: str, like: DataFrame) -> DataFrame:
    """(path, emb) of the run's frames."""
    kind, held = schemas(like), pieces_of(spark, root)
    return last_vectors(spark, root, kind["vectors"], held).join(load(spark, root, "frames", kind["frames"], held).select("path"), "path", "left_semi")


def compact_vectors(spark: SparkSession, root: str, like: DataFrame) -> int:
    """Publish the run with the vectors of all versions as one version a piece, without those of frames that are gone."""
    kind, held, version = schemas(like), pieces_of(spark, root), snapshots.current(spark, root) + 2
    frames = load(spark, root, "frames", kind["frames"], held).select("path", "camera_id")
    whole = frames.join(last_vectors(spark, root, kind["vectors"], held), "path").withColumn("piece", camera_piece(PIECES))
    new = store(whole.select("path", "camera_id", "emb", "piece"), root, "vectors", version)
    kept = [h for h in held if h[0] != "vectors"] + [("vectors", p, version) for p in sorted(new)]
    bounds = snapshots.read(spark, root, "bounds")
    return snapshots.publish(spark, root, {"pieces": spark.createDataFrame(kept, kind["pieces"]), "bounds": bounds})


def clear_versions(spark: SparkSession, root: str) -> int:
    """Delete the pieces that neither the current generation nor the one before names; how many were deleted."""
    named = {(r["name"], r["piece"], r["version"]) for v in snapshots.versions(spark, root) for r in snapshots.read(spark, root, "pieces", v).collect()}
    fs, path = snapshots._fs(spark, root)
    n = 0
    for name in TABLES:
        for v in fs.listStatus(path(f"{root}/{name}")) if fs.exists(path(f"{root}/{name}")) else []:
            for p in fs.listStatus(v.getPath()):
                at = p.getPath().getName()
                if at.startswith("piece=") and (name, int(at[6:]), int(v.getPath().getName()[2:])) not in named:
                    n += bool(fs.delete(p.getPath(), True))
    return n
