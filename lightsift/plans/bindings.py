"""The engine's relations over the given tables, with thresholds that select something there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsift.operators.browse import thresholds
from lightsift.operators.bursts import burst_ids, ranked
from lightsift.operators.quality import prototype, shot_tags
from lightsift.functions import scalars as S
from lightsift.session import scratch, written
from lightsift.sources import snapshots

SHORT, LONG, ALIKE, NEAR = 1800.0, 14400.0, 0.15, 0.35
HERO_BACKGROUND = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames, each with the embedding of the same number modulo the number of embeddings."""
    v = table(spark, sf_dir, "embeddings")
    n = v.agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))
    pick = e.select(F.col("event_id").alias("path"), F.col("user_id").alias("camera_id"), F.col("ts").alias("captured_at"), F.col("value").alias("score"), (F.col("event_id") % F.col("n")).alias("vec_id"))
    out = pick.join(v.select("vec_id", F.col("embedding").alias("emb")), "vec_id").drop("vec_id")
    area, most, second, back = (F.col("path") % 13) / 100.0, F.col("path") % 3, (F.col("path") % 5) / 100.0, (F.col("path") % 7) / 100.0
    return out.withColumn("subject_class", S.subject_of(area)).withColumn("is_hero", S.hero_of(area, most, second, back))


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_ids(frames(spark, sf_dir), SHORT, LONG, ALIKE)


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their bursts, from the published run."""
    return run(spark, sf_dir).select("path", "camera_id", "captured_at", "score", "emb", "subject_class", "is_hero", "burst_id")


def prototypes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "emb")
    return prototype(v.where("label = 0")), prototype(v.where("label = 1"))


#: Root of the published run of each application and state of the tables it comes from.
_published: dict[tuple[str, str, str], str] = {}


def published(spark: SparkSession, sf_dir: str) -> str:
    key = spark.sparkContext.applicationId, sf_dir, ",".join(snapshots.signature(spark, f"{sf_dir}/{t}.parquet") for t in ("events", "embeddings"))
    if key not in _published or not snapshots.exists(spark, _published[key]):
        wide, close = prototypes(spark, sf_dir)
        root = scratch("run", spark)
        frames = written(shot_tags(ranked(cut(spark, sf_dir)), wide, close))
        snapshots.publish(spark, root, {"frames": frames, "thresholds": thresholds(frames)})
        _published[key] = root
    return _published[key]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's main table: ranked frames with bursts and tags, published once and read by every page and search."""
    return snapshots.read(spark, published(spark, sf_dir), "frames")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's quality thresholds by percentage."""
    return snapshots.read(spark, published(spark, sf_dir), "thresholds")


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders").crossJoin(F.broadcast(n))  # one row
    return o.select((F.col("o_orderkey") % F.col("n")).alias("path"), (F.col("o_custkey") % 5).cast("string").alias("viewer")).distinct()


def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as decoded frames."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (c("l_extendedprice") / 5000).alias("sharpness"), c("l_discount").alias("face_frac"), (c("l_tax") * 3).alias("ear"), (c("l_quantity") / 100).alias("clipped"), (c("l_discount") * 10).alias("centeredness"), (c("l_returnflag") == "R").alias("face_detected"), (c("l_extendedprice") / c("l_quantity")).alias("score_s1"), c("l_discount").alias("area"), c("l_linenumber").alias("n_prominent"), c("l_tax").alias("second"), (c("l_quantity") / 50).alias("background"))
