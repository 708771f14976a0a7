"""A partitioned vector index: rows filed under their nearest centroid; a search reads each query's nearest lists, or all."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lightsift.functions.vectors import normalized
from lightsift.session import written
from lightsift.sources import snapshots

#: Bound of the sample that centroids are fitted on (rows with the least hashes of their key), of the number of lists, and
#: k-means rounds.
SAMPLE, MOST_LISTS, ROUNDS = 16_384, 1_024, 10
#: Rows of a list, and queries, that meet in a task at a time: longer lists are split, queries of a popular list are dealt out.
BLOCK = 8_192
#: Rows whose exact neighbours tell how many lists a recall takes, how many neighbours of each, and the recall asked for by default.
PROBED_ROWS, PROBED_NEIGHBOURS, RECALL = 128, 10, 0.98


def units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_means(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows: begins with the first rows; a centroid without rows stays where it is."""
    c = x[:lists].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        held = np.linalg.norm(sums, axis=1) > 1e-12
        c[held] = units(sums[held])
    return c


def fit_centroids(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of at most `sample` rows of (key, emb), chosen by a hash of the key and clustered in one task; by default the
    square root of the number of rows, at most 1,024. They reach the driver: lists times dimension."""
    if lists is None:
        lists = min(MOST_LISTS, max(1, math.isqrt(vectors.count())))
    chosen = vectors.select(F.xxhash64("key").alias("h"), F.col("emb").cast("array<float>").alias("emb"), "key").orderBy("h", "key").limit(sample)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            rows = pd.concat(parts).sort_values(["h", "key"])
            yield pd.DataFrame({"c": list(spherical_means(units(np.stack(rows["emb"].to_list()).astype(float)), min(lists, len(rows))))})

    got = chosen.coalesce(1).mapInPandas(fit, "c array<double>").collect()  # one row per list
    return np.array([r["c"] for r in got])


def build(spark: SparkSession, root: str, vectors: DataFrame, encoder: str = "", lists: int | None = None, sample: int = SAMPLE) -> int:
    """Publish all rows of vectors (key, emb) that have a vector as an index: tables `centroids` and `meta`, and `lists`
    with one folder per list. The number of rows filed is returned. Repeated keys are rows of their own; vectors are compared
    by cosine, so they are stored as unit vectors, and a zero vector has similarity 0 with all. For 128 rows (the least
    by another hash of their key) the ten nearest others are found exactly, and the places of these neighbours' lists in the row's
    order of lists are kept: they say how many lists to read for a recall.
    """
    rows = vectors.where(F.col("emb").isNotNull()).select("key", "emb")
    kind = rows.schema["key"].dataType.simpleString()
    centers = fit_centroids(rows, lists, sample)
    sent = spark.sparkContext.broadcast(centers)  # at most MOST_LISTS rows unless the caller asks for more

    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = units(np.stack(b["emb"].to_list()).astype(float))
                yield pd.DataFrame({"list": np.argmax(x @ sent.value.T, axis=1), "key": b["key"], "emb": list(x)})

    counts = {}

    def tables(home: str) -> None:
        spread = rows.mapInPandas(filed, f"list int, key {kind}, emb array<double>").withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(16)))
        spread.repartition("list", "_part").drop("_part").write.partitionBy("list").parquet(f"{home}/lists")
        if len(centers):
            sizes = spark.read.parquet(f"{home}/lists").groupBy("list").agg(F.count(F.lit(1)).alias("n"))
            counts["n"] = sum(r["n"] for r in sizes.collect())  # one row per list
            spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "list int, c array<double>").join(sizes, "list", "left").fillna(0, ["n"]).coalesce(1).write.parquet(f"{home}/centroids")
        else:
            spark.createDataFrame([], "list int, c array<double>, n long").write.parquet(f"{home}/centroids")
        places: list[int] = []
        if counts.get("n"):
            tried = rows.select(F.xxhash64("key", F.lit(7)).alias("h"), "key", "emb").where(F.col("key").isNotNull()).orderBy("h", "key").limit(PROBED_ROWS)
            asked = tried.select(F.col("key").alias("query"), F.col("emb").alias("q"))
            found = searched(spark, home, asked.dropDuplicates(["query"]), PROBED_NEIGHBOURS + 1, None, counts["n"])
            places = sorted(r["place"] for r in found.where("NOT key <=> query").select("place").collect())  # at most 1,408
        spark.createDataFrame([(encoder, int(centers.shape[1]) if len(centers) else 0, counts.get("n", 0), places)], "encoder string, dim int, n long, places array<int>").write.parquet(f"{home}/meta")

    snapshots.publish(spark, root, tables)
    return counts.get("n", 0)


def nearest(spark: SparkSession, root: str, queries: DataFrame, k: int = 10, recall: float | None = RECALL, encoder: str = "", probes: int | None = None) -> DataFrame:
    """query, key, similarity and rank of the k best rows for each of queries (query: distinct ids, q: vectors), ties by key.

    Only lists whose centroids are nearest to a query are read for it: `probes` of them, or as many as held that share of
    the ten nearest neighbours when the index was built (queries unlike the indexed rows may get less). With neither all
    are read: then the answer is exact. A list of over 8,192 rows is compared in blocks, with the best k of each kept before
    they meet, and the queries of a list are dealt out by 8,192, so neither a long list nor a popular one is one task's work
    (rows that repeat a key stay together). A null query vector finds nothing; an index of
    another encoder or size is an error.
    """
    version = snapshots.current(spark, root)
    meta = snapshots.read(spark, root, "meta", version).first()
    if meta["encoder"] != encoder:
        raise ValueError(f"the index was made by {meta['encoder']}, not {encoder}")
    if probes is None and recall is not None and meta["places"]:
        probes = meta["places"][max(0, math.ceil(recall * len(meta["places"])) - 1)] + 1
    return searched(spark, f"{root}/gen={version}", queries, k, probes, meta["n"]).drop("place")


def searched(spark: SparkSession, home: str, queries: DataFrame, k: int, probes: int | None, n: int) -> DataFrame:
    """As `nearest`, from the tables of one generation with n rows; place: that of a hit's list in the query's order of lists."""
    asked = queries.where(F.col("q").isNotNull()).select("query", normalized(F.col("q")).alias("q"))
    kinds = asked.schema["query"].dataType.simpleString()
    if not n:
        return asked.select("query", F.lit(None).cast("string").alias("key"), F.lit(0.0).alias("similarity"), F.lit(0).alias("place"), F.lit(1).alias("rank")).where("false")
    lists = spark.read.parquet(f"{home}/lists")
    centers = spark.read.parquet(f"{home}/centroids").orderBy("list").collect()  # bounded when built
    key = lists.schema["key"].dataType.simpleString()
    c, blocks = np.array([r["c"] for r in centers]), np.array([max(1, -(-r["n"] // BLOCK)) for r in centers])
    sent = spark.sparkContext.broadcast((c, blocks))
    exact = probes is None or probes >= len(c)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers, blocks = sent.value
        for b in batches:
            if not len(b):
                continue
            q = np.stack(b["q"].to_list()).astype(float)
            if q.shape[1] != centers.shape[1]:
                raise ValueError(f"queries have {q.shape[1]} numbers, the index {centers.shape[1]}")
            near = np.argsort(-(q @ centers.T), axis=1, kind="stable")[:, : None if exact else probes]
            of, to, place = np.repeat(np.arange(len(q)), near.shape[1]), near.ravel(), np.tile(np.arange(near.shape[1]), len(q))
            times = blocks[to]
            of, to, place = np.repeat(of, times), np.repeat(to, times), np.repeat(place, times)
            block = np.arange(len(to)) - np.repeat(np.cumsum(times) - times, times)
            for lo in range(0, len(of), 4_096):  # one vector per row: small pieces
                s = slice(lo, lo + 4_096)
                yield pd.DataFrame({"list": to[s], "block": block[s], "place": place[s], "query": b["query"].to_numpy()[of[s]], "q": list(q[of[s]])})

    routes = asked.mapInPandas(routed, f"list int, block long, place int, query {kinds}, q array<double>")
    if exact:
        turns = [max(1, -(-asked.count() // BLOCK))] * len(c)
    else:  # lists that nobody asks for are not read
        routes = written(routes)
        asks = {r["list"]: r["count"] for r in routes.where("block = 0").groupBy("list").count().collect()}  # one row per list
        lists = lists.where(F.col("list").isin(list(asks)))
        turns = [max(1, -(-asks.get(i, 0) // BLOCK)) for i in range(len(c))]
    of_list = lambda numbers: F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), F.col("list").cast("int") + 1)
    held = lists.select(F.col("list").cast("int").alias("list"), F.pmod(F.xxhash64("key"), of_list(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), of_list(turns) - 1)).alias("turn"), "key", "emb")
    routes = routes.withColumn("turn", F.pmod(F.xxhash64("query"), of_list(turns)).cast("int"))

    def best(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            rows = rows.sort_values("key")
            x, names = np.stack(rows["emb"].to_list()), rows["key"].to_numpy()
            for lo in range(0, len(asks), 512):
                some = asks.iloc[lo : lo + 512]
                sims = np.stack(some["q"].to_list()) @ x.T
                for query, place, s in zip(some["query"], some["place"], sims, strict=True):
                    least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                    at = np.flatnonzero(s >= least)
                    at = at[np.lexsort((at, -s[at]))[:k]]
                    out.append(pd.DataFrame({"query": query, "key": names[at], "similarity": s[at], "place": place}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "key": [], "similarity": [], "place": []})

    found = held.groupBy("list", "block", "turn").cogroup(routes.groupBy("list", "block", "turn")).applyInPandas(best, f"query {kinds}, key {key}, similarity double, place int")
    place = Window.partitionBy("query").orderBy(F.desc("similarity"), F.asc("key"))  # at most k rows per block asked
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
