"""Ranking model: AUC, folds, pair sampling, a pairwise network and a linear ranker."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lightsift.functions.face import quality_vector
from lightsift.session import written

from .network import EPOCHS, Layers, fit_networks, forward
from .ordering import row_numbers, running


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney AUC with average ranks of ties; NaN if a class is missing. Distinct scores are ordered in ranges."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    ranked = running(by, ["s"], {"below": "n"}).withColumn("r", F.col("below") + (F.col("n") + 1) / 2.0)
    total = ranked.agg(F.sum(F.col("r") * F.col("p")).alias("u"), F.sum("p").alias("P"), F.sum(F.col("n") - F.col("p")).alias("N"))
    return total.select(F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(float("nan"))).otherwise((F.col("u") - F.col("P") * (F.col("P") + 1) / 2.0) / (F.col("P") * F.col("N"))).alias("auc"), F.col("P").alias("n_pos"), F.col("N").alias("n_neg"))


def stratified_folds(rows: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """rows (one per key) with fold 0..k-1: within each class rows are dealt out in the order of a hash of the key."""
    turns = row_numbers(rows.select(key, label, F.md5(F.col(key).cast("string").cast("binary")).alias("_h")), [F.asc_nulls_first(label), F.asc("_h"), F.asc(key)], "_turn")
    first = turns.groupBy(label).agg(F.min("_turn").alias("_first")).select(F.col(label).alias("_class"), "_first")
    dealt = turns.join(F.broadcast(first), F.col(label).eqNullSafe(F.col("_class"))).select(F.col(key).alias("_key"), ((F.col("_turn") - F.col("_first")) % k).alias("fold"))  # a row per class
    return rows.join(dealt, F.col(key).eqNullSafe(F.col("_key"))).select(*rows.columns, "fold")


def mixed_bursts(frames: DataFrame, label: str) -> DataFrame:
    """Bursts that hold both a good and a bad frame."""
    by = frames.groupBy("burst_id").agg(F.count_if(F.col(label) == 1).alias("n_good"), F.count_if(F.col(label) == 0).alias("n_bad"))
    return by.where("n_good > 0 AND n_bad > 0")


def drawn(*parts: F.Column) -> F.Column:
    """A number of 60 bits from the MD5 of the parts as text, joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def within_burst_pairs(frames: DataFrame, label: str, n: int = 4096, seed: int = 42, key: str = "path") -> DataFrame:
    """n seeded (slot, burst_id, good, bad) pairs of frames of one burst (none without mixed bursts): a mixed burst is drawn by
    hash for each slot, then one good and one bad frame of it, so a long burst gives no more pairs than a short one, and never all of its own.
    """
    places = row_numbers(mixed_bursts(frames, label), ["burst_id"], "_i")
    total = places.agg(F.count(F.lit(1)).alias("_n"))  # one row
    slots = frames.sparkSession.range(n).withColumnRenamed("id", "slot").crossJoin(F.broadcast(total)).where("_n > 0")
    turn = lambda tag, among: drawn(F.lit(seed), F.lit(tag), F.col("slot")) % F.col(among) + 1
    want = slots.withColumn("_i", turn("burst", "_n")).join(places, "_i").select("slot", "burst_id", turn("good", "n_good").alias("_g"), turn("bad", "n_bad").alias("_b"))
    members = frames.select("burst_id", key, label).join(want.select("burst_id").distinct(), "burst_id", "left_semi")
    ranked = members.withColumn("_r", F.row_number().over(Window.partitionBy("burst_id", label).orderBy(key)).cast("long"))
    good = ranked.where(F.col(label) == 1).select("burst_id", F.col("_r").alias("_g"), F.col(key).alias("good"))
    bad = ranked.where(F.col(label) == 0).select("burst_id", F.col("_r").alias("_b"), F.col(key).alias("bad"))
    return want.join(good, ["burst_id", "_g"]).join(bad, ["burst_id", "_b"]).select("slot", "burst_id", "good", "bad")


def sampled_pairs(frames: DataFrame, label: str, n: int, seed: int = 42, key: str = "path") -> DataFrame:
    """n seeded random (slot, good, bad) pairs, drawn with repeats over all frames of both classes (none if one is empty)."""
    slots = frames.sparkSession.range(n).withColumnRenamed("id", "slot")
    for name, y in (("good", 1), ("bad", 0)):
        placed = row_numbers(frames.where(F.col(label) == y).select(F.col(key).alias(name)), [name], "_i")
        total = placed.agg(F.count(F.lit(1)).alias("_n"))  # one row
        turn = drawn(F.lit(seed), F.lit(name), F.col("slot")) % F.col("_n") + 1
        slots = slots.crossJoin(F.broadcast(total)).where("_n > 0").withColumn("_i", turn).join(placed, "_i").drop("_i", "_n")
    return slots


def training_pairs(frames: DataFrame, label: str, n: int = 4096, within: float = 0.0, must_find: float = 0.0, seed: int = 42, key: str = "path", epochs: int = 1) -> DataFrame:
    """Seeded (good, bad, kind, epoch, slot) pairs, n new ones for each epoch, slots 0..n-1 in each: a share `must_find` sets
    frames marked must_find against bad ones, and of the others a share `within` comes from bursts that hold both. Shares that
    have no frames to draw from go to the plain kind."""

    def kind(drawn_pairs: DataFrame, name: str, below: int) -> DataFrame:
        return drawn_pairs.select("good", "bad", F.lit(name).alias("kind"), (F.col("slot") % epochs).cast("int").alias("epoch"), (F.floor(F.col("slot") / epochs) + below).alias("slot"))

    n_top = round(n * must_find) if "must_find" in frames.columns else 0
    n_top = 0 if not n_top or frames.where("must_find").isEmpty() else n_top
    n_in = round((n - n_top) * within) if "burst_id" in frames.columns else 0
    n_in = 0 if not n_in or mixed_bursts(frames, label).isEmpty() else n_in
    plain = n - n_top - n_in
    out = kind(sampled_pairs(frames, label, plain * epochs, seed, key), "good_bad", 0)
    if n_in:
        out = out.unionByName(kind(within_burst_pairs(frames, label, n_in * epochs, seed, key), "within_burst", plain))
    if n_top:
        top = frames.where(F.col("must_find") | (F.col(label) == 0)).withColumn(label, F.col("must_find").cast("int"))
        out = out.unionByName(kind(sampled_pairs(top, label, n_top * epochs, seed + 7, key), "must_find", plain + n_in))
    return out


#: Groups of a frame's features in the order they are put together, and which of them are used.
GROUPS = {"emb_full": True, "emb_face": True, "emb_body": False, "va": False, "quality": True}


def feature_vector(groups: dict[str, bool] | None = None) -> F.Column:
    """The used groups of features of a frame back to back, as doubles; quality is a map of measurements."""
    used = [g for g in GROUPS if (GROUPS | (groups or {}))[g]]
    if not used:
        raise ValueError("no group of features is used")
    return F.concat(*[quality_vector(F.col(g)) if g == "quality" else F.col(g).cast("array<double>") for g in used])


def fit_ranker(pairs: DataFrame, dim: int, rounds: int = 30, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of a linear pairwise ranker on difference vectors (column d): full gradients, summed by the cluster.

    Each round sends `dim` weights out and `dim` sums back; pairs stay where they are.
    """
    w = np.zeros(dim)
    pairs = pairs.select("d").persist()
    n = max(1, pairs.count())
    for _ in range(rounds):
        now = w.copy()

        def partial(batches, now=now):
            total = np.zeros(dim)
            for b in batches:
                x = np.stack(b["d"].to_list()) if len(b) else np.zeros((0, dim))
                total += (x * (1 / (1 + np.exp(np.clip(x @ now, -35, 35))))[:, None]).sum(axis=0)
            yield pd.DataFrame({"i": np.arange(dim), "g": total})

        g = pairs.mapInPandas(partial, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()  # dim rows
        step = np.zeros(dim)
        for r in g:
            step[r["i"]] = r["g"]
        w = w * (1 - rate * decay) + rate * step / n
    pairs.unpersist()
    return w


def with_vectors(pairs: DataFrame, frames: DataFrame, features: str, key: str = "path") -> DataFrame:
    good, bad = (frames.select(F.col(key).alias(c), F.col(features).alias(f"{c}_x")) for c in ("good", "bad"))
    return pairs.join(good, "good").join(bad, "bad")


def holdout(rows: DataFrame, key: str, label: str, share: float = 0.2) -> DataFrame:
    """rows with held_out: in each class the first share of a hash order, one at least and never all; share 0 or 1: none."""
    if not 0 < share < 1:
        return rows.withColumn("held_out", F.lit(False))
    turns = row_numbers(rows.select(key, label, F.md5(F.concat(F.lit("holdout"), F.col(key).cast("string")).cast("binary")).alias("_h")), [F.asc_nulls_first(label), F.asc("_h"), F.asc(key)], "_turn")
    sizes = turns.groupBy(label).agg(F.min("_turn").alias("_first"), F.count(F.lit(1)).alias("_n")).select(F.col(label).alias("_class"), "_first", "_n")
    most = F.when(F.col("_n") >= 2, F.least(F.greatest(F.lit(1), F.round(F.col("_n") * share)), F.col("_n") - 1)).otherwise(0)
    dealt = turns.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_class"))).select(F.col(key).alias("_key"), (F.col("_turn") - F.col("_first") < most).alias("held_out"))  # a row per class
    return rows.join(dealt, F.col(key).eqNullSafe(F.col("_key"))).select(*rows.columns, "held_out")


def cross_validate(frames: DataFrame, label: str, features: str, folds: int = 5, share: float = 0.2, n_pairs: int = 4096, within: float = 0.0, must_find: float = 0.0, key: str = "path", epochs: int = EPOCHS, **options) -> tuple[DataFrame, Layers]:
    """(AUC by part, final network): folds inside the training part, a model of that part on the held-out one, and the fit on all rows.

    Parts are 'fold 0', ..., 'cv_mean', 'holdout', 'train' and 'all'. Each model sees n_pairs new pairs an epoch; all are fitted side by side by the
    whole cluster.
    """
    dealt = written(holdout(frames, key, label, share))
    inner = written(stratified_folds(dealt.where("NOT held_out"), key, label, folds))
    classes = inner.groupBy(label).count().collect()  # two rows
    k = min([folds, *[r["count"] for r in classes]]) if len(classes) == 2 and 0 < share < 1 else 0
    if k < folds:
        inner = written(stratified_folds(dealt.where("NOT held_out"), key, label, max(k, 1)))
    sets = {i: inner.where(F.col("fold") != i).drop("fold", "held_out") for i in range(k if k >= 2 else 0)}
    if 0 < share < 1:
        sets[-1] = dealt.where("NOT held_out").drop("held_out")
    sets[-2] = frames
    pairs = None
    for i, rows in sets.items():
        own = with_vectors(training_pairs(rows, label, n_pairs, within, must_find, key=key, epochs=epochs), rows, features, key).withColumn("by", F.lit(i))
        pairs = own if pairs is None else pairs.unionByName(own)
    models = {by: fitted.layers for by, fitted in fit_networks(pairs, epochs, **options).items()}
    tested = [(f"fold {i}", inner.where(F.col("fold") == i), models[i]) for i in sets if i >= 0]
    if -1 in sets:
        tested += [("holdout", dealt.where("held_out"), models[-1]), ("train", dealt.where("NOT held_out"), models[-1])]
    tested.append(("all", frames, models[-2]))
    out = None
    for name, rows, layers in tested:
        own = auc(score_mlp(rows, features, layers, [key, label]), "score", label).select(F.lit(name).alias("part"), "auc")
        out = own if out is None else out.unionByName(own)
    out = written(out)
    mean = out.where("part LIKE 'fold%' AND NOT isnan(auc)").agg(F.avg("auc").alias("auc")).select(F.lit("cv_mean").alias("part"), "auc")
    return out.unionByName(mean), models[-2]


def score_mlp(frames: DataFrame, features: str, layers: Layers, keep: list[str]) -> DataFrame:
    """frames' keep columns with score; the weights (their size is that of the network, whatever the table) travel once per executor."""
    sent = frames.sparkSession.sparkContext.broadcast(layers)

    def run(batches):
        for b in batches:
            out = b[keep].copy()
            out["score"] = forward(np.stack(b[features].to_list()), sent.value) if len(b) else np.zeros(0)
            yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields if f.name in keep)
    return frames.select(*keep, features).mapInPandas(run, kinds + ", score double")


def model_json(layers: Layers, flags: dict) -> str:
    return json.dumps({"flags": flags, "layers": [[w.tolist(), b.tolist()] for w, b in layers]}, sort_keys=True)


def model_from(text: str, flags: dict) -> Layers:
    """Layers of a saved model; other feature flags than it was trained with are an error."""
    got = json.loads(text)
    if got["flags"] != flags:
        raise ValueError(f"the model was trained with {got['flags']}, not {flags}")
    return [(np.array(w), np.array(b)) for w, b in got["layers"]]
