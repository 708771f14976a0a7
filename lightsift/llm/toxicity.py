"""Toxicity by logistic regression with FTRL-proximal updates over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import ids_of, long_array, rows_where, slices, text_buffer, text_rows

#: Hashed feature space: 2**BITS coordinates, and one more for the bias.
BITS = 20
BIAS = 1 << BITS
#: Per-coordinate learning rate ALPHA / (BETA + sqrt(sum of squared gradients)); L1 makes weights exactly zero.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 4.0, 0.1, 6
#: Weight of a toxic row in an update: they are few.
TOXIC_WEIGHT = 2.0
#: Bound of the training sample: labelled rows with the smallest hashes of their id.
SAMPLE_ROWS = 16_000
#: Bound of a training row: of a text with more distinct features those with the smallest hashes, from all of the text, are learnt from.
ROW_FEATURES = 8192


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, text) of every word, word pair and pair with one word between; A-Z lower-cased, repeats included."""
    buf = H.LOWER[buf]
    starts, ends, first = H.word_spans(buf, off, H.ALNUM)
    w = H.word_hashes(buf, starts, ends)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out, of = [w], [text]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        at, doc = H.inside(first, gap + 1)
        out.append(H.mix(w[at] * np.uint64(salt) + w[at + gap]))
        of.append(doc)
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(of)


def distinct(coord: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each coordinate once per text, by text."""
    both = np.unique(text << BITS | coord)
    return both & (BIAS - 1), both >> BITS


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that FTRL-proximal leaves other than zero, the bias included."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(z: np.ndarray, n: np.ndarray, l1: float | np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, y in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w = weights(zi, ni, np.where(at == BIAS, 0.0, L1))
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - y) * (TOXIC_WEIGHT if y else 1.0)
            n_new = ni + g * g
            z[at] = zi + g - (np.sqrt(n_new) - np.sqrt(ni)) / ALPHA * w
            n[at] = n_new
    l1 = np.full(BIAS + 1, L1)
    l1[BIAS] = 0
    w = weights(z, n, l1)
    used = np.flatnonzero(w)
    return used, w[used]


def bounded(coord: np.ndarray, text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """At most limit of the distinct coordinates of each text, by a hash of the coordinate; still by text and coordinate."""
    order = np.lexsort((H.mix(coord.astype(np.uint64)), text))
    text_sorted = text[order]
    turn = np.arange(len(order)) - np.searchsorted(text_sorted, text_sorted, "left")
    keep = np.sort(order[turn < limit])
    return coord[keep], text[keep]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, fold: int = 5, row_features: int = ROW_FEATURES) -> DataFrame:
    """(coordinate, weight): the non-zero weights, learnt from at most sample_rows labelled rows whose crc32(id) mod fold is not 0.

    Rows without a label or id teach nothing; of repeated labels of an id the largest counts, of repeated rows of an id the one
    with the least key (a hash of id and text). The sample is chosen by a hash of the id, so it is the same at every run; its ids
    are sent to the scan of the documents, features are made there, at most row_features a row, and one task runs the
    updates over them in that order: sample_rows times row_features numbers at most.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna().where(~held_out(F.col("id"), fold))
    sample = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("turn", F.xxhash64(F.col("id"), F.lit(1))).orderBy("turn", "id").limit(sample_rows)
    chosen = text_rows(docs, id_col, text_col).join(F.broadcast(sample), "id").select("key", "text", "turn", "y")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            coord, text = bounded(*distinct(*features(*text_buffer(b.column(1)))), row_features)
            edges = np.searchsorted(text, np.arange(b.num_rows + 1))
            rows = pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), pa.array(coord, pa.int32())).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), rows], names=["key", "turn", "y", "coords"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for b in batches:
            y.append(b.column(1).to_numpy().astype(float))
            rows += [np.append(np.asarray(c.values.to_numpy(), np.int32), np.int32(BIAS)) for c in b.column(2)]
        at, w = fit(rows, np.concatenate(y)) if rows else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["coord", "weight"])

    # a turn belongs to one id; its rows meet in a partial minimum before anything is gathered
    rows = chosen.mapInArrow(made, "key long, turn long, y int, coords array<int>").groupBy("turn", "y").agg(F.min_by("coords", "key").alias("coords"))
    return rows.repartition(1).sortWithinPartitions("turn").mapInArrow(learn, "coord long, weight double")


def learnt(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[int, float]]:
    """The weights on the driver: a few thousand by L1, at most 2**BITS + 1."""
    return [(r["coord"], r["weight"]) for r in train(docs, labels, id_col, text_col, label_col).collect()]


def held_out(id_: F.Column, fold: int = 5) -> F.Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % fold == 0, F.lit(False))


def sent(spark: SparkSession, weights: list[tuple[int, float]]) -> Broadcast:
    """The non-zero weights (at most 2**BITS + 1) on their way to the executors."""
    at = np.array([c for c, _ in weights], np.int64)
    return spark.sparkContext.broadcast((at, np.array([w for _, w in weights], float)))


class Model:
    """Dense weights in a worker."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray]) -> None:
        self.w = np.zeros(BIAS + 1)
        self.w[model[0]] = model[1]

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        coord, text = features(buf, off)
        hit = self.w[coord] != 0
        coord, text = distinct(coord[hit], text[hit])
        return 1 / (1 + np.exp(-np.clip(self.w[BIAS] + np.bincount(text, self.w[coord], len(off) - 1), -35, 35)))


def score(docs: DataFrame, weights: list[tuple[int, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher is likelier toxic) of each whole text; null counts as empty, a feature counts once."""
    model = sent(docs.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([long_array(ids_of(b.column(0))), pa.array(own.scores(*text_buffer(b.column(1))))], names=["id", "score"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "id long, score double")


def accepted(docs: DataFrame, weights: list[tuple[int, float]], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold; all of them where nothing was learnt (no weights)."""
    if not weights:
        return docs
    model = sent(docs.sparkSession, weights)

    def rule() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        own = Model(model.value)
        return lambda buf, off: own.scores(buf, off) < threshold

    return rows_where(docs, text_col, rule)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score and predicted of every row, repeated rows and null ids (never held out) included.

    Null and empty texts have the bias alone as their score. Without any labelled row every score is 0.5 and predicted is 1.
    """
    out = score(docs, learnt(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return out.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
