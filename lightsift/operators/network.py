"""A pairwise network fitted by the whole cluster: every epoch sees new pairs, tasks sum gradients, the driver takes the step."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightsift.session import scratch

Layers = list[tuple[np.ndarray, np.ndarray]]
#: Hidden widths, epochs, AdamW's rate and weight decay, and the share of hidden units that a pair leaves out in training.
HIDDEN, EPOCHS, RATE, DECAY, DROPOUT = (256, 256), 60, 1e-3, 1e-4, 0.2
#: Numbers of a model in one row of gradients, and tasks that an epoch's pairs are dealt to.
CHUNK, SLICES = 1 << 16, 8

#: The error function at multiples of 1/512; between them four terms of its Taylor series are exact to rounding.
STEP, FAR = 1 / 512, 6.0
KNOTS = np.arange(round(2 * FAR / STEP) + 1) * STEP - FAR
AT_KNOTS = np.array([math.erf(k) for k in KNOTS])


def erf(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -FAR, FAR)
    near = np.rint((x + FAR) / STEP).astype(np.int64)
    k = KNOTS[near]
    d = x - k
    slope = 2 / math.sqrt(math.pi) * np.exp(-k * k)
    return AT_KNOTS[near] + slope * d * (1 + d * (-k + d * ((2 * k * k - 1) / 3 + d * (3 - 2 * k * k) * k / 6)))


def forward(x: np.ndarray, layers: Layers) -> np.ndarray:
    """Scores of a multi-layer perceptron with exact GELU between layers."""
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i + 1 < len(layers):
            x = 0.5 * x * (1 + erf(x / math.sqrt(2)))
    return x[:, 0]


def traced(x: np.ndarray, layers: Layers, masks: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Scores, and of each layer its input and the slope of what follows it; masks scale the units of the hidden layers."""
    trace = []
    for i, (w, b) in enumerate(layers):
        z = x @ w + b
        if i + 1 == len(layers):
            trace.append((x, np.ones_like(z)))
            return z[:, 0], trace
        below = 0.5 * (1 + erf(z / math.sqrt(2)))
        scale = 1.0 if masks is None else masks[i]
        trace.append((x, (below + z * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)) * scale))
        x = z * below * scale
    raise ValueError("a network has at least one layer")


def gradients(trace: list[tuple[np.ndarray, np.ndarray]], layers: Layers, by_score: np.ndarray) -> np.ndarray:
    """Gradients of all weights and biases, back to back, from a trace and the loss's derivative by each row's score."""
    back, out = by_score[:, None], []
    for (x, slope), (w, _) in zip(reversed(trace), reversed(layers), strict=True):
        back = back * slope
        out += [back.sum(axis=0), x.T @ back]
        back = back @ w.T
    return np.concatenate([g.ravel() for g in out[::-1]])


def mask(seed: int, epoch: int, side: int, layer: int, slots: np.ndarray, width: int, dropout: float) -> np.ndarray:
    """Factors of a layer's units for each pair: 0, or 1 / (1 - dropout). They follow from the arguments alone (a 64-bit
    mixing function), so they don't depend on how pairs are dealt to tasks."""
    with np.errstate(over="ignore"):
        lane = np.uint64(((seed * 1_000_003 + epoch) * 2 + side) * 64 + layer)
        x = slots.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + lane * np.uint64(0xA0761D6478BD642F)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11) >= dropout * 2.0**53) / (1 - dropout)


def pair_gradients(good: np.ndarray, bad: np.ndarray, slots: np.ndarray, layers: Layers, epoch: int, margin: float, dropout: float, seed: int) -> tuple[np.ndarray, float]:
    """Sums over pairs of the gradients of softplus(bad - good), or of a hinge with a margin, and of the loss itself."""

    def half(x: np.ndarray, side: int) -> tuple[np.ndarray, list]:
        masks = [mask(seed, epoch, side, i, slots, w.shape[1], dropout) for i, (w, _) in enumerate(layers[:-1])] if dropout else None
        return traced(x, layers, masks)

    (up, trace_up), (down, trace_down) = half(good, 0), half(bad, 1)
    d = up - down
    slope = -(d < margin).astype(float) if margin > 0 else -1 / (1 + np.exp(np.clip(d, -700, 700)))
    loss = np.maximum(margin - d, 0) if margin > 0 else np.logaddexp(0, -d)
    return gradients(trace_up, layers, slope) + gradients(trace_down, layers, -slope), float(loss.sum())


def unflattened(flat: np.ndarray, widths: list[int]) -> Layers:
    out, at = [], 0
    for a, b in zip(widths, widths[1:], strict=False):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def start(widths: list[int], seed: int) -> np.ndarray:
    """Weights even between +-1 / sqrt(inputs), biases 0, back to back."""
    rng = np.random.default_rng(seed)
    return np.concatenate([p for a, b in zip(widths, widths[1:], strict=False) for p in (rng.uniform(-1, 1, a * b) / math.sqrt(a), np.zeros(b))])


class AdamW:
    """The state of one model's steps."""

    def __init__(self, flat: np.ndarray, rate: float = RATE, decay: float = DECAY) -> None:
        self.flat, self.rate, self.decay, self.t = flat, rate, decay, 0
        self.first, self.second = np.zeros_like(flat), np.zeros_like(flat)

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.first, self.second = 0.9 * self.first + 0.1 * g, 0.999 * self.second + 0.001 * g * g
        towards = (self.first / (1 - 0.9**self.t)) / (np.sqrt(self.second / (1 - 0.999**self.t)) + 1e-8)
        self.flat = self.flat * (1 - self.rate * self.decay) - self.rate * towards


class Fit(NamedTuple):
    """A fitted network and the mean loss of each epoch's pairs before its step."""

    layers: Layers
    losses: list[float]


def fit_networks(pairs: DataFrame, epochs: int = EPOCHS, hidden: tuple[int, ...] = HIDDEN, rate: float = RATE, decay: float = DECAY, margin: float = 0.0, dropout: float = DROPOUT, seed: int = 42, slices: int = SLICES) -> dict[int, Fit]:
    """One network per value of `by` from pairs (by, epoch from 0, slot, good_x, bad_x); all models take each epoch's step together.

    Pairs are written once by epoch (vectors as 32-bit floats), dealt to `slices` tasks by their slot. An epoch sends the
    models out, and tasks send sums of gradients in pieces of 65,536 numbers; those are added per piece, in order of the tasks'
    first slots (reruns agree), and only the sum reaches the driver: its size is that of the models, whatever the pairs. A model
    without a pair in an epoch takes no step there; without any it is not in the result.
    """
    spark = pairs.sparkSession
    x = lambda name: F.col(name).cast("array<float>").alias(name)
    path = scratch("pairs", spark)
    rows = pairs.select(F.col("by").cast("long"), F.col("epoch").cast("int"), F.col("slot").cast("long"), x("good_x"), x("bad_x"))
    rows.repartition(slices, "slot").sortWithinPartitions("epoch", "by", "slot").write.partitionBy("epoch").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    sizes = stored.groupBy("by", "epoch").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("good_x")).alias("dim")).collect()  # models times epochs
    counts = {(r["by"], r["epoch"]): r["n"] for r in sizes}
    widths = {r["by"]: [r["dim"], *hidden, 1] for r in sizes}
    models = {by: AdamW(start(w, seed), rate, decay) for by, w in sorted(widths.items())}
    losses: dict[int, list[float]] = {by: [] for by in models}
    for epoch in range(epochs):
        if not any(e == epoch for _, e in counts):
            continue
        sent = spark.sparkContext.broadcast({by: m.flat for by, m in models.items()})

        def partial(batches: Iterator[pd.DataFrame], epoch: int = epoch, sent=sent) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            first: dict[int, int] = {}
            for b in batches:
                for by, own in b.groupby("by", sort=True):
                    slots = own["slot"].to_numpy()
                    good, bad = (np.stack(own[c].to_list()).astype(float) for c in ("good_x", "bad_x"))
                    g, loss = pair_gradients(good, bad, slots, unflattened(sent.value[by], widths[by]), epoch, margin, dropout, seed)
                    total[by] = total.get(by, 0) + np.append(g, loss)
                    first.setdefault(by, int(slots[0]))
            for by, g in total.items():
                parts = [g[at : at + CHUNK].tobytes() for at in range(0, len(g), CHUNK)]
                yield pd.DataFrame({"by": by, "piece": range(len(parts)), "first": first[by], "g": parts})

        def added(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
            g = np.sum([np.frombuffer(p) for p in pieces.sort_values("first")["g"]], axis=0)
            return pd.DataFrame({"by": [key[0]], "piece": [key[1]], "g": [g.tobytes()]})

        of = spark.read.schema(rows.drop("epoch").schema).parquet(f"{path}/epoch={epoch}")
        sums = of.mapInPandas(partial, "by long, piece int, first long, g binary").groupBy("by", "piece").applyInPandas(added, "by long, piece int, g binary")
        found: dict[int, list[bytes]] = {}
        for r in sorted(sums.collect(), key=lambda r: (r["by"], r["piece"])):  # the size of the models
            found.setdefault(r["by"], []).append(bytes(r["g"]))
        for by, parts in found.items():
            g = np.frombuffer(b"".join(parts)) / counts[by, epoch]
            models[by].step(g[:-1])
            losses[by].append(float(g[-1]))
        sent.destroy()
    return {by: Fit(unflattened(m.flat, widths[by]), losses[by]) for by, m in models.items()}
