"""The network against a plain loop over the same draws, and the vector index against brute force."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightsift.operators import learn as L
from lightsift.operators import network as N
from lightsift.operators import vector_index as V


def test_error_function():
    x = np.linspace(-9, 9, 20_011)
    assert np.abs(N.erf(x) - [math.erf(v) for v in x]).max() < 1e-15


@pytest.mark.parametrize(("margin", "dropout"), [(0.0, 0.0), (0.0, 0.3), (1.0, 0.3)])
def test_gradients_are_the_slopes(margin, dropout):
    rng, widths = np.random.default_rng(3), [3, 5, 4, 1]
    flat, good, bad = N.start(widths, 1), rng.normal(size=(6, 3)), rng.normal(size=(6, 3))
    at = lambda f: N.pair_gradients(good, bad, np.arange(6), N.unflattened(f, widths), 2, margin, dropout, 42)
    g, _ = at(flat)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert abs((at(flat + step)[1] - at(flat - step)[1]) / 2e-6 - g[i]) < 1e-5


def test_masks_leave_out_their_share():
    m = N.mask(42, 3, 0, 1, np.arange(2000), 64, 0.2)
    assert abs((m == 0).mean() - 0.2) < 0.01 and set(np.unique(m)) == {0, 1.25}
    others = [N.mask(42, 3, 1, 1, np.arange(2000), 64, 0.2), N.mask(42, 4, 0, 1, np.arange(2000), 64, 0.2), N.mask(42, 3, 0, 0, np.arange(2000), 64, 0.2)]
    assert all(abs(((m == 0) & (o == 0)).mean() - 0.04) < 0.01 for o in others)


@pytest.mark.parametrize("slices", [1, 5])
def test_cluster_fit_is_the_plain_loop(spark, slices):
    rng, epochs = np.random.default_rng(0), 4
    x = rng.normal(size=(90, 3)).astype(np.float32).astype(float)
    frames = spark.createDataFrame([(i, [float(v) for v in r], i % 3 // 2, i % 15 == 2, i // 9) for i, r in enumerate(x)], "path long, x array<double>, y int, must_find boolean, burst_id long")
    drawn = L.training_pairs(frames, "y", 50, within=0.3, must_find=0.2, epochs=epochs)
    rows = drawn.collect()
    assert all(sorted(r.slot for r in rows if r.epoch == e) == list(range(50)) for e in range(epochs))
    assert len({frozenset((r.good, r.bad) for r in rows if r.epoch == e) for e in range(epochs)}) == epochs  # new ones each time
    assert {(r.kind, sum(q.kind == r.kind and q.epoch == 1 for q in rows)) for r in rows} == {("must_find", 10), ("within_burst", 12), ("good_bad", 28)}
    pairs = L.with_vectors(drawn, frames, "x")
    both = pairs.withColumn("by", F.lit(0)).unionByName(pairs.where("epoch < 2").withColumn("by", F.lit(7)))
    fits = N.fit_networks(both, epochs, hidden=(6, 5), rate=1e-2, slices=slices)
    for by, until in ((0, epochs), (7, 2)):
        widths, losses = [3, 6, 5, 1], []
        model = N.AdamW(N.start(widths, 42), 1e-2)
        for e in range(until):
            own = sorted((r for r in rows if r.epoch == e), key=lambda r: r.slot)
            g, loss = N.pair_gradients(x[[r.good for r in own]], x[[r.bad for r in own]], np.array([r.slot for r in own]), N.unflattened(model.flat, widths), e, 0.0, N.DROPOUT, 42)
            model.step(g / 50)
            losses.append(loss / 50)
        for (w, b), (v, c) in zip(fits[by].layers, N.unflattened(model.flat, widths), strict=True):
            assert np.allclose(w, v, atol=1e-9) and np.allclose(b, c, atol=1e-9)
        assert np.allclose(fits[by].losses, losses)
    assert N.fit_networks(both.where("false"), epochs) == {}


def brute(x, keys, q, k):
    sims = V.units(x) @ V.units(q[None])[0]
    return [(keys[i], round(float(sims[i]), 6)) for i in np.lexsort((keys, -sims))[:k]]


def test_index_finds_what_brute_force_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 30)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 32))
    x = np.concatenate([rng.normal(size=(1200, 32)), centers[rng.integers(0, 40, 1200)] + 0.6 * rng.normal(size=(1200, 32)), centers[:1] + 0.01 * rng.normal(size=(1200, 32))])  # a third in one place
    keys = np.arange(len(x))
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(9_999, None)], "key long, emb array<double>")
    root = "file://" + str(tmp_path / "i")
    assert V.build(spark, root, df, "e", lists=48, sample=1500) == 3600
    asked = df.where("key % 100 = 0").select(F.col("key").alias("query"), F.col("emb").alias("q"))
    got, near = ({}, {})
    for out, recall in ((got, None), (near, V.RECALL)):
        for r in V.nearest(spark, root, asked, 10, recall, "e").orderBy("query", "rank").collect():
            out.setdefault(r["query"], []).append((r["key"], round(r["similarity"], 6)))
    want = {q: brute(x, keys, x[q], 10) for q in range(0, 3600, 100)}
    assert {q: [s for _, s in v] for q, v in got.items()} == {q: [s for _, s in v] for q, v in want.items()}
    share = np.mean([len({k for k, _ in near[q]} & {k for k, _ in want[q]}) / 10 for q in want])
    assert share >= 0.9
    one = asked.where("query = 100")
    read = V.nearest(spark, root, one, 3, encoder="e", probes=2)
    filters = [line.split("PartitionFilters: [")[1].split("]")[0] for line in read._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters: [list" in line]
    assert filters and all(1 <= len(set(re.findall(r"\d+", f.split("IN (")[-1].split("= ")[-1]))) <= 2 for f in filters)  # of 48 lists the two asked for
    with pytest.raises(ValueError):
        V.nearest(spark, root, one, 3, encoder="other")


def test_index_of_odd_rows(spark, tmp_path):
    root = "file://" + str(tmp_path / "i")
    kind = "key string, emb array<double>, query string"
    assert V.build(spark, root, spark.createDataFrame([("a", None, "q")], kind)) == 0
    ask = spark.createDataFrame([("p", [1.0, 0.0]), ("z", None), ("o", [0.0, 0.0])], "query string, q array<double>")
    assert V.nearest(spark, root, ask).collect() == []
    rows = [("a", [2.0, 0.0], "x"), ("a", [3.0, 0.0], "x"), (None, [0.0, 1.0], "x"), ("0", [0.0, 0.0], "x"), ("n", None, "x")]
    assert V.build(spark, root, spark.createDataFrame(rows, kind), lists=2) == 4
    got = [(r["query"], r["key"], round(r["similarity"], 6)) for r in V.nearest(spark, root, ask, 3, None).orderBy("query", "rank").collect()]
    assert [g for g in got if g[0] == "p"][:2] == [("p", "a", 1.0)] * 2 and {g[0] for g in got} == {"p", "o"} and len(got) == 6
    with pytest.raises(Exception, match="numbers"):
        V.nearest(spark, root, spark.createDataFrame([("p", [1.0])], "query string, q array<double>"), 3).collect()
