"""Work that is stopped inside of a stage leaves what was published before."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from lightsift import jobs
from lightsift.sources import snapshots
from lightsift.streaming import watch as W


def endless(spark):
    """A stage that would run for hours."""
    return spark.range(0, 10**13, 1, 4).select(F.max(F.xxhash64("id")).alias("m"))


def test_stopped_within_a_stage(spark):
    began = time.time()
    seen = []
    with pytest.raises(jobs.Cancelled):
        jobs.cancellable(spark, lambda: endless(spark).collect(), lambda: time.time() - began > 20 or any(n for _, n in seen), lambda d, n: seen.append((d, n)))
    assert time.time() - began < 30 and max(n for _, n in seen) >= 4
    assert not spark.sparkContext.getJobTags() and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert spark.range(5).count() == 5  # later work is not touched


def test_later_jobs_of_stopped_work_are_stopped_too(spark):
    stop, tries = [], []

    def stubborn():
        while len(tries) < 3:
            try:
                stop.append(1)
                endless(spark).collect()
            except Exception as e:  # noqa: BLE001
                tries.append(e)
        raise tries[-1]

    with pytest.raises(jobs.Cancelled):
        jobs.cancellable(spark, stubborn, lambda: bool(stop))
    assert len(tries) == 3


def test_errors_and_results_pass(spark):
    assert jobs.cancellable(spark, lambda: spark.range(7).count(), lambda: False) == 7
    with pytest.raises(ZeroDivisionError):
        jobs.cancellable(spark, lambda: 1 // 0, lambda: False)
    with pytest.raises(jobs.Cancelled):
        jobs.cancellable(spark, lambda: pytest.fail("started"), lambda: True)


def test_a_cancelled_batch_leaves_the_run(spark, tmp_path):
    run, began, slow = "file://" + str(tmp_path / "run"), [], [False]

    def ingest(files):
        out = files.select("path").crossJoin(endless(spark)) if slow[0] else files.select("path")
        began.append(time.time())
        snapshots.publish(spark, run, {"frames": out})
        return True

    w = W.Watcher(spark, "file://" + str(tmp_path / "state"), ingest, stable_ticks=0, cooldown=0.0, cancelled=lambda: slow[0] and len(began) > 1 and time.time() - began[-1] > 1.5)
    listed = lambda tick, *paths: spark.createDataFrame([(tick, p, 1, 1) for p in paths], "tick long, path string, size long, mtime long")
    w.tick(listed(0, "a"))
    assert snapshots.current(spark, run) == 2 and w.status()["n_known"] == 1
    slow[0] = True
    w.tick(listed(1, "a", "b"))
    assert snapshots.current(spark, run) == 2 and snapshots.read(spark, run, "frames").count() == 1
    assert w.status()["n_ready"] == 1 and w.last_error == ""
    slow[0] = False
    assert w.maybe_ingest() and snapshots.read(spark, run, "frames").count() == 2 and w.status()["n_known"] == 2
