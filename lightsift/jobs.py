"""Work that can be stopped inside of a running stage, and how far its stages are."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")
GROUP = ("spark.jobGroup.id", "spark.job.description")


class Cancelled(Exception):
    """The work was stopped on request; what it had not published by then isn't."""


def stage_progress(spark: SparkSession, group: str) -> tuple[int, int]:
    """(tasks done, tasks) of all stages that the jobs of a group have had so far; read from the driver's tracker, no job."""
    tracker, done, tasks = spark.sparkContext.statusTracker(), 0, 0
    stages = {s for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds}
    for info in filter(None, map(tracker.getStageInfo, stages)):
        done, tasks = done + info.numCompletedTasks, tasks + info.numTasks
    return done, tasks


def cancellable(spark: SparkSession, work: Callable[[], T], cancelled: Callable[[], bool], stages: Callable[[int, int], None] | None = None, every: float = 0.25) -> T:
    """work()'s result. Its jobs carry a tag; as soon as cancelled() is true the running ones are interrupted, and so is each that
    work starts afterwards, until it gives up; then Cancelled is raised.

    stages(done, tasks) is called now and then from another thread. Work that ends before an interruption reaches it has its result
    returned; an error of its own is raised as it is, as is one of cancelled() or stages() once work has ended.
    """
    sc, name, over, asked = spark.sparkContext, f"lightsift-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    faults: list[Exception] = []

    def watch() -> None:
        while not over.wait(every):
            try:
                if asked.is_set() or cancelled():
                    asked.set()
                    sc.cancelJobsWithTag(name)
                elif stages is not None:
                    stages(*stage_progress(spark, name))
            except Exception as e:  # noqa: BLE001  told to the caller below
                faults.append(e)
                return

    if cancelled():
        raise Cancelled(name)
    before = [sc.getLocalProperty(k) for k in GROUP]
    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(name)
    sc.setLocalProperty(GROUP[0], name)
    watcher.start()
    try:
        result = work()
    except Exception as e:
        if asked.is_set():
            raise Cancelled(name) from e
        raise
    finally:
        over.set()
        watcher.join()
        sc.removeJobTag(name)
        for k, v in zip(GROUP, before, strict=True):
            sc.setLocalProperty(k, v)
    if faults:
        raise faults[0]
    return result
