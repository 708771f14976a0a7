"""Bursts of a stream of frames by time and likeness: each camera's last frame and its waiting frames are keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lightsift.operators.bursts import ALIKE, LONG_GAP, SHORT_GAP

OUT = "camera_id string, path string, captured_at timestamp, burst long, closed boolean"


def alike(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Cosine; below any threshold for a missing vector, 0 where a norm vanishes."""
    if a is None or b is None:
        return -2.0
    n = float(np.sqrt(a @ a)), float(np.sqrt(b @ b))
    return 0.0 if min(n) < 1e-12 else float(a @ b) / (n[0] * n[1])


class CameraBursts(StatefulProcessor):
    """One camera. Frames wait until the watermark has passed them, so they are cut in order however they arrive."""

    def __init__(self, short: float, long: float, like: float) -> None:
        self.short, self.long, self.like = short, long, like

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "path string, at long, emb array<double>")
        self.last = handle.getValueState("last", "path string, at long, emb array<double>, burst long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            at = part["captured_at"].to_numpy().astype("datetime64[us]").astype(np.int64)
            new = [(str(p), int(t), None if e is None else [float(v) for v in e]) for p, t, e in zip(part["path"], at, part["emb"])]
            self.waiting.appendList(new)
            # a timer runs once the watermark is past it: for each frame's time, in milliseconds rounded up
            for t in {-(-x[1] // 1000) for x in new}:
                self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Cut the frames that the watermark has passed; close the burst that no later frame can join any more."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [(int(w[1]), str(w[0]), w[2]) for w in self.waiting.get()]
        ready, rest = sorted((w for w in held if w[0] <= now), key=lambda w: w[:2]), [w for w in held if w[0] > now]
        out: list[tuple] = []
        last = self.last.get() if self.last.exists() else None
        before = None if last is None else (str(last[0]), int(last[1]), None if last[2] is None else np.array(last[2]), int(last[3]))
        for at, path, emb in ready:
            own = None if emb is None else np.array(emb, float)
            burst = 0
            if before is not None:
                gap = (at - before[1]) / 1e6
                joins = gap <= self.short or gap <= self.long and alike(before[2], own) >= self.like
                burst = before[3] + (not joins)
                if not joins:
                    out.append((key[0], None, before[1], before[3], True))
            out.append((key[0], path, at, burst, False))
            before = (path, at, own, burst)
        if ready:
            self.last.update((before[0], before[1], None if before[2] is None else before[2].tolist(), before[3]))
            if rest:
                self.waiting.put([(p, t, e) for t, p, e in rest])
            else:
                self.waiting.clear()
        if out:
            camera, path, at, burst, closed = (list(x) for x in zip(*out, strict=True))
            yield pd.DataFrame({"camera_id": pd.Series(camera, dtype=object), "path": pd.Series(path, dtype=object), "captured_at": pd.to_datetime(at, unit="us"), "burst": burst, "closed": closed})


def burst_stream(frames: DataFrame, short: float = SHORT_GAP, long: float = LONG_GAP, like: float = ALIKE, late: str = "1 minute") -> DataFrame:
    """Frames of a stream (path, camera_id, captured_at, emb) with the number of their burst within the camera.

    The rule is that of `burst_ids`: numbers count from 0 in order of time and path, so camera and number name the burst of the whole
    run. A frame comes out once the watermark (`late` behind the newest frame) has passed it; of a frame later than that nothing comes.
    A row without a path says that a burst is closed, with the time of its last frame. Frames without a time are no part of a stream.
    State per camera: the last frame and those that wait. The state store must be RocksDB's.
    """
    timed = frames.where("captured_at IS NOT NULL").selectExpr("CAST(camera_id AS STRING) AS camera_id", "CAST(path AS STRING) AS path", "CAST(captured_at AS TIMESTAMP) AS captured_at", "CAST(emb AS ARRAY<DOUBLE>) AS emb")
    return timed.withWatermark("captured_at", late).groupBy("camera_id").transformWithStateInPandas(CameraBursts(short, long, like), OUT, "Append", "EventTime")


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

