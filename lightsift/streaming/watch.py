"""Watched folder: files count once they stay unchanged for some listings; each batch derives the run anew.

What is known of each path is a base table and the changes since, one small table per step, so what a step writes follows
what changed and not what is known. A log entry names the tables, the last listing and the counts by status; the rule holds
across micro-batches, restarts and repeated batches, and reporting starts no job.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lightsift.jobs import Cancelled, cancellable
from lightsift.sources import commits
from lightsift.sources.images import scan_images
from lightsift.sources.snapshots import _fs

STABLE_TICKS = 2
#: path, its last signature, the listing since which that holds, the last listing with it, and
#: pending (still arriving), ready (waits for the next batch), known (part of the run) or unusable (can't be decoded).
STATE = "path string, size long, mtime long, since long, tick long, status string"
STATUS = ("pending", "ready", "known", "unusable")
#: A stored change: the state of a path after a step, status null if it is gone. All paths of a state have the last listing's tick.
CHANGE = "path string, size long, mtime long, since long, status string, step long"


def listing(spark: SparkSession, root: str, tick: int) -> DataFrame:
    """tick, path, size and mtime (microseconds) of the image files under root now."""
    files = scan_images(spark, root, paired=True)
    return files.select(F.lit(tick).cast("long").alias("tick"), "path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))


def step(state: DataFrame, listings: DataFrame, usable: Callable[[DataFrame], DataFrame] | None = None, stable_ticks: int = STABLE_TICKS) -> DataFrame:
    """The state after some more listings (tick, path, size, mtime; ticks count on by one and none is empty).

    A new signature starts the count anew, also for known, ready and unusable files (a plain file stream would
    miss those); a path that the last listing lacks is forgotten. A pending file unchanged for stable_ticks
    listings is ready, or unusable if `usable`, which gets those files and returns the decodable paths, leaves it out.
    """
    kept = state.select("path", "size", "mtime", "tick", F.col("since").alias("_since"), "status")
    seen = listings.select(F.col("path").cast(state.schema["path"].dataType), "size", "mtime", "tick", F.lit(None).cast("long").alias("_since"), F.lit(None).cast("string").alias("status"))
    by = Window.partitionBy("path").orderBy("tick")
    same = (F.lag("size").over(by) == F.col("size")) & (F.lag("mtime").over(by) == F.col("mtime")) & (F.lag("tick").over(by) == F.col("tick") - 1)
    rows = kept.unionByName(seen).withColumn("_fresh", F.when(F.col("status").isNull() & ~F.coalesce(same, F.lit(False)), F.col("tick")).otherwise(F.col("_since")))
    rows = rows.withColumn("since", F.last("_fresh", ignorenulls=True).over(by))
    last = rows.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "since", "tick"), "tick").alias("s"), F.max(F.when(F.col("status").isNotNull(), F.struct("status", F.col("_since").alias("was_since")))).alias("was")).select("path", "s.*", "was.*")
    end = listings.agg(F.max("tick").alias("_end"))  # one row
    now = last.crossJoin(F.broadcast(end)).where(F.col("tick") == F.col("_end"))
    status = F.when(F.col("since") == F.col("was_since"), F.col("status")).otherwise("pending")
    now = now.select("path", "size", "mtime", "since", "tick", F.coalesce(status, F.lit("pending")).alias("status"))
    settled = (F.col("status") == "pending") & (F.col("tick") - F.col("since") >= stable_ticks)
    if usable is None:
        return now.withColumn("status", F.when(settled, "ready").otherwise(F.col("status")))
    good = usable(now.where(settled)).select("path", F.lit(True).alias("_good"))
    return now.join(good, "path", "left").withColumn("status", F.when(settled, F.when(F.col("_good"), "ready").otherwise("unusable")).otherwise(F.col("status"))).drop("_good")


def manifest(listings: DataFrame, stable_ticks: int = STABLE_TICKS) -> DataFrame:
    """State of every path after all listings (tick, path, size, mtime): its signature, unchanged listings, ready, gone."""
    by = Window.partitionBy("path").orderBy("tick")
    new = F.coalesce((F.lag("size").over(by) != F.col("size")) | (F.lag("mtime").over(by) != F.col("mtime")) | (F.lag("tick").over(by) != F.col("tick") - 1), F.lit(True))
    since = listings.withColumn("_since", F.max(F.when(new, F.col("tick"))).over(by))
    last = since.groupBy("path").agg(F.max_by(F.struct("tick", "size", "mtime", "_since"), "tick").alias("s")).select("path", "s.*")
    end = listings.agg(F.max("tick").alias("_end"))
    out = last.crossJoin(F.broadcast(end))  # one row
    return out.select("path", "size", "mtime", (F.col("tick") - F.col("_since")).cast("long").alias("unchanged"), ((F.col("tick") - F.col("_since") >= stable_ticks) & (F.col("tick") == F.col("_end"))).alias("ready"), (F.col("tick") < F.col("_end")).alias("gone"))


@dataclass
class Watcher:
    """Decides when and what to ingest; `ingest(files)` gets known and ready files and returns False to decline.

    root holds the state: its log, base and changes. ingest must replace the run's outputs as a whole (see
    snapshots.publish): a batch that failed or was declined stays ready, and is given again with later arrivals.
    After compact_every changes the state is written as a new base. cancelled is asked during a batch too: its jobs are interrupted, and
    its files stay ready. stages gets the tasks done and known of the batch that runs.
    """

    spark: SparkSession
    root: str
    ingest: Callable[[DataFrame], bool]
    usable: Callable[[DataFrame], DataFrame] | None = None
    stable_ticks: int = STABLE_TICKS
    cooldown: float = 20.0
    scan_every: float = 5.0
    scan_idle: float = 30.0
    idle_after: float = 600.0
    stop_after: float = 6 * 3600.0
    compact_every: int = 16
    clock: Callable[[], float] = time.time
    progress: Callable[[dict], None] | None = None
    cancelled: Callable[[], bool] = lambda: False
    stages: Callable[[int, int], None] | None = None
    last_attempt: float = float("-inf")
    last_ingest: float = 0.0
    last_error: str = ""
    last_new: float = field(default=0.0)
    n_ingested: int = 0

    def __post_init__(self) -> None:
        self.last_new = self.clock()

    def entry(self) -> dict:
        """The last log entry: tables of the state (base first), last tick and counts."""
        n = (commits.numbers(self.spark, f"{self.root}/log") or [None])[-1]
        return {"tables": [], "tick": -1, "counts": {}, "step": 0} if n is None else commits.read(self.spark, f"{self.root}/log", n)

    def state(self, entry: dict | None = None) -> DataFrame:
        """The state after the last step: of each path the last of its stored changes."""
        e = entry or self.entry()
        paths = [f"{self.root}/{name}" for name in e["tables"]]
        out = self.spark.read.schema(CHANGE).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGE)
        last = out.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "since", "status"), "step").alias("s")).select("path", "s.*").where("status IS NOT NULL")
        return last.select("path", "size", "mtime", "since", F.lit(e["tick"]).cast("long").alias("tick"), "status")

    def last_tick(self) -> int:
        return self.entry()["tick"]

    def write(self, before: dict, changes: DataFrame, tick: int) -> dict[str, int]:
        """Store changes (with status and was, the status before) and log the step; what was counted while writing."""
        name, seen = f"change-{uuid.uuid4().hex}", Observation()
        count = [F.count_if(F.col(c) == s).alias(f"{c}_{s}") for c in ("status", "was") for s in STATUS]
        fresh = F.count_if(F.col("status").isin("pending", "ready") & (F.col("fresh"))).alias("fresh")
        observed = changes.observe(seen, *count, fresh, F.count(F.lit(1)).alias("n"))
        step = before.get("step", 0) + 1
        observed.select("path", "size", "mtime", "since", "status", F.lit(step).cast("long").alias("step")).write.parquet(f"{self.root}/{name}")
        got = {k: v or 0 for k, v in seen.get.items()}
        counts = {s: before["counts"].get(s, 0) + got[f"status_{s}"] - got[f"was_{s}"] for s in STATUS}
        tables = [*before["tables"], name] if got["n"] else before["tables"]
        if not got["n"]:
            fs, path = _fs(self.spark, self.root)
            fs.delete(path(f"{self.root}/{name}"), True)
        self.log({"tables": tables, "tick": tick, "counts": counts, "step": step})
        return got

    def log(self, entry: dict) -> None:
        """One watcher writes this log: an entry is a step of it. The last few are kept."""
        n, _ = commits.append(self.spark, f"{self.root}/log", lambda n: entry)
        fs, path = _fs(self.spark, self.root)
        for old in commits.numbers(self.spark, f"{self.root}/log"):
            if old < n - 4:
                fs.delete(path(commits.entry_path(f"{self.root}/log", old)), False)
        if len(entry["tables"]) > self.compact_every:
            self.compact(entry)

    def compact(self, entry: dict) -> None:
        """Write the state as a new base; the tables that only older entries name, and those entries, are deleted."""
        name = f"base-{uuid.uuid4().hex}"
        self.state(entry).withColumn("step", F.lit(entry["step"]).cast("long")).drop("tick").write.parquet(f"{self.root}/{name}")
        n, _ = commits.append(self.spark, f"{self.root}/log", lambda n: entry | {"tables": [name]})
        fs, path = _fs(self.spark, self.root)
        for table in entry["tables"]:
            fs.delete(path(f"{self.root}/{table}"), True)
        for old in commits.numbers(self.spark, f"{self.root}/log"):
            if old < n:
                fs.delete(path(commits.entry_path(f"{self.root}/log", old)), False)

    def scan(self, listings: DataFrame) -> None:
        """Take listings into the state; those it has already seen (a batch given again) are left out."""
        before = self.entry()
        new = listings.where(F.col("tick") > before["tick"])
        end = new.agg(F.max("tick")).first()[0]
        if end is None:
            return
        state = self.state(before)
        after = step(state, new, self.usable, self.stable_ticks)
        old = state.select("path", *[F.col(c).alias(f"_{c}") for c in ("size", "mtime", "since")], F.col("status").alias("was"))
        both = after.drop("tick").join(old, "path", "full")
        same = F.col("status").eqNullSafe(F.col("was")) & F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("since").eqNullSafe(F.col("_since"))
        if self.write(before, both.where(~same).withColumn("fresh", F.lit(True)), end)["fresh"]:
            self.last_new = self.clock()

    def empty(self) -> None:
        """The folder has no file any more: forget all."""
        e = self.entry()
        self.log({"tables": [], "tick": e["tick"], "counts": {}, "step": e.get("step", 0)})

    def maybe_ingest(self) -> bool:
        """Run a batch if any file is ready and the last attempt is `cooldown` seconds ago."""
        before, now = self.entry(), self.clock()
        n = before["counts"].get("ready", 0)
        if not n or now - self.last_attempt < self.cooldown or self.cancelled():
            return False
        self.last_attempt = now
        state = self.state(before)
        try:
            files = state.where("status IN ('known', 'ready')").select("path", "size", "mtime")
            if cancellable(self.spark, lambda: self.ingest(files), self.cancelled, self.stages) is False:
                return False
        except Cancelled:
            return False
        except Exception as e:  # noqa: BLE001  the watch goes on; the error is reported and the files stay ready
            self.last_error = f"{type(e).__name__}: {e}"
            return False
        taken = state.where("status = 'ready'").select("path", "size", "mtime", "since", F.lit("known").alias("status"), F.lit("ready").alias("was"), F.lit(False).alias("fresh"))
        self.write(before, taken, before["tick"])
        self.last_error, self.last_ingest, self.n_ingested = "", now, self.n_ingested + n
        return True

    def tick(self, listings: DataFrame) -> None:
        self.scan(listings)
        self.maybe_ingest()
        if self.progress is not None:
            self.progress(self.status())

    def status(self) -> dict:
        """From the last log entry: starts no job."""
        by = self.entry()["counts"]
        return {f"n_{s}": by.get(s, 0) for s in STATUS} | {"n_ingested": self.n_ingested, "last_ingest": self.last_ingest, "last_error": self.last_error, "idle_seconds": self.clock() - self.last_new, "scan_interval": self.interval()}

    def interval(self) -> float:
        """Seconds to the next listing: longer after a quiet while; a file at first sight ends that."""
        return self.scan_idle if self.clock() - self.last_new > self.idle_after else self.scan_every

    def watch_folder(self, folder: str, wait: Callable[[float], None] = time.sleep) -> str:
        """List the folder again and again until cancelled or nothing new came for `stop_after` seconds; says why it ended."""
        while not self.cancelled():
            try:
                now = listing(self.spark, folder, self.last_tick() + 1)
                if now.isEmpty() and self.entry()["tables"]:
                    self.empty()
                self.tick(now)
            except Exception as e:  # noqa: BLE001  one bad pass must not end the watch
                self.last_error = f"{type(e).__name__}: {e}"
            if self.clock() - self.last_new > self.stop_after:
                self.last_error = "watch ended: nothing arrived"
                return self.last_error
            wait(self.interval())
        return "cancelled"

    def watch_stream(self, listings: DataFrame, checkpoint: str):
        """The same over a stream of listings, one step per micro-batch; a batch given again does no harm."""
        return listings.writeStream.foreachBatch(lambda df, _: self.tick(df)).option("checkpointLocation", checkpoint)


def session_bursts(events: DataFrame, gap: str = "2500 milliseconds", late: str = "1 hour") -> DataFrame:
    """Time-only bursts of a stream (camera_id, captured_at): one row per camera and session, updated as events arrive."""
    timed = events.withColumn("t", F.col("captured_at").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("t", late)
    return timed.groupBy("camera_id", F.session_window("t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_frames")).select("camera_id", F.col("w.start").alias("first_at"), "n_frames")
