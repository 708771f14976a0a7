"""Streams: listings as a source, and bursts with keyed state."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightsift.operators import bursts as BU
from lightsift.streaming import bursts as SB
from lightsift.streaming import listings as SL


def run(stream, path, checkpoint, mode="append"):
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(240)
    finally:
        q.stop()


@pytest.fixture
def rocks(spark):
    for k, v in SB.ROCKS.items():
        spark.conf.set(k, v)
    yield
    for k in SB.ROCKS:
        spark.conf.unset(k)


def test_replayed_stream_is_cut_like_the_table(spark, tmp_path, rocks):
    """Frames arrive in four files, some late and out of order; what comes out is what burst_ids says of all of them."""
    rng, t0, rows = np.random.default_rng(4), datetime(2024, 1, 1), []
    for i in range(160):
        emb = None if i % 17 == 0 else [float(v) for v in rng.normal(size=2)]
        rows.append((f"p{i:03}", f"c{int(rng.integers(3))}", t0 + timedelta(seconds=int(rng.integers(0, 400))), emb))
    kind = "path string, camera_id string, captured_at timestamp_ntz, emb array<double>"
    # by arrival: up to 40 seconds late; a last frame of each camera long after pushes the watermark past all others
    rows.sort(key=lambda r: r[2] + timedelta(seconds=int(r[0][1:]) % 40))
    parts = [rows[:50], rows[50:100], rows[100:], [(f"end{c}", f"c{c}", t0 + timedelta(hours=1), None) for c in range(3)], [("end", "c0", t0 + timedelta(hours=2), None)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i in (1, 4):  # stopped and started again in between
            run(SB.burst_stream(stream, 2, 8, 0.5, late="50 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {r.path: (r.camera_id, r.burst) for r in out.where("NOT closed").collect() if not r.path.startswith("end")}
    cut = BU.burst_ids(spark.createDataFrame(rows, kind), 2, 8, 0.5).collect()
    first = {}
    for r in cut:
        first[r.camera_id] = min(first.get(r.camera_id, r.burst_id), r.burst_id)
    assert got == {r.path: (r.camera_id, r.burst_id - first[r.camera_id]) for r in cut}
    ends = {}
    for r in cut:
        key = r.camera_id, r.burst_id - first[r.camera_id]
        ends[key] = max(ends.get(key, r.captured_at), r.captured_at)
    assert {(r.camera_id, r.burst): r.captured_at for r in out.where("closed").collect() if (r.camera_id, r.burst) in ends} == ends


def test_listings_are_neither_lost_nor_repeated(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "day1").mkdir(parents=True)
    (folder / "a.jpg").write_text("a")
    (folder / "day1" / "b.cr2").write_text("bb")
    (folder / "day1" / "note.txt").write_text("no")
    spark.dataSource.register(SL.FolderListings)
    stream = lambda: spark.readStream.format("folder_listings").option("path", f"file://{folder}").option("log", f"file://{tmp_path}/log").load()
    seen = lambda: sorted((r.tick, r.path.split("/")[-1], r.size) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    def trigger(fail=False):
        def write(df, n):
            df = df.withColumn("batch", F.lit(n))
            if fail:
                df.count()  # tasks list the folder, then the batch fails
                raise RuntimeError("lost")
            df.write.mode("append").parquet(str(tmp_path / "out"))

        q = stream().writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        try:
            q.awaitTermination(120)
        except Exception as e:  # noqa: BLE001  the batch that is meant to fail
            assert fail and "lost" in str(e)
        q.stop()

    trigger()
    assert seen() == [(0, "a.jpg", 1), (0, "b.cr2", 2)]
    (folder / "c.png").write_text("ccc")
    trigger(fail=True)
    (folder / "c.png").unlink()  # the batch given again is the listing that was taken
    trigger()
    ticks = {t for t, *_ in seen()}
    assert ticks == {0, 1} and [x for x in seen() if x[0] == 1] == [(1, "a.jpg", 1), (1, "b.cr2", 2), (1, "c.png", 3)]
    (folder / "a.jpg").write_text("aaaa")
    trigger()
    assert [x for x in seen() if x[0] == 2] == [(2, "a.jpg", 4), (2, "b.cr2", 2)]
    assert len([p for p in (tmp_path / "log").iterdir() if p.name.startswith("listing-")]) <= 2
