"""Immutable generations of a run's tables behind one pointer."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lightsift.functions.scalars import next_version

POINTER = "_current"


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, of = _fs(spark, path)
    return bool(fs.exists(of(path)))


def signature(spark: SparkSession, path: str) -> str:
    """Digest of names, sizes and times of the files under a path."""
    fs, of = _fs(spark, path)
    files = fs.listFiles(of(path), True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:16]


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first: each has a marker file, made by one rename."""
    fs, path = _fs(spark, root)
    at = path(f"{root}/{POINTER}")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []


def current(spark: SparkSession, root: str) -> int:
    return (versions(spark, root) or [0])[-1]


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame] | Callable[[str], None], counts: dict[str, int] | None = None) -> int:
    """Write all tables of the next generation, then make it current; a failure leaves the old one. Keeps two.

    The marker file that makes it current holds the counts, see `poll`.
    """
    fs, path = _fs(spark, root)
    v = next_version(current(spark, root))
    home = f"{root}/gen={v}"
    fs.delete(path(home), True)
    if callable(tables):
        tables(home)
    else:
        for name, df in tables.items():
            df.write.parquet(f"{home}/{name}")
    fs.mkdirs(path(f"{root}/{POINTER}"))
    staged = path(f"{root}/{POINTER}/.{v}")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(counts or {}).encode()))
    out.close()
    if not fs.rename(staged, path(f"{root}/{POINTER}/{v}")):
        raise OSError(f"version {v} can't be published")
    for old in versions(spark, root)[:-2]:
        fs.delete(path(f"{root}/{POINTER}/{old}"), False)
        fs.delete(path(f"{root}/gen={old}"), True)
    return v


def poll(spark: SparkSession, root: str) -> dict[str, int]:
    """The current version (0: none) with the counts it was published with; no table is read."""
    v = current(spark, root)
    if not v:
        return {"version": 0}
    fs, path = _fs(spark, root)
    stream = fs.open(path(f"{root}/{POINTER}/{v}"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {"version": v} | json.loads(text or "{}")


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of one generation: the pointer is looked up once, files never change under a reader."""
    return spark.read.parquet(f"{root}/gen={current(spark, root) if version is None else version}/{name}")


def is_stale(asked: str | int | None, now: int) -> bool:
    """True for a readable version other than the current one."""
    try:
        return int(asked) != now
    except (TypeError, ValueError):
        return False
