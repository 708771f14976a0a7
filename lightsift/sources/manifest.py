"""What changed since last time: digests, features and listings reused by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNATURE = ["size", "mtime"]


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, size, mtime) that the manifest lacks or has with another signature: only these are read again."""
    return files.join(manifest.select("path", *SIGNATURE), ["path", *SIGNATURE], "left_anti")


def reused(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.join(manifest.select("path", *SIGNATURE, "sha1"), ["path", *SIGNATURE])


def misses(wanted: DataFrame, cache: DataFrame, key: tuple[str, ...] = ("sha1", "kind", "encoder_id")) -> DataFrame:
    """Features still to be computed."""
    return wanted.join(cache.select(*key), list(key), "left_anti")


def vanished(before: DataFrame, now: DataFrame) -> DataFrame:
    return before.join(now.select("path"), "path", "left_anti")


def namespaced(encoder: Column, settings: str, default: str) -> Column:
    """Encoder id, marked with a digest of the settings where they are not the default ones."""
    return encoder if settings == default else F.concat(encoder, F.lit("+cfg-"), F.substring(F.sha2(F.lit(settings), 256), 1, 16))
