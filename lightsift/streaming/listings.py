"""Listings of a folder as a stream source: one listing per trigger, stored until committed, so that a batch given again is the same."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lightsift.sources.images import EXTENSIONS

SCHEMA = "tick bigint, path string, size bigint, mtime bigint"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def write_once(fs: pafs.FileSystem, path: str, text: str) -> None:
    """The file, whole; a second writer of the same file writes what is there already or wins with a listing as good."""
    staged = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(staged) as out:
        out.write(text.encode())
    fs.move(staged, path)


def text_of(fs: pafs.FileSystem, path: str) -> str | None:
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(path) as f:
        return f.read().decode()


class Part(InputPartition):
    """One folder of one listing; the files directly in it (deep False), or all under it."""

    def __init__(self, tick: int, number: int, folder: str, deep: bool) -> None:
        super().__init__((tick, number))
        self.tick, self.number, self.folder, self.deep = tick, number, folder, deep


class ListingReader(DataSourceStreamReader):
    """Offset: the number of listings taken. The driver names a listing's folders, tasks list them and store what they saw."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.log = options["path"].rstrip("/"), options["log"].rstrip("/")

    def initialOffset(self) -> dict:
        return {"listing": -1}

    def latestOffset(self) -> dict:
        """The next listing: after all that are stored, taken anew at each trigger."""
        fs, at = opened(self.log)
        fs.create_dir(at, recursive=True)
        known = [int(os.path.basename(f.path)[8:]) for f in fs.get_file_info(pafs.FileSelector(at)) if os.path.basename(f.path).startswith("listing-")]
        done = text_of(fs, f"{at}/committed")
        n = max([*known, -1 if done is None else int(done)]) + 1
        files, root = opened(self.root)
        inside = [f.path for f in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.type == pafs.FileType.Directory]
        fs.create_dir(f"{at}/listing-{n}", recursive=True)
        write_once(fs, f"{at}/listing-{n}/folders", json.dumps([(root, False), *[(p, True) for p in sorted(inside)]]))
        return {"listing": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, at = opened(self.log)
        out: list[InputPartition] = []
        for n in range(start["listing"] + 1, end["listing"] + 1):
            told = text_of(fs, f"{at}/listing-{n}/folders")
            out += [Part(n, i, folder, deep) for i, (folder, deep) in enumerate(json.loads(told or "[]"))]
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        fs, at = opened(self.log)
        stored = f"{at}/listing-{part.tick}/part-{part.number}"
        told = text_of(fs, stored)
        if told is None:
            files, _ = opened(self.root)
            seen = files.get_file_info(pafs.FileSelector(part.folder, recursive=part.deep, allow_not_found=True))
            rows = [(f.path, f.size, f.mtime_ns // 1000) for f in seen if f.type == pafs.FileType.File and f.extension.lower() in EXTENSIONS]
            write_once(fs, stored, json.dumps(rows))
            told = text_of(fs, stored)
        for path, size, mtime in json.loads(told):
            yield part.tick, path, size, mtime

    def commit(self, end: dict) -> None:
        """Batches up to end are done: their listings are not asked for again, all but the last are deleted."""
        fs, at = opened(self.log)
        write_once(fs, f"{at}/committed", str(end["listing"]))
        for f in fs.get_file_info(pafs.FileSelector(at)):
            name = os.path.basename(f.path)
            if name.startswith("listing-") and int(name[8:]) < end["listing"]:
                fs.delete_dir(f.path)


class FolderListings(DataSource):
    """spark.readStream.format("folder_listings").option("path", folder).option("log", folder for the listings).load(): tick, path, size
    and mtime (microseconds) of the image files under path, a new tick at each trigger. Register with spark.dataSource.register."""

    @classmethod
    def name(cls) -> str:
        return "folder_listings"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingReader(dict(self.options))
