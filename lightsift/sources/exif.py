"""Capture data and previews read from file bytes: EXIF of JPEG, PNG, WebP and RAW files, embedded JPEG previews."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightsift.functions import scalars as S

# Numbers of the fields read, in the main and the EXIF directory, and sizes of the TIFF value types.
FIELDS = {0x010F: "make", 0x0110: "model", 0x9003: "taken", 0x9291: "subsec", 0xA431: "serial", 0xC62F: "serial", 0xA434: "lens"}
EXIF_DIRECTORY = 0x8769
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


# How files with a TIFF structure begin (plain, RW2, ORF), how RAF begins and where it says where its JPEG is,
# and the identifier of the box in CR3 whose inner boxes hold the main and the EXIF directory.
TIFF_HEADS = (b"II*\0", b"MM\0*", b"IIU\0", b"IIRO", b"IIRS", b"MMOR")
RAF_HEAD, RAF_JPEG_AT = b"FUJIFILMCCD-RAW", 84
CR3_BOX, CR3_DIRECTORIES = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48"), (b"CMT1", b"CMT2")


def boxes(content: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the bodies of the boxes between two places: a size of 32 or 64 bits, four letters, the body."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        head = 8
        if size == 1 and at + 16 <= end:
            (size,), head = struct.unpack(">Q", content[at + 8 : at + 16]), 16
        size = size or end - at
        if size < head:
            return
        yield kind, at + head, min(at + size, end)
        at += size


def tiff_parts(content: bytes) -> list[tuple[int, int]]:
    """(start, end) of the TIFF structures with the EXIF data of a file."""
    if content[:4] in TIFF_HEADS:
        return [(0, len(content))]
    at = 0
    if content.startswith(RAF_HEAD) and len(content) >= RAF_JPEG_AT + 4:
        (at,) = struct.unpack(">I", content[RAF_JPEG_AT : RAF_JPEG_AT + 4])
    if content[at : at + 2] == b"\xff\xd8":  # JPEG: segments of a marker and a length
        at += 2
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
            size = struct.unpack(">H", content[at + 2 : at + 4])[0]
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                return [(at + 10, len(content))]
            at += 2 + size
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = content.find(b"eXIf", 8)
        return [(at + 4, len(content))] if at > 0 else []
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":  # chunks of four letters, a length and a body of even size
        at = 12
        while at + 8 <= len(content):
            kind, size = struct.unpack("<4sI", content[at : at + 8])
            if kind == b"EXIF":
                skip = 6 if content[at + 8 : at + 14] == b"Exif\0\0" else 0
                return [(at + 8 + skip, at + 8 + size)]
            at += 8 + size + size % 2
    if content[4:12] == b"ftypcrx ":
        for kind, lo, hi in boxes(content, 0, len(content)):
            if kind == b"moov":
                for inner, a, b in boxes(content, lo, hi):
                    if inner == b"uuid" and content[a : a + 16] == CR3_BOX:
                        return [(x, y) for name, x, y in boxes(content, a + 16, b) if name in CR3_DIRECTORIES]
    return []


def read_exif(content: bytes) -> dict[str, str]:
    """make, model, serial, lens, taken and subsec as far as they are there; nothing from other or damaged files."""
    out: dict[str, str] = {}
    for start, end in tiff_parts(content):
        read_fields(content[start:end], out)
    return out


def read_fields(data: bytes, out: dict[str, str]) -> None:
    """Add the fields of one TIFF structure that are not there yet."""
    todo, seen = [], set()
    try:
        order = "<" if data[:2] == b"II" else ">"
        todo.append(struct.unpack(order + "I", data[4:8])[0])
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            (n,) = struct.unpack(order + "H", data[at : at + 2])
            for i in range(n):
                tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
                value = data[at + 10 + 12 * i : at + 14 + 12 * i]
                if tag == EXIF_DIRECTORY:
                    todo.append(struct.unpack(order + "I", value)[0])
                elif tag in FIELDS and kind in (2, 7):
                    size = SIZES[kind] * count
                    where = struct.unpack(order + "I", value)[0]
                    raw = value[:size] if size <= 4 else data[where : where + size]
                    text = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
                    if text:
                        out.setdefault(FIELDS[tag], text)
    except struct.error:
        pass  # cut off: what was read counts


def preview(content: bytes) -> bytes | None:
    """The largest JPEG embedded in a RAW file, or the file itself if it is a JPEG; None without any."""
    if content[:3] == b"\xff\xd8\xff":
        return content
    best, at = None, content.find(b"\xff\xd8\xff")
    while at >= 0:
        end = content.find(b"\xff\xd9", at)
        following = content.find(b"\xff\xd8\xff", at + 3)
        # a thumbnail inside of a preview's own header ends before the preview does
        while end >= 0 and 0 <= following < end:
            inner = content.find(b"\xff\xd9", end + 2)
            if inner < 0:
                break
            following, end = content.find(b"\xff\xd8\xff", following + 3), inner
        if end < 0:
            break
        if best is None or end + 2 - at > len(best):
            best = content[at : end + 2]
        at = content.find(b"\xff\xd8\xff", end + 2)
    return best


def with_capture_data(files: DataFrame, keep: tuple[str, ...] = ("path", "name")) -> DataFrame:
    """keep columns of files (..., name, content) with camera_id and captured_at (null where the file doesn't say)."""
    names = ["make", "model", "serial", "lens", "taken", "subsec"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read_exif(bytes(c)) for c in b["content"]]
            yield b[list(keep)].assign(**{n: [g.get(n) for g in got] for n in names})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema.fields)
    read = files.select(*keep, "content").mapInPandas(run, kinds + "".join(f", {n} string" for n in names))
    at = S.capture_time(F.col("taken"), F.col("subsec"))
    return read.select(*keep, S.camera_of(F.col("serial"), F.col("make"), F.col("model"), F.col("lens"), F.col("name")).alias("camera_id"), at.alias("captured_at"))
