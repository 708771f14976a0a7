"""Image files as rows: scans, pairing keys, byte repair and decoding by an injected function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsift.operators.dedup import without_paired_raw

# File endings read as images, and the first bytes of their formats in hex.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "cr2", "cr3", "nef", "arw", "raf", "rw2", "orf", "dng")
MAGIC = ("FFD8FF", "89504E470D0A1A0A", "52494646")


def path_parts(path: Column) -> dict[str, Column]:
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return {"dir": F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "name": name, "stem": F.regexp_replace(name, r"\.[^.]+$", ""), "ext": ext}


def scan_images(spark: SparkSession, root: str, recursive: bool = True, content: bool = False, paired: bool = False) -> DataFrame:
    """Image files under root without RAW files that have another format beside them (unless paired); bytes only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    cols = ["path", "modificationTime", "length", *(["content"] if content else [])]
    images = files.select(*cols).withColumns(path_parts(F.col("path"))).where(F.col("ext").isin(*EXTENSIONS))
    return images if paired else without_paired_raw(images)


def repaired(content: Column, lead: int = 8) -> Column:
    """Content without up to `lead` bytes that stand before a known format's first bytes; else unchanged."""
    hexed = F.hex(F.substring(content, 1, lead + 8))
    at = F.least(*[F.when(F.instr(hexed, m) % 2 == 1, F.instr(hexed, m)) for m in MAGIC])
    skip = ((at - 1) / 2).cast("int")
    return F.when((skip > 0) & (skip <= lead), F.substring(content, skip + 1, F.length(content))).otherwise(content)


def decoded(files: DataFrame, decode: Callable[[bytes], dict], schema: str, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """keep columns, what decode(content) gives, and error: null, or why the decoder failed (its columns are null then).

    schema names the decoder's columns. Callers take rows without error, and count or report the others.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rec in b.to_dict("records"):
                own = {k: rec[k] for k in keep}
                try:
                    rows.append(own | decode(bytes(rec["content"])) | {"error": None})
                except Exception as e:  # noqa: BLE001  any decoder error means: not decodable
                    rows.append(own | dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[*keep, *names, "error"]).astype(object)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema.fields)
    return files.select(*keep, "content").mapInPandas(run, f"{kinds}, {schema}, error string")
