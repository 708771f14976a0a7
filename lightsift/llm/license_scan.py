"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import ids_of, long_array, slices, text_buffer, text_rows
from .licenses import TEMPLATES

SHINGLE, CONTAINMENT = 5, 0.8
#: Bands of rows: a window that holds a template to CONTAINMENT has Jaccard similarity 0.47 or more with it,
#: so it shares a band with probability 1 - (1 - 0.47**ROWS)**BANDS > 0.9995.
BANDS, ROWS = 32, 2
MOST = np.uint32(0xFFFFFFFF)
#: Templates go to every task, so a table of them may hold so many bytes of text at most.
TEMPLATE_BYTES = 8 << 20
#: A license named by its identifier has too few words for a shingle: it is read as it stands.
TAG = re.compile(rb"spdx-license-identifier:[ \t]*([a-z0-9][a-z0-9.+-]*)")
_rng = np.random.default_rng(77)
_SCALE = _rng.integers(1 << 16, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingled(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, shingles before each text, words of each text."""
    buf = H.LOWER[buf]
    starts, ends, first = H.word_spans(buf, off, H.ALNUM)
    at, doc = H.inside(first, SHINGLE)
    every = H.window_hashes(H.word_hashes(buf, starts, ends), SHINGLE)
    return every[at], np.searchsorted(doc, np.arange(len(first))), np.diff(first)


class Scanner:
    """Templates by window shape (block length, blocks), with their band keys."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        flat = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
        buf, off = text_buffer(pa.array([t for _, t in flat], pa.string()))
        hashes, first, _ = shingled(buf, off)
        self.names, self.sets, shapes = [], [], []
        for k, (name, text) in enumerate(flat):
            own = np.unique(hashes[first[k] : first[k + 1]])
            if not len(own):
                raise ValueError(f"a template needs {SHINGLE} words or more: {text!r}")
            n = int(first[k + 1] - first[k])
            block = 1 << max(0, (n // 4).bit_length() - 1)
            shapes.append((block, n if block == 1 else -(-n // block) + 1))
            self.names.append(name)
            self.sets.append(own)
        self.shapes = {s: np.array([k for k, x in enumerate(shapes) if x == s]) for s in sorted(set(shapes))}
        self.largest = max(s for s, _ in self.shapes)
        self.reach = max(s * m for s, m in self.shapes)
        self.least = np.array([[minhash(own, f).min() for f in range(BANDS * ROWS)] for own in self.sets])

    def find(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first shingle, end shingle, containment) of all verified windows; `best` leaves one license per place."""
        # texts stand apart by more than the longest window, so no window sees two of them
        n = np.diff(first)
        room = -(-(n + self.reach) // self.largest) * self.largest
        base = np.cumsum(room) - room
        place = np.arange(len(hashes)) + np.repeat(base - first[:-1], n)
        padded = np.zeros(int(room.sum()), np.uint32)
        padded[place] = hashes >> np.uint64(32)
        empty = np.ones(len(padded), bool)
        empty[place] = False
        empty = np.flatnonzero(empty)
        hits: list[list[np.ndarray]] = [[] for _ in self.names]
        for band in range(BANDS):
            agree: list[np.ndarray | None] = [None] * len(self.names)
            for f in range(band * ROWS, (band + 1) * ROWS):
                level, block = minhash(padded, f, short=True), 1
                level[empty] = MOST
                w, wide = None, 0
                for (size, blocks), templates in self.shapes.items():  # by block length, then blocks
                    if size > block or w is None:
                        while block < size:
                            level = np.minimum(level[::2], level[1::2])
                            block *= 2
                        w, wide = level.copy(), 1
                    while wide < blocks:
                        np.minimum(w[:-wide], level[wide:], out=w[:-wide])
                        wide += 1
                    for k in templates:
                        had = agree[k]
                        agree[k] = np.flatnonzero(w == self.least[k, f]) if had is None else had[w[had] == self.least[k, f]]
            for k, at in enumerate(agree):
                hits[k].append(at)
        text = np.repeat(np.arange(len(n)), room)
        found = []
        for s, t in self.shapes.items():
            for k in t:
                for w in np.unique(np.concatenate(hits[k])):
                    lo = int(w) * s[0]
                    d = int(text[lo])
                    lo -= int(base[d])
                    if lo >= n[d]:
                        continue
                    hi = min(lo + s[0] * s[1], int(n[d]))
                    own = hashes[first[d] + lo : first[d] + hi]
                    match = np.flatnonzero(np.isin(own, self.sets[k]))
                    share = len(np.unique(own[match])) / len(self.sets[k])
                    if share >= CONTAINMENT:
                        found.append((d, int(k), lo + int(match[0]), lo + int(match[-1]) + 1, share))
        return found


def minhash(h: np.ndarray, f: int, short: bool = False) -> np.ndarray:
    """Hash f of shingles; short: of their upper 32 bits, which is all it looks at."""
    x = h if short else (h >> np.uint64(32)).astype(np.uint32)
    return (x ^ _SHIFT[f]) * _SCALE[f]


def best(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """(license, start, end, containment) of one text without those that overlap a better, or as good but longer, one of another license."""
    out: list[tuple[str, int, int, float]] = []
    for name, lo, hi, share in sorted(found, key=lambda x: (-x[3], x[1] - x[2])):
        if not any(n != name and (s, b - a) > (share, hi - lo) and lo < b and a < hi for n, a, b, s in out):
            out.append((name, lo, hi, share))
    return out


def tags(texts: pa.Array) -> dict[int, list[dict]]:
    """SPDX tags of each text that has any, with the words they stand at."""
    out: dict[int, list[dict]] = {}
    held = pc.fill_null(pc.match_substring(texts, "spdx-license-identifier:", ignore_case=True), False)
    for d in np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist():
        raw = texts[d].as_py().encode()
        starts, ends, _ = H.word_spans(buf := H.LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(buf)]), H.ALNUM)
        for m in TAG.finditer(buf.tobytes()):
            name = raw[m.start(1) : m.end(1)].decode()
            out.setdefault(d, []).append({"license": NAMES.get(name.lower(), name), "start": int(np.searchsorted(starts, m.start())), "end": int(np.searchsorted(starts, m.end())), "containment": 1.0})
    return out


NAMES = {n.lower(): n for n in TEMPLATES}
MATCH = "array<struct<license:string,start:long,end:long,containment:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | DataFrame | None = None) -> DataFrame:
    """id, n_words and matches (license, word interval [start, end), containment) of each whole text.

    A-Z is lower-cased; words are runs of digits, letters a-z and anything beyond ASCII. A match is a
    window that holds at least 0.8 of a template's distinct five-word shingles; matches of one license
    that overlap are one, and where licenses overlap the one of the highest containment stays. An SPDX tag is a
    match of containment 1 whatever else is there. Null texts and texts of under five words have no other matches.
    Templates, a table (license, text) of at most TEMPLATE_BYTES or the given ones, go to the executors; documents
    are not shuffled. Templates of fewer than five words can't be told and are an error. One row per input row.
    """
    if isinstance(templates, DataFrame):
        size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > TEMPLATE_BYTES:
            raise ValueError(f"templates of {size} bytes are too many to send to every task")
        by = templates.where("license IS NOT NULL AND text IS NOT NULL").groupBy("license").agg(F.array_sort(F.collect_set("text")).alias("texts"))
        templates = {r["license"]: r["texts"] for r in by.collect()}  # at most TEMPLATE_BYTES
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates))
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes, first, n_words = shingled(*text_buffer(b.column(1)))
            every: list[list[tuple[str, int, int, float]]] = [[] for _ in range(b.num_rows)]
            for d, k, lo, hi, share in scanner.value.find(hashes, first) if len(hashes) else ():
                every[d].append((scanner.value.names[k], lo, hi + SHINGLE - 1, share))
            told = tags(b.column(1))
            out = []
            for d, windows in enumerate(every):
                found: dict[str, list] = {}
                for name, lo, hi, share in best(windows):
                    found.setdefault(name, []).append((lo, hi, share))
                merged = []
                for name, spans in sorted(found.items()):
                    start = len(merged)
                    for lo, hi, share in sorted(spans):
                        if len(merged) > start and lo < merged[-1]["end"]:
                            merged[-1]["end"] = max(merged[-1]["end"], hi)
                            merged[-1]["containment"] = max(merged[-1]["containment"], share)
                        else:
                            merged.append({"license": name, "start": lo, "end": hi, "containment": share})
                out.append(merged + told.get(d, []))
            yield pa.RecordBatch.from_arrays([long_array(ids_of(b.column(0))), b.column(2), pa.array(n_words), pa.array(out, kind)], names=["id", "key", "n_words", "matches"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, f"id long, key long, n_words long, matches {MATCH}").drop("key")
