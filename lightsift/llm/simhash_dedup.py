"""SimHash near-duplicates by anchor-point covering.

64-bit SimHash of lower-cased word shingles. Equal fingerprints are one point. Two fingerprints that
differ in at most `threshold` bits are found at anchors: the first 46 bits are two words of 23 bits,
and the codewords of the perfect binary Golay code (covering radius 3) are the anchors of each. A
point is at home at its nearest anchor pair (radius 3 in each half) and is replicated to every anchor
pair within radius + e1 and radius + e2 with e1 + e2 <= threshold. If x and y differ in d1 and d2 bits
of the two halves (d1 + d2 <= threshold), the home of x is within 3 + d1 and 3 + d2 of y, so y is
there: no link is lost. The remaining 18 bits only enter the final comparison of all 64 bits.
The home points of an anchor are dealt to cells of about HOMES points; each cell gets what is
replicated to the anchor, so a crowded anchor is the work of many tasks, and a task holds one cell's homes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MERGE, ids_of, long_array, same, slices, text_rows, text_rows_key, written
from .components import components

LENGTH, RADIUS = 23, 3
#: Home points of an anchor that are compared in one place.
HOMES = 2048
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, key, fp: the 64-bit SimHash (as a signed long) of each whole text.

    A-Z is lower-cased; words are runs without ASCII white space; shingles of `shingle` words joined
    by one space are hashed by XXH64 with seed 42, repeats included. A text of fewer words is one
    shingle; one without words (also null) has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h64 = xxhash.xxh64_intdigest
        for b in slices(batches):
            out = np.zeros(b.num_rows, np.uint64)
            for i, text in enumerate(b.column(1).to_pylist()):
                words = text.encode().lower().split()
                if not words:
                    continue
                line = b" ".join(words)
                ends = np.cumsum([len(w) + 1 for w in words]) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                k = min(shingle, len(words))
                out[i] = simhash(np.array([h64(line[s:e], 42) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))
            yield pa.RecordBatch.from_arrays([long_array(ids_of(b.column(0))), b.column(2), pa.array(out.view(np.int64))], names=["id", "key", "fp"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "id long, key long, fp long")


def simhash(h: np.ndarray) -> np.uint64:
    """Bits that are set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0]


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each bit; by syndrome the error patterns of weight up to 5 and their excess over the covering radius (99: no pattern)."""

    def rest(v: int) -> int:
        for i in range(LENGTH - 1, 10, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - 11)
        return v

    unit = [rest(1 << i) for i in range(LENGTH)]
    by: dict[int, list[tuple[int, int]]] = {}
    for weight in range(RADIUS + 3):
        for bits in combinations(range(LENGTH), weight):
            s = 0
            for i in bits:
                s ^= unit[i]
            by.setdefault(s, []).append((max(weight - RADIUS, 0), sum(1 << i for i in bits)))
    most = max(map(len, by.values()))
    table = np.array([by[s] + [(99, 0)] * (most - len(by[s])) for s in range(len(by))], np.int64)
    return np.array(unit), table[:, :, 1], table[:, :, 0]


def syndromes(word: np.ndarray) -> np.ndarray:
    unit = golay_tables()[0]
    s = np.zeros(len(word), np.int64)
    for i in range(LENGTH):
        s ^= np.where(word >> i & 1, unit[i], 0)
    return s


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (number of a fingerprint, anchor, excess over the covering radius; 0 at home)."""
    _, patterns, excess = golay_tables()
    u = fp.view(np.uint64)
    low, high = (u & np.uint64((1 << LENGTH) - 1)).astype(np.int64), ((u >> np.uint64(LENGTH)) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    a, b = syndromes(low), syndromes(high)
    both = excess[a][:, :, None] + excess[b][:, None, :]
    i, x, y = np.nonzero(both <= threshold)
    return i, (low[i] ^ patterns[a[i], x]) << LENGTH | (high[i] ^ patterns[b[i], y]), both[i, x, y]


def links(points: DataFrame, threshold: int = 2, homes: int = HOMES) -> DataFrame:
    """Pairs (a < b) of fingerprints in `fp` that differ in 1 to threshold (at most 2) bits, enough to connect all that do."""
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors cover thresholds up to 2")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                i, anchor, excess = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(part[i]), pa.array(anchor), pa.array(excess == 0)], names=["fp", "anchor", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and cell, homes first: each home point against what the cell holds, batch by batch."""
        cell, own = None, np.zeros(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            a, c, fp, home = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fp = fp.view(np.uint64)
            edges = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]), [True]]))
            left, right = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                mine = fp[lo:hi][home[lo:hi]]
                own = np.concatenate([own, mine]) if lo == 0 and (int(a[0]), int(c[0])) == cell else mine
                if hi - lo == 1 and len(own) <= len(mine):
                    continue  # alone
                for s in range(0, len(own), 512):
                    for t in range(lo, hi, 4096):
                        d = np.bitwise_count(own[s : s + 512, None] ^ fp[None, t : min(hi, t + 4096)])
                        i, j = np.nonzero((d <= threshold) & (d > 0))
                        if len(i):
                            x, y = spanning(own[s + i], fp[t + j])
                            left.append(x)
                            right.append(y)
            cell = int(a[-1]), int(c[-1])
            if left:
                x, y = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    placed = points.select("fp").mapInArrow(spread, "fp long, anchor long, home boolean")
    # Spark sizes what spread returns by its input, which has a sixtieth of the rows, so it would be broadcast
    cells = placed.where("home").groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / homes).cast("int").alias("cells"))
    dealt = placed.join(cells.hint(MERGE), "anchor").select("anchor", F.explode(F.expr("sequence(0, cells - 1)")).alias("cell"), "fp", "home", "cells")
    dealt = dealt.select("anchor", "cell", "fp", (F.col("home") & (F.pmod(F.xxhash64("fp"), "cells") == F.col("cell"))).alias("home"))
    sorted_ = dealt.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", F.desc("home"), "fp")
    return sorted_.mapInArrow(compare, "a long, b long").distinct()


def spanning(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what the links (x, y) connect: each point with the least one of its part."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """id, key, fp, component_id (the smallest id that links of at most `threshold` bits reach) and best, true for that row.

    Texts without words (and null) have fingerprint zero and link like any other. A null id is larger
    than any other (a component of null ids only has a null component_id). One row per input row; rows
    that repeat id and text are the same document, so they are best together.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "prints")
    points = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("least"))
    found = written(links(points, threshold), "links")
    root = components(found, "a", "b")
    # the first document of each connected set of fingerprints
    labelled = points.join(root.hint(MERGE), points.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = labelled.groupBy("root").agg(F.min("least").alias("first"))
    of = written(labelled.join(first.hint(MERGE), "root").select("fp", "first"), "classes")
    best = same(F.col("id"), F.col("first.id")) & (F.col("key") == F.col("first.key"))
    return prints.join(of.hint(MERGE), "fp").select("id", "key", "fp", F.col("first.id").alias("component_id"), best.alias("best"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """One row of docs, all columns, for each component: the one that comes first in it.

    Of rows that repeat id and text the least by the columns in order stays (columns of maps do not count).
    Repeats are reduced before and after the shuffle, so a frequent row does not meet in one task.
    """
    stay = simhash_dedup(docs, id_col, text_col, shingle, threshold).where("best").select(F.col("key").alias(KEY)).distinct()
    order = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.select(text_rows_key(id_col, text_col).alias(KEY), F.struct(*[f"`{c}`" for c in docs.columns]).alias(ROW), F.struct(*order).alias(RANK))
    once = rows.groupBy(KEY).agg(F.min_by(ROW, RANK).alias(ROW))
    return once.join(stay.hint(MERGE), KEY, "left_semi").select(f"{ROW}.*")


KEY, ROW, RANK = "__row_key__", "__row__", "__rank__"
