"""Benchmark decontamination by winnowing: least word-gram hash of each window on both sides, hits extended to whole windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import ids_of, long_array, rows_where, slices, small_batches, text_buffer, text_rows, written

SPAN = "array<struct<start:long,end:long>>"


class BenchmarkIndex:
    """Distinct windows of a bounded block of benchmark items, the items of each, and their winnowed grams."""

    def __init__(self, items: list[tuple[str, str]], window: int, gram: int) -> None:
        self.names, self.window, self.gram = sorted({n for n, _ in items}), window, gram
        number = {n: i for i, n in enumerate(self.names)}
        buf, off = text_buffer(pa.array([t for _, t in items], pa.string()))
        words, first = hashed_words(buf, off)
        item = np.array([number[n] for n, _ in items], np.int64)
        n = np.diff(first)
        #: By length (that of a window, and of items that are shorter): sorted hashes of the distinct windows, and the items of each.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({window, *n[(n > 0) & (n < window)].tolist()}):
            start, doc = H.inside(first, length)
            whole = n[doc] == length if length < window else np.ones(len(doc), bool)
            h = H.window_hashes(words, length)[start[whole]]
            both = np.unique(np.rec.fromarrays([h, item[doc[whole]]], names="h,i"))
            keys, at = np.unique(both.h, return_index=True)
            self.windows[length] = keys, np.append(at, len(both)), np.ascontiguousarray(both.i)
        start, _ = H.inside(first, window)
        grams = H.window_hashes(words, gram)
        self.prints = np.unique(grams[winnow(grams, start, window - gram + 1)])

    def find(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """first (words before each text), mask of hit words, and the distinct (text, item) pairs of hits."""
        words, first = hashed_words(buf, off)
        starts, ends, docs, which = [], [], [], []
        for length, (keys, at, items) in self.windows.items():
            start, doc = H.inside(first, length)
            h = H.window_hashes(words, length)
            if length == self.window:  # only windows around a shared fingerprint are compared whole
                near = np.zeros(len(words) + 1, bool)
                grams = H.window_hashes(words, self.gram)
                picked = winnow(grams, start, length - self.gram + 1)
                picked = picked[sorted_in(grams[picked], self.prints)]
                for back in range(length - self.gram + 1):
                    near[picked[picked >= back] - back] = True
                start, doc = start[near[start]], doc[near[start]]
            hit = sorted_in(h[start], keys)
            start, doc = start[hit], doc[hit]
            starts.append(start)
            ends.append(start + length)
            # a window that a text repeats counts once; then every item that has it
            pair = np.unique(np.stack([doc, np.searchsorted(keys, h[start])]), axis=1)
            n = at[pair[1] + 1] - at[pair[1]]
            docs.append(np.repeat(pair[0], n))
            which.append(items[np.repeat(at[pair[1]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
        mask = H.cover(np.concatenate(starts), np.concatenate(ends), len(words))
        pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(which)]), axis=1)
        return first, mask, pairs[0], pairs[1]


def sorted_in(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where a value is among the sorted keys."""
    at = np.searchsorted(keys, values)
    return (at < len(keys)) & (keys[np.minimum(at, max(len(keys) - 1, 0))] == values) if len(keys) else np.zeros(len(values), bool)


def hashed_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buf = H.LOWER[buf]
    starts, ends, first = H.word_spans(buf, off, H.ALNUM)
    return H.word_hashes(buf, starts, ends), first


def winnow(grams: np.ndarray, start: np.ndarray, w: int) -> np.ndarray:
    """Places of the (leftmost) least gram hash of each window that starts at `start` and holds w grams."""
    if not len(start):
        return start
    best, place = grams[start], start.copy()
    for t in range(1, w):
        h = grams[start + t]
        less = h < best
        best = np.where(less, h, best)
        place[less] = start[less] + t
    return np.unique(place)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """Find every run of `window` words that a document shares with a benchmark item.

    A-Z is lower-cased; words are runs of digits, letters a-z and anything beyond ASCII. Of each window
    the least of its gram hashes is kept, in documents and items alike; equal hashes are looked up and
    extended to the windows around them, so every shared window is found. An item of fewer words (but
    not none) is one window. The index of a benchmark of at most `block_bytes` is sent to the executors;
    beyond that fingerprints and windows are joined (see `joined_hits`), with the same result.

    Returns id, n_words, spans (hit word intervals [start, end)) and items (item ids as strings,
    sorted), one row per input row. Null texts have no words; a null item id is named ''; items that repeat an id are one item.
    """
    rows = text_rows(docs, id_col, text_col)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    total = int(items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0)
    if total <= block_bytes:
        found = in_block(rows, [(r["item"], r["text"]) for r in items.collect()], window, gram)  # at most block_bytes
        return found.drop("key")
    hits, owners = joined_hits(rows, items, window, gram)
    names = hits.select("key", "length", "h").distinct().join(owners, ["length", "h"]).select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    places = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    step = "CASE WHEN size(a) > 0 AND s.start <= element_at(a, -1).end THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))) ELSE concat(a, array(s)) END"
    merged = places.withColumn("spans", F.expr(f"aggregate(spans, cast(array() as {SPAN}), (a, s) -> {step})")).join(names, "key")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return counted(rows).join(merged, "key", "left").select("id", "n_words", none("spans", SPAN), none("items", "array<string>"))


def joined_hits(rows: DataFrame, items: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(key, start, length, h) of the document windows that items have, and (length, h, item), by joins alone.

    Distinct fingerprints of the items (winnowed grams, and whole items shorter than a window by their length) meet the
    distinct ones of each document; documents that share any send the windows around those, and windows meet by hash.
    A fingerprint of the items is one row on its side however many items have it, so a frequent one multiplies nothing;
    the documents that hold it are split by Spark's skew join.
    """
    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words, first = hashed_words(*text_buffer(b.column(1)))
            n = np.diff(first)
            for length in sorted({window, *n[(n > 0) & (n < window)].tolist()}):
                start, doc = H.inside(first, length)
                ok = n[doc] == length if length < window else np.ones(len(doc), bool)
                h = H.window_hashes(words, length)[start[ok]] if len(start) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), length, np.int32)), pa.array(h.view(np.int64)), b.column(0).take(pa.array(doc[ok]))], names=["length", "h", "item"])

    def prints_of(batches: Iterator[pa.RecordBatch], lengths: list[int], which: int, key: bool) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words, first = hashed_words(*text_buffer(b.column(which)))
            for length in [window, *lengths]:
                start, doc = H.inside(first, length)
                if not len(start):
                    continue
                if length == window:
                    grams = H.window_hashes(words, gram)
                    at = winnow(grams, start, window - gram + 1)
                    h, doc = grams[at], np.searchsorted(first, at, "right") - 1
                else:
                    h = H.window_hashes(words, length)[start]
                pair = np.unique(np.rec.fromarrays([doc, h], names="d,h"))
                cols = [pa.array(np.full(len(pair), length, np.int32)), pa.array(np.ascontiguousarray(pair.h).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*cols, b.column(2).take(pa.array(np.ascontiguousarray(pair.d)))] if key else cols, names=["length", "h", "key"] if key else ["length", "h"])

    owners = written(items.mapInArrow(of_items, "length int, h long, item string").distinct(), "windows")
    short = sorted(r["length"] for r in owners.where(F.col("length") < window).select("length").distinct().collect())  # fewer than a window's words
    prints = items.mapInArrow(lambda b: prints_of(b, [], 1, False), "length int, h long").unionByName(owners.where(F.col("length") < window).select("length", "h")).distinct()
    met = rows.mapInArrow(lambda b: prints_of(b, short, 1, True), "length int, h long, key long").distinct().join(prints, ["length", "h"])
    near = written(met.groupBy("key").agg(F.collect_list(F.struct("length", "h")).alias("prints")), "prints")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words, first = hashed_words(*text_buffer(b.column(1)))
            grams = H.window_hashes(words, gram)
            for d, found in enumerate(b.column(3).to_pylist()):
                own = first[d : d + 2]
                for length in {p["length"] for p in found}:
                    keys = np.unique(np.array([p["h"] for p in found if p["length"] == length], np.int64).view(np.uint64))
                    start, _ = H.inside(own - own[0], length)
                    start = start + own[0]
                    if length == window:
                        at = winnow(grams, start, window - gram + 1)
                        at = at[sorted_in(grams[at], keys)]
                        places = (at[:, None] - np.arange(window - gram + 1)).ravel()
                        start = np.intersect1d(places, start)
                    h = H.window_hashes(words, length)[start]
                    if length < window:
                        start, h = start[sorted_in(h, keys)], h[sorted_in(h, keys)]
                    n = len(start)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b.column(2)[d].as_py(), np.int64)), pa.array(start - own[0]), pa.array(np.full(n, length, np.int32)), pa.array(h.view(np.int64))], names=["key", "start", "length", "h"])

    distinct = rows.dropDuplicates(["key"])
    some = distinct.join(near, "key").select("id", "text", "key", "prints").mapInArrow(around, "key long, start long, length int, h long")
    return written(some.join(owners.select("length", "h").distinct(), ["length", "h"], "left_semi"), "hits"), owners


def counted(rows: DataFrame) -> DataFrame:
    """id, key and n_words of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            _, first = hashed_words(*text_buffer(b.column(1)))
            yield pa.RecordBatch.from_arrays([long_array(ids_of(b.column(0))), b.column(2), pa.array(np.diff(first))], names=["id", "key", "n_words"])

    return rows.mapInArrow(run, "id long, key long, n_words long")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", window: int = 10, gram: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, all columns, without any run of words that `decontaminate` would report.

    Repeated rows stay or go together; null and empty texts stay. A benchmark beyond block_bytes is joined, not sent.
    """
    items = benchmark.select(F.lit("").alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    total = int(items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0)
    if total > block_bytes:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        rows = small_batches(docs).select(F.lit(None).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
        hits, _ = joined_hits(rows, items, window, gram)
        marked = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row__"), F.xxhash64(text).alias("__key__"))
        return marked.join(hits.select(F.col("key").alias("__key__")).distinct(), "__key__", "left_anti").select("__row__.*")
    index = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex([("", r["text"]) for r in items.collect()], window, gram))  # at most block_bytes

    def rule() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        def keep(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
            hit = np.ones(len(off) - 1, bool)
            hit[index.value.find(buf, off)[2]] = False
            return hit

        return keep

    return rows_where(docs, text_col, rule)


def in_block(rows: DataFrame, items: list[tuple[str, str]], window: int, gram: int) -> DataFrame:
    index = rows.sparkSession.sparkContext.broadcast(BenchmarkIndex(items, window, gram))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            first, mask, doc, item = index.value.find(*text_buffer(b.column(1)))
            spans: list[list] = [[] for _ in range(b.num_rows)]
            names: list[list] = [[] for _ in range(b.num_rows)]
            for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                names[d].append(index.value.names[i])
            for d in np.unique(doc).tolist():
                own = mask[first[d] : first[d + 1]]
                turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                spans[d] = [{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2], strict=True)]
            yield pa.RecordBatch.from_arrays([long_array(ids_of(b.column(0))), b.column(2), pa.array(np.diff(first)), pa.array(spans, span), pa.array([sorted(n) for n in names], pa.list_(pa.string()))], names=["id", "key", "n_words", "spans", "items"])

    return rows.mapInArrow(run, f"id long, key long, n_words long, spans {SPAN}, items array<string>")
