"""Substring dedup: word windows that an earlier document already has are removed (Rabin-Karp window hashes)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from . import postings as P
from .common import ids_of, long_array, slices, text_buffer, text_rows, total_bytes

#: Windows that a map task compares among themselves before anything is shuffled.
FLUSH_WINDOWS = 1_000_000
#: Bytes of each window hash that travel. The bucket number comes from a hash with another base, so 64 bits and the
#: logarithm of the number of buckets decide; as a bucket holds about bucket_windows windows, n windows have some
#: n * bucket_windows / 2**65 pairs that agree by chance: 1e-4 at 30 GB, less than one at 100 TB.
HASH_BYTES = 8
BASE_BUCKETS = 0xC6A4A7935BD1E995


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, bucket_windows: int = 1_000_000, group_bytes: int = 8 << 20) -> DataFrame:
    """Remove every word covered by a window of `window` words that also starts in a document with a smaller id.

    Words are runs without ASCII white space. Every window of every document is hashed by a rolling
    polynomial. Each map task first settles repeats among its own documents (a window that a smaller
    id of the same batch has is marked at once), so a passage that a third of the corpus shares sends
    one posting per batch to its hash bucket; the buckets settle the rest. A window that one document repeats
    is one posting there, and its other places follow without a hash. Marks return to the texts
    in groups of documents, where overlapping windows merge into maximal removal intervals.

    Returns id, n_words, kept_text (kept words joined by one space) and spans, the removed word
    intervals [start, end). Null text: no words. Null ids: never smaller than another id; they lose
    what any document with an id has. Rows that repeat an id do not remove from each other; rows that repeat id and text travel
    once per batch with their number, so many of them are neither a hot group nor a hot bucket. Texts of fewer than
    `window` words are kept whole.
    """
    rows = text_rows(docs, id_col, text_col)
    size = total_bytes(rows)
    buckets, groups = max(1, size // (6 * bucket_windows)), max(1, size // group_bytes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            base = np.cumsum([0, *[len(x[3]) for x in held]])
            h, pos, ids, keys, h2 = (np.concatenate([x[i] for x in held]) for i in (0, 2, 3, 4, 5))
            doc = np.concatenate([x[1] + b for x, b in zip(held, base, strict=False)])
            marked = later(h, ids[doc])
            out = [(g % buckets, 1, *rest, b"%d" % g) for g, *rest in P.mark_rows(doc[marked], [pos[marked]], ids, keys, groups)]
            keep = np.flatnonzero(~marked)
            of = first_in_document(h[keep], doc[keep])
            again = of != np.arange(len(keep))
            bucket = (h2[keep] % np.uint64(buckets)).astype(np.int64)
            out += [(b, 2, *rest) for b, *rest in P.packed(bucket[again], doc[keep][again], [pos[keep][again], pos[keep][of[again]]], ids, keys, [], 8)]
            keep, bucket = keep[~again], bucket[~again]
            out += [(b, 0, *rest) for b, *rest in P.packed(bucket, doc[keep], [pos[keep]], ids, keys, [h[keep]], HASH_BYTES)]
            for i in range(0, len(out), 500):
                yield P.batch(out[i : i + 500], P.POSTING_NAMES)

        for b in slices(P.distinct_rows(batches)):
            buf, off = text_buffer(b.column(1))
            starts, ends, first = H.word_spans(buf, off, H.NON_SPACE)
            at, doc = H.inside(first, window)
            if not len(at):
                continue
            words = H.word_hashes(buf, starts, ends)
            held.append((H.window_hashes(words, window)[at], doc, at - first[doc], ids_of(b.column(0)), b.column(2).to_numpy(), H.window_hashes(H.mix(words), window, BASE_BUCKETS)[at]))
            n += len(at)
            if n >= FLUSH_WINDOWS:
                yield from flush()
                held.clear()
                n = 0
        if held:
            yield from flush()

    def settle(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        done = [(int(r["hashes"]), r["n"], r["ids"], r["keys"], r["counts"], r["places"]) for r in table.filter(pa.array(kind == 1)).to_pylist()]
        ids, keys, doc, (pos,), (h,) = P.read(table.filter(pa.array(kind == 0)), 1, 1, HASH_BYTES)
        marked = later(h, ids[doc]) if len(h) else np.zeros(0, bool)
        done += P.mark_rows(doc[marked], [pos[marked]], ids, keys, groups)
        own = place_code(keys[doc[marked]], pos[marked])
        ids, keys, doc, (pos, of), _ = P.read(table.filter(pa.array(kind == 2)), 2, 0, 8)
        marked = np.isin(place_code(keys[doc], of), own)
        done += P.mark_rows(doc[marked], [pos[marked]], ids, keys, groups)
        return pa.Table.from_batches([P.batch(done, P.MARK_NAMES)])

    marks = rows.mapInArrow(hashed, P.SCHEMA).groupBy("bucket").applyInArrow(settle, P.MARKS)
    grouped = rows.mapInArrow(lambda batches: P.text_groups(slices(P.distinct_rows(batches), limit=8 << 20), groups), P.TEXTS)
    kind = "id long, n_words long, kept_text string, spans array<struct<start:long,end:long>>, copies long"
    out = grouped.groupBy("grp").cogroup(marks.groupBy("grp")).applyInArrow(lambda texts, found: removed(texts, found, window), kind)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy", "copies")


def later(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """True where another posting with the same hash has a smaller id."""
    order = np.argsort(h, kind="stable")
    hs, who = h[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
    least = np.repeat(np.minimum.reduceat(who, first), np.diff(first, append=len(hs)))
    out = np.zeros(len(h), bool)
    out[order] = who > least
    return out


def first_in_document(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each posting the first one of its document with the same hash; postings stand in order of document and place."""
    order = np.lexsort((doc, h))
    new = np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(doc[order]) != 0)]) if len(h) else np.zeros(0, bool)
    out = np.empty(len(h), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    return out


def place_code(keys: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """One number for a place in a document."""
    return H.mix(keys.view(np.uint64) ^ H.mix(pos.astype(np.uint64)))


def removed(texts: pa.Table, found: pa.Table, window: int) -> pa.Table:
    """Texts of one document group without the words that the group's marks cover."""
    kinds = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("copies", pa.int64())])
    if not texts.num_rows:
        return kinds.empty_table()
    _, keys, doc, (pos,), _ = P.read(found, 1, 0, 8)
    order = np.argsort(doc_keys := keys[doc], kind="stable")
    doc_keys, pos = doc_keys[order], pos[order]
    out = []
    for b in P.texts_of(texts):
        own = b.column(2).to_numpy()
        lo, hi = np.searchsorted(doc_keys, own, "left"), np.searchsorted(doc_keys, own, "right")
        n_words, kept, spans = [], [], []
        for text, i, j in zip(b.column(1).to_pylist(), lo, hi, strict=True):
            words = text.encode().split()
            n_words.append(len(words))
            if i == j:
                kept.append(b" ".join(words).decode())
                spans.append([])
                continue
            gone = H.cover(pos[i:j], pos[i:j] + window, len(words))
            kept.append(b" ".join(compress(words, ~gone)).decode())
            turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2], strict=True)])
        out.append(pa.RecordBatch.from_arrays([long_array(ids_of(b.column(0))), pa.array(n_words, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kinds.field("spans").type), b.column(3)], schema=kinds))
    return pa.Table.from_batches(out, kinds)
