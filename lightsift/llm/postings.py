"""Packed postings: (document, place, hash) triples travel in one binary row per bucket and map batch.

A row per triple would cost a multiple of its eight bytes of entropy; here ids, keys and places are
delta-coded byte planes under zstd and only the hash bytes stay as they are. Postings are grouped
either by hash bucket (to find equal hashes) or by document group (to bring marks back to texts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: kind 0: postings to be compared in their hash bucket; 1: finished marks that only pass through.
SCHEMA = "bucket int, kind int, n int, ids binary, keys binary, counts binary, places binary, hashes binary"
MARKS = "grp int, n int, ids binary, keys binary, counts binary, places binary"


def pack(a: np.ndarray) -> bytes:
    d = np.diff(a.astype(np.int64), prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel(), dtype=np.int64)


def cut_hashes(h: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def whole_hashes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


def packed(bucket: np.ndarray, doc: np.ndarray, places: list[np.ndarray], ids: np.ndarray, keys: np.ndarray, hashes: list[np.ndarray], width: int) -> Iterator[tuple]:
    """(bucket, n, ids, keys, counts, places, hashes) for each bucket that occurs; doc numbers index ids and keys and must not descend."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 65536 else bucket, kind="stable")
    b = bucket[order]
    edges = np.flatnonzero(np.diff(b, prepend=b[0] - 1))
    for lo, hi in zip(edges, [*edges[1:], len(b)], strict=True):
        part = order[lo:hi]
        d = doc[part]
        first = np.flatnonzero(np.diff(d, prepend=-1))
        yield (int(b[lo]), hi - lo, pack(ids[d[first]]), pack(keys[d[first]]), pack(np.diff(first, append=len(d))), pack(np.concatenate([p[part] for p in places])), b"".join(cut_hashes(h[part], width) for h in hashes))


def read(table: pa.Table, n_places: int, n_hashes: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """All postings of the rows of table: ids and keys of their documents, document numbers, places and hashes."""
    ids, keys, doc, places, hashes, base = [], [], [], [[] for _ in range(n_places)], [[] for _ in range(n_hashes)], 0
    for row in table.to_pylist():
        i, c, p = unpack(row["ids"]), unpack(row["counts"]), unpack(row["places"]).reshape(n_places, -1)
        ids.append(i)
        keys.append(unpack(row["keys"]))
        doc.append(np.repeat(np.arange(base, base + len(i)), c))
        base += len(i)
        for k in range(n_places):
            places[k].append(p[k])
        if n_hashes:
            h = whole_hashes(row["hashes"], width).reshape(n_hashes, -1)
            for k in range(n_hashes):
                hashes[k].append(h[k])
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return cat(ids, np.int64), cat(keys, np.int64), cat(doc, np.int64), [cat(p, np.int64) for p in places], [cat(h, np.uint64) for h in hashes]


def mark_rows(doc: np.ndarray, places: list[np.ndarray], ids: np.ndarray, keys: np.ndarray, groups: int) -> Iterator[tuple]:
    """Marks packed by document group (key modulo groups); doc need not be sorted."""
    order = np.argsort(doc, kind="stable")
    doc, places = doc[order], [p[order] for p in places]
    for g, n, i, k, c, p, _ in packed(group_of(keys, groups)[doc], doc, places, ids, keys, [], 8):
        yield g, n, i, k, c, p


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(keys, groups)


def distinct_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (id, text, key) of each batch once, with the number of their copies in it."""
    for b in batches:
        keys = b.column(2).to_numpy()
        if len(np.unique(keys)) == len(keys):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.ones(b.num_rows, np.int64))], names=["id", "text", "key", "copies"])
            continue
        t = pa.Table.from_arrays(b.columns, names=["id", "text", "key"]).group_by(["id", "text", "key"], use_threads=False).aggregate([([], "count_all")])
        yield from t.rename_columns({"count_all": "copies"}).select(["id", "text", "key", "copies"]).to_batches()


TEXTS = "grp int, rows binary"


def text_groups(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, key and whatever follows) packed by document group, compressed together: less to shuffle than single texts."""
    option = pa.ipc.IpcWriteOptions(compression="zstd")
    for b in batches:
        grp = group_of(b.column(2).to_numpy(), groups)
        order = np.argsort(grp, kind="stable")
        edges = np.flatnonzero(np.diff(grp[order], prepend=-1, append=groups))
        t = b.take(pa.array(order))
        out = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=option) as w:
                w.write_batch(t.slice(lo, hi - lo))
            out.append((int(grp[order[lo]]), sink.getvalue().to_pybytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=["grp", "rows"])


def texts_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for rows in table.column("rows").to_pylist():
        yield from pa.ipc.open_stream(rows)


def batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "grp": pa.int32(), "kind": pa.int32(), "n": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.binary())) for i, n in enumerate(names)], names=names)


POSTING_NAMES = ["bucket", "kind", "n", "ids", "keys", "counts", "places", "hashes"]
MARK_NAMES = ["grp", "n", "ids", "keys", "counts", "places"]
