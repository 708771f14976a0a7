"""Repeated-substring dedup over bytes with run-length BWT indexes.

1. Every `length`-byte string picks an anchor, the leftmost least hash of its 64-byte grams. Equal
   strings pick equal anchors, so a string can only repeat where its anchor repeats. Neighbouring
   strings with one anchor form a context of at most 2*length bytes.
2. Anchors meet in hash buckets. Identical contexts are merged with a weight (each copy is a repeat
   of the others); anchors with one context of weight one are dropped.
3. The contexts of each repeated anchor go to one index shard. A shard builds the suffix order of
   its contexts, keeps the Burrows-Wheeler transform as runs with the suffix positions and common
   prefixes sampled at run ends, and streams the texts through those samples to get, for each place,
   the longest match elsewhere (inside a run the value falls by one per byte, so samples suffice).
4. Places that match `length` bytes or more are marked, and marks return to the texts.

The contexts of an anchor with more than `split_contexts` different ones (the edge of a passage that many
documents share) are dealt to several shards: strings that hold the anchor at offsets of one stretch have
a core of almost `length` bytes in common with every equal string, and the hash of that core names their
shard. Equal strings hold the anchor at the same offset, so they still meet, and are compared there by the
same index; what is split has no influence on the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from . import postings as P
from .common import ids_of, long_array, slices, text_buffer, text_rows, total_bytes

GRAM = 64
#: Offsets of an anchor that the parts of a split context have in common.
STRETCH = 20
#: Anchors that a map task compares among themselves before anything is shuffled.
FLUSH_ANCHORS = 1_000_000
#: Bytes that are hashed at a time; positions inside a block fit 24 bits.
BLOCK = 1 << 22
FOUND_NAMES = ["grp", "kind", "n", "ids", "keys", "counts", "places"]
FOUND = "grp int, kind int, n int, ids binary, keys binary, counts binary, places binary"
SHARD_NAMES = ["shard", "kind", "ids", "keys", "counts", "places", "body"]
SHARD = "shard int, kind int, ids binary, keys binary, counts binary, places binary, body binary"
TO_MARK, TO_INDEX = 1, 0


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, bucket_anchors: int = 500_000, shard_bytes: int = 1 << 20, group_bytes: int = 8 << 20, split_contexts: int = 4000) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts anywhere else (all copies go).

    Texts are UTF-8 bytes, null counts as empty, and matches never cross documents; strings are judged
    on the input. Returns id, n_bytes, kept (remaining bytes, binary) and spans (maximal removed byte
    runs [start, end)). Rows that repeat id and text are each other's copies, so both lose what they share.
    Identical contexts are recognised by 128 bits of hash; the others are compared by their bytes.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    # rows that repeat id and text would share a key: number them by a count that is merged below
    rows = text_rows(docs, id_col, text_col)
    size = total_bytes(rows)
    buckets = max(1, size // (64 * bucket_anchors))
    shards, groups = max(1, size // shard_bytes), max(1, size // group_bytes)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            base = np.cumsum([0, *[len(x[5]) for x in held]])
            a, c, lo, count = (np.concatenate([x[i] for x in held]) for i in range(4))
            doc = np.concatenate([x[4] + b for x, b in zip(held, base, strict=False)])
            ids, keys = (np.concatenate([x[i] for x in held]) for i in (5, 6))
            _, first, which, weight = np.unique(np.rec.fromarrays([a, c]), return_index=True, return_inverse=True, return_counts=True)
            twice = (weight > 1)[which.ravel()]
            out = [((g % buckets), TO_MARK, *rest, b"%d" % g) for g, *rest in P.mark_rows(doc[twice], [lo[twice], count[twice]], ids, keys, groups)]
            first = np.sort(first)
            bucket = ((a[first] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            out += [(b, TO_INDEX, *rest) for b, *rest in P.packed(bucket, doc[first], [lo[first], count[first], twice[first].astype(np.int64)], ids, keys, [a[first], c[first]], 8)]
            for i in range(0, len(out), 500):
                yield P.batch(out[i : i + 500], P.POSTING_NAMES)

        for b in slices(batches):
            buf, off = text_buffer(b.column(1))
            ids, keys = ids_of(b.column(0)), b.column(2).to_numpy()
            for a, c, lo, count, doc in contexts_of(buf, off, length):
                held.append((a, c, lo, count, doc, ids, keys))
                n += len(a)
            if n >= FLUSH_ANCHORS:
                yield from flush()
                held.clear()
                n = 0
        if held:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        out = [(int(r["hashes"]), TO_MARK, r["n"], r["ids"], r["keys"], r["counts"], r["places"]) for r in table.filter(pa.array(kind == TO_MARK)).to_pylist()]
        ids, keys, doc, (lo, count, twice), (a, c) = P.read(table.filter(pa.array(kind == TO_INDEX)), 3, 2, 8)
        if len(a):
            order = np.lexsort((c, a))
            a, c, lo, count, twice, doc = (x[order] for x in (a, c, lo, count, twice, doc))
            new_a = np.concatenate([[True], a[1:] != a[:-1]])
            new_c = new_a | np.concatenate([[True], c[1:] != c[:-1]])
            ctx, anchor = np.cumsum(new_c) - 1, np.cumsum(new_a) - 1
            heavy = (np.bincount(ctx, 1 + twice) > 1)[ctx]
            kinds = np.bincount(anchor, new_c)[anchor]  # different contexts of the anchor
            out += [(g, TO_MARK, *rest) for g, *rest in P.mark_rows(doc[heavy], [lo[heavy], count[heavy]], ids, keys, groups)]
            ask = np.flatnonzero(new_c & (kinds > 1))
            shard = np.where(kinds[ask] > split_contexts, -1, ((a[ask] & np.uint64(0xFFFFFFFF)) % np.uint64(shards)).astype(np.int64))
            out += [(g, TO_INDEX, *rest) for g, *rest in P.mark_rows(doc[ask], [lo[ask], count[ask], heavy[ask].astype(np.int64), shard], ids, keys, groups)]
        return pa.Table.from_batches([P.batch(out, FOUND_NAMES)])

    from .common import written

    found = written(rows.mapInArrow(anchored, P.SCHEMA).groupBy("bucket").applyInArrow(meet, FOUND), "anchors")
    grouped = rows.withColumn("grp", F.pmod("key", F.lit(groups)).cast("int"))
    asked = grouped.groupBy("grp").cogroup(found.where(F.col("kind") == TO_INDEX).groupBy("grp")).applyInArrow(lambda t, f: context_rows(t, f, length, shards), SHARD)
    indexed = asked.groupBy("shard").applyInArrow(lambda t: shard_marks(t, length, groups), FOUND)
    marks = found.where(F.col("kind") == TO_MARK).unionByName(indexed)
    kind = "id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"
    return grouped.groupBy("grp").cogroup(marks.groupBy("grp")).applyInArrow(lambda t, f: removed(t, f, length), kind)


def contexts_of(buf: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple]:
    """(anchor hash, context hash, first string's place in its document, number of strings, document) of all contexts."""
    w = length - GRAM + 1
    low = np.uint64((1 << 24) - 1)
    for at in range(0, max(len(buf) - length + 1, 0), BLOCK):
        part = buf[at : at + BLOCK + length - 1]
        p1, p2 = H.byte_prefix(part), H.byte_prefix(part, second=True)
        place = np.arange(len(part) - GRAM + 1)
        gram = H.mix(H.between(p1, place, place + GRAM, H.BASE_BYTES))
        least = sliding_min((gram & ~low) | place.astype(np.uint64), w)
        start, doc = H.inside(np.clip(off - at, 0, len(part)), length)
        # documents that go on beyond this block lose no string: the next block starts at the first one not seen here
        start, doc = start[start < BLOCK], doc[start < BLOCK]
        if not len(start):
            continue
        m = least[start]
        new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.append(new[1:], len(m)) - 1
        lo, hi = start[new], start[last]
        ctx = H.mix(H.between(p2, lo, hi + length, H.BASE_BYTES) + (hi - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        yield gram[(m[new] & low).astype(np.int64)], ctx, lo + at - off[doc[new]], hi - lo + 1, doc[new]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values: block-wise minima from both sides (van Herk)."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    pad = np.full(-(-len(v) // w) * w, np.uint64((1 << 64) - 1))
    pad[: len(v)] = v
    b = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    back = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def lookup(found: pa.Table, n_places: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys and places of all marks, in order of the key."""
    _, keys, doc, places, _ = P.read(found, n_places, 0, 8)
    k = keys[doc]
    order = np.argsort(k, kind="stable")
    return k[order], [p[order] for p in places]


def context_rows(texts: pa.Table, found: pa.Table, length: int, shards: int) -> pa.Table:
    """The bytes of the asked contexts of one document group, packed by shard; contexts of hot anchors in parts."""
    mark_keys, (lo, count, heavy, shard) = lookup(found, 4)
    bodies: list[bytes] = []
    parts: list[tuple] = []
    ids_all, keys_all, base = [], [], 0
    asked: set[int] = set()
    for b in slices(iter(texts.select(["id", "text", "key"]).to_batches())) if len(mark_keys) else ():
        buf, off = text_buffer(b.column(1))
        own = b.column(2).to_numpy()
        ids_all.append(ids_of(b.column(0)))
        keys_all.append(own)
        left, right = np.searchsorted(mark_keys, own, "left"), np.searchsorted(mark_keys, own, "right")
        raw = None
        for d in np.flatnonzero(right > left):
            if int(own[d]) in asked:
                continue
            asked.add(int(own[d]))
            raw = buf.tobytes() if raw is None else raw
            for j in range(left[d], right[d]):
                s = int(off[d] + lo[j])
                body = raw[s : s + int(count[j]) + length - 1]
                for sh, first, n in [(int(shard[j]), 0, int(count[j]))] if shard[j] >= 0 else cores(body, int(count[j]), length, shards):
                    parts.append((sh, base + d, int(lo[j]) + first, n, int(heavy[j]), len(bodies)))
                    bodies.append(body[first : first + n + length - 1])
        base += b.num_rows
    out = []
    if parts:
        ids, keys = np.concatenate(ids_all), np.concatenate(keys_all)
        s, doc, place, n, weight, body = (np.array(x) for x in zip(*parts, strict=True))
        edges = np.argsort(s, kind="stable")
        for bucket, _, i, k, c, pl, _ in P.packed(s, doc, [place, n, weight], ids, keys, [], 8):
            lo_, hi_ = np.searchsorted(s[edges], bucket, "left"), np.searchsorted(s[edges], bucket, "right")
            out.append((bucket, TO_INDEX, i, k, c, pl, b"".join(bodies[x] for x in body[edges[lo_:hi_]])))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(7)], names=SHARD_NAMES)


def cores(body: bytes, count: int, length: int, shards: int) -> list[tuple[int, int, int]]:
    """(shard, first string, strings) of the parts of a context: runs of strings with the anchor at offsets of one stretch."""
    p, place = H.byte_prefix(np.frombuffer(body, np.uint8)), np.arange(len(body) - GRAM + 1)
    gram = H.mix(H.between(p, place, place + GRAM, H.BASE_BYTES)) >> np.uint64(24)
    anchor = int(np.argmin(gram))
    out = []
    for low in range(0, length - GRAM + 1, STRETCH):
        high = min(low + STRETCH - 1, length - GRAM)
        # strings that start at anchor - high ... anchor - low all hold these bytes
        first, last = max(anchor - high, 0), min(anchor - low, count - 1)
        if first <= last:
            core = H.mix(H.between(p, np.array([anchor - low]), np.array([anchor - high + length]), H.BASE_BYTES) + np.uint64(low))
            out.append((int(core[0] % np.uint64(shards)), first, last - first + 1))
    return out


def shard_marks(texts: pa.Table, length: int, groups: int) -> pa.Table:
    """Marks of one shard from its run-length index."""
    out: list[tuple] = []
    ids, keys, doc, (lo, count, _), _ = P.read(texts, 3, 0, 8)
    if len(lo):
        text = np.frombuffer(b"".join(texts.column("body").to_pylist()), np.uint8)
        ends = np.cumsum(count + length - 1)
        starts = ends - (count + length - 1)
        long = RunLengthIndex(text, starts, ends).matches() >= length
        ctx = np.repeat(np.arange(len(lo)), count + length - 1)
        place = np.arange(len(text)) - starts[ctx]
        hit = np.flatnonzero(long & (place < count[ctx]))
        if len(hit):
            new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(ctx[hit]) != 0)]))
            n = np.diff(new, append=len(hit))
            first = hit[new]
            out += P.mark_rows(doc[ctx[first]], [lo[ctx[first]] + place[first], n], ids, keys, groups)
    return pa.Table.from_batches([P.batch([(g, TO_MARK, *rest) for g, *rest in out], FOUND_NAMES)])


class RunLengthIndex:
    """Run-compressed BWT of many short texts with suffix positions and common prefixes sampled at run ends."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.n = n = len(text)
        of = np.repeat(ends, ends - starts)  # end of the text that each place belongs to
        ranks, depth = self._ranks(text, of, int((ends - starts).max()))
        order = np.argsort(ranks[-1], kind="stable")  # equal rests of texts stand in order of their texts
        before = np.full(n, -1, np.int32)
        before[1:] = text[:-1]
        before[starts] = -1 - np.arange(len(starts))  # each text starts after a mark of its own
        bwt = before[order]
        head = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        self.first, self.last = order[head], order[np.append(head[1:], True)]
        heads, tails = np.flatnonzero(head), np.append(np.flatnonzero(head)[1:], n) - 1
        self.above = self._common(ranks, depth, order[heads], order[np.maximum(heads - 1, 0)], of, text) * (heads > 0)
        self.below = self._common(ranks, depth, order[tails], order[np.minimum(tails + 1, n - 1)], of, text) * (tails < n - 1)

    @staticmethod
    def _ranks(text: np.ndarray, of: np.ndarray, longest: int) -> tuple[list[np.ndarray], list[int]]:
        """Ranks of all places by their first 7, 14, 28, ... bytes (fewer where the text ends), until whole texts are ranked."""
        n = len(text)
        key = np.zeros(n, np.int64)
        left = of - np.arange(n)
        for t in range(7):
            key <<= 9
            key[: n - t] |= np.where(left[: n - t] > t, text[t:].astype(np.int64) + 1, 0)
        ranks, depth = [], []
        h = 7
        while True:
            order = np.argsort(key, kind="stable")
            k = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]]))  # from 1; 0 is beyond the end
            ranks.append(rank)
            depth.append(h)
            if h >= longest:
                return ranks, depth
            ahead = np.zeros(n, np.int64)
            ahead[: max(n - h, 0)] = np.where(left[: max(n - h, 0)] > h, rank[h:], 0)
            key = rank * (n + 1) + ahead
            h *= 2

    @staticmethod
    def _common(ranks: list[np.ndarray], depth: list[int], a: np.ndarray, b: np.ndarray, of: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b inside their texts."""
        a, b = a.copy(), b.copy()
        end_a, end_b, out = of[a], of[b], np.zeros(len(a), np.int64)
        for rank, h in zip(reversed(ranks), reversed(depth), strict=True):
            live = (a < end_a) & (b < end_b)
            same = np.flatnonzero(live)
            same = same[rank[a[same]] == rank[b[same]]]
            step = np.minimum(h, end_a[same] - a[same])
            a[same] += step
            b[same] += step
            out[same] += step
        for _ in range(depth[0] - 1):  # what is left is shorter than the shortest ranked piece
            same = np.flatnonzero((a < end_a) & (b < end_b))
            same = same[text[a[same]] == text[b[same]]]
            a[same] += 1
            b[same] += 1
            out[same] += 1
        return out

    def matches(self) -> np.ndarray:
        """Matching statistics in text order: for each place, the longest string from there that also starts elsewhere."""
        best = np.zeros(self.n, np.int64)
        for at, value in ((self.first, self.above), (self.last, self.below)):
            sample = np.zeros(self.n, np.int64)
            sample[at] = np.arange(len(at)) + 1
            order = np.flatnonzero(sample)
            seen = np.searchsorted(order, np.arange(self.n), "right") - 1
            which = sample[order[np.maximum(seen, 0)]] - 1
            best = np.maximum(best, np.where(seen >= 0, value[which] - (np.arange(self.n) - at[which]), 0))
        return best


def removed(texts: pa.Table, found: pa.Table, length: int) -> pa.Table:
    """Texts of one document group without the bytes that the group's marks cover."""
    kinds = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    if not texts.num_rows:
        return kinds.empty_table()
    mark_keys, (at, n) = lookup(found, 2)
    out = []
    for b in slices(iter(texts.select(["id", "text", "key"]).to_batches())):
        own = b.column(2).to_numpy()
        left, right = np.searchsorted(mark_keys, own, "left"), np.searchsorted(mark_keys, own, "right")
        sizes, kept, spans = [], [], []
        for text, i, j in zip(b.column(1).to_pylist(), left, right, strict=True):
            raw = text.encode()
            sizes.append(len(raw))
            if i == j:
                kept.append(raw)
                spans.append([])
                continue
            gone = H.cover(at[i:j], at[i:j] + n[i:j] + length - 1, len(raw))
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2], strict=True)])
        out.append(pa.RecordBatch.from_arrays([long_array(ids_of(b.column(0))), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kinds.field("spans").type)], schema=kinds))
    return pa.Table.from_batches(out, kinds)
