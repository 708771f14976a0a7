"""N-gram Jaccard join by a token-group matrix.

Texts become sets of shingle hashes; equal sets are one class. How many classes have a token is counted over the whole
corpus (by as many leading bits as tell its tokens apart). A token that no other class has is a set's own: a set with more own
tokens than it may miss links to nothing and is settled at once, and two sets can't link if their own tokens alone are more than
they may differ by. The others are put in order (similar sets have the same least hash) and cut into groups; a group keeps
the union of its members' tokens and who has which. Sets of a group and of the one before meet directly. Beyond that a set
asks the groups that its rarest tokens name: the overlap with a group's union bounds that with each member, and only a
group that the bound can't rule out is opened. Sets with frequent keys bring a sketch, the parities of their tokens in slots:
two sets differ by at least as many tokens as sketches have differing bits, so of a crowd only pairs near the threshold ask.
First each part of a crowd asks a few groups; after that only sets that aren't known to be connected ask for each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from . import postings as P
from .common import ids_of, long_array, scratch_path, slices, text_buffer, text_rows, total_bytes, written
from .components import components
from .simhash_dedup import spanning

#: Sets and tokens of a group; texts of a document group in bytes; keys that a task sorts at a time; what one group is asked in a task; similar sets put in order in one place.
MEMBERS, TOKENS, GROUP_BYTES, FLUSH, ASKED, CROWD = 32, 1 << 18, 8 << 20, 500_000, 4096, 256
#: Parts of the keys, each used in a turn of few questions before all are asked; and turns.
TURNS, FIRST = 4, 2
#: Entries of a key beyond which its sets bring a sketch; those that the others are compared with in a turn; 64-bit words of a sketch at most.
LONG, CENTRES, WORDS = 32, 64, 64


def token_sets(buf: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts back to back, and the offsets of the texts in them."""
    low = H.LOWER[buf]
    starts, ends, first = H.word_spans(low, off, H.NON_SPACE)
    words = H.word_hashes(low, starts, ends)
    at, doc = H.inside(first, shingle)
    h = H.window_hashes(words, shingle)[at] if len(at) else np.zeros(0, np.uint64)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < shingle))
    if len(short):
        own = H.mix(H.between(H.prefix(words, H.BASE_WORDS), first[short], first[short] + n[short], H.BASE_WORDS))
        h, doc = np.concatenate([h, own]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def classes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number per set; 0 for the empty set."""
    upto = np.concatenate([[np.uint64(0)], np.cumsum(H.mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    n = np.diff(at)
    out = H.mix(upto[at[1:]] - upto[at[:-1]] + n.astype(np.uint64))
    out[n == 0] = 0
    return out.view(np.int64)


def required(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n shares with any that it links to, at least."""
    return -(-percent * n // 100)


def may_differ(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that only one of two linked sets of n and m has, at most."""
    return (n + m) * (100 - percent) // (100 + percent)


def may_link(n: np.ndarray, m: np.ndarray, own_n: np.ndarray, own_m: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets of n and m tokens can link, of which they have own_n and own_m alone at least."""
    both = -(-percent * (n + m) // (100 + percent))
    return (own_n <= n - both) & (own_m <= m - both)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of how many tokens fall into each slot; slots are a power of two, up to four times the tokens."""
    words = min(WORDS, max(1, (1 << (2 * len(tokens) - 1).bit_length()) // 64))
    h = H.mix(tokens ^ np.uint64(0x9E6C63D0876A9A47))
    slot = (h % np.uint64(words) << np.uint64(6)) | (h >> np.uint64(58))  # so the XOR of both halves is the sketch of half the words
    return np.packbits((np.bincount(slot.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)).view(np.uint64)


class Sketches:
    """Sketches of several sizes (0 words: none), compared in the size of the smaller one."""

    def __init__(self, words: np.ndarray, raw: bytes):
        self.words, self.rows, self.at = words, {}, {}
        flat, starts = np.frombuffer(raw, np.uint64), np.cumsum(words) - words
        size, above = int(words.max(initial=0)), np.zeros(0, np.int64)
        while size:
            own = np.flatnonzero(words == size)
            folded = self.rows[2 * size][:, :size] ^ self.rows[2 * size][:, size:] if len(above) else np.zeros((0, size), np.uint64)
            self.rows[size] = np.concatenate([folded, flat[starts[own][:, None] + np.arange(size)]])
            above = np.concatenate([above, own])
            self.at[size] = np.zeros(len(words), np.int64)
            self.at[size][above] = np.arange(len(above))
            size //= 2

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Tokens that only one of the sets i and j has, at least."""
        size, out = np.minimum(self.words[i], self.words[j]), np.zeros(len(i), np.int64)
        for k in np.unique(size[size > 0]).tolist():
            pairs = np.flatnonzero(size == k)
            for s in range(0, len(pairs), (1 << 20) // k):
                w = pairs[s : s + (1 << 20) // k]
                out[w] = np.bitwise_count(self.rows[k][self.at[k][i[w]]] ^ self.rows[k][self.at[k][j[w]]]).sum(axis=1, dtype=np.int64)
        return out


def can_link(n: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set of n can link to another set at all: the nearest ones have one token more or one less."""
    return (n > 0) & ((100 * n >= percent * (n + 1)) | (100 * (n - 1) >= percent * n))


def linked(shared: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n + m - shared)


def members(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, n, class) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, at = token_sets(*text_buffer(b.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([long_array(ids_of(b.column(0))), pa.array(np.diff(at)), pa.array(classes(h, at))], names=["id", "n", "class"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "id long, n long, class long")


def class_texts(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, groups: int) -> DataFrame:
    """(grp, rows): the texts of the classes that can link, one text for each class, packed by group of classes."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> Iterator[pa.RecordBatch]:
            sent: set[int] = set()
            for b in slices(batches):
                h, at = token_sets(*text_buffer(b.column(1)), shingle)
                n, of = np.diff(at), classes(h, at)
                keep = can_link(n, percent)
                if len(sent) > 1_000_000:
                    sent.clear()
                for i in np.flatnonzero(keep).tolist():
                    c = int(of[i])
                    keep[i] = c not in sent
                    sent.add(c)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(n), b.column(1), pa.array(of)], names=["id", "text", "key"]).filter(pa.array(keep))

        yield from P.text_groups(together(fresh()), groups)

    def once(table: pa.Table) -> pa.Table:
        seen, kept = np.zeros(0, np.int64), []
        for b in P.texts_of(table):
            key = b.column(2).to_numpy()
            new = ~np.isin(key, seen)
            new[new] = np.isin(np.flatnonzero(new), np.flatnonzero(new)[np.unique(key[new], return_index=True)[1]])
            kept.append(b.filter(pa.array(new)))
            seen = np.concatenate([seen, key[new]])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for b in kept:
                w.write_batch(b)
        return pa.table({"grp": pa.array(table.column("grp").to_pylist()[:1], pa.int32()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return text_rows(docs, id_col, text_col).mapInArrow(dealt, P.TEXTS).groupBy("grp").applyInArrow(once, P.TEXTS)


def together(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined to about `most` bytes: cells of text compress better."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held.clear()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def sets_of(rows: bytes, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Classes, tokens and offsets of a group's texts, in slices."""
    for b in slices(pa.ipc.open_stream(rows)):
        yield b.column(2).to_numpy(), *token_sets(*text_buffer(b.column(1)), shingle)


CELL = "bucket int, grp int, tokens binary, counts binary"


def shared_tokens(texts: DataFrame, shingle: int, shift: int, buckets: int) -> DataFrame:
    """(grp, tokens, counts): of each group's tokens (their leading bits) those that several classes have, and how many do."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grp, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [h >> np.uint64(shift) for _, h, _ in sets_of(rows, shingle)]
                tokens, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
                bucket = (tokens % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                cells = [(i, order[lo:hi]) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]
                yield cell_batch([(i, grp, P.pack(tokens[w].view(np.int64)), P.pack(counts[w])) for i, w in cells])

    def counted(table: pa.Table) -> pa.Table:
        got = [(g, P.unpack(t), P.unpack(c)) for g, t, c in zip(*(table.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        tokens, at = np.unique(np.concatenate([t for _, t, _ in got]), return_inverse=True)
        df = np.bincount(at, np.concatenate([c for _, _, c in got])).astype(np.int64)
        out, base = [], 0
        for g, t, _ in got:
            own = df[at[base : base + len(t)]]
            base += len(t)
            if (own > 1).any():
                out.append((0, g, P.pack(t[own > 1]), P.pack(own[own > 1])))
        return pa.Table.from_batches([cell_batch(out)]).drop_columns(["bucket"])

    return texts.mapInArrow(posted, CELL).groupBy("bucket").applyInArrow(counted, "grp int, tokens binary, counts binary")


def cell_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["bucket", "grp", "tokens", "counts"])


OPEN = "class long, first long, own long, spread int, tokens binary, keys binary, sketch binary"


def open_sets(texts: DataFrame, shared: DataFrame, shingle: int, shift: int, percent: int) -> DataFrame:
    """The classes with no more own tokens than they may miss, with all tokens and the keys to ask by: the rarest of the shared
    tokens, as many as may lack in a set that links and one more. spread: how many places a crowd of such sets is dealt to.
    sketch: empty without a key that more than LONG classes have."""

    def decided(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        cells = [(P.unpack(t).view(np.uint64), P.unpack(c)) for t, c in zip(right.column(1).to_pylist(), right.column(2).to_pylist(), strict=True)]
        known = np.concatenate([t for t, _ in cells]) if cells else np.zeros(0, np.uint64)
        order = np.argsort(known)
        known, df = known[order], np.concatenate([c for _, c in cells])[order] if cells else np.zeros(0, np.int64)
        for rows in left.column(1).to_pylist() if len(known) else ():
            for of, h, at in sets_of(rows, shingle):
                size = np.diff(at)
                doc, token = np.repeat(np.arange(len(of)), size), h >> np.uint64(shift)
                i = np.minimum(np.searchsorted(known, token), len(known) - 1)
                many = np.where(known[i] == token, df[i], 1)
                own = np.bincount(doc, many == 1, minlength=len(of)).astype(np.int64)
                spare = size - required(size, percent)
                order = np.lexsort((token, many, doc))
                turn = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
                key = (turn <= spare[doc[order]]) & (many[order] > 1) & (own <= spare)[doc[order]]
                keys, key_doc, key_many = token[order][key], doc[order][key], many[order][key]
                edges = np.searchsorted(key_doc, np.arange(len(of) + 1))
                for d in np.flatnonzero(np.diff(edges)).tolist():
                    tokens = h[at[d] : at[d + 1]].view(np.int64)
                    mine = slice(edges[d], edges[d + 1])
                    most = int(key_many[mine].max())
                    told = sketch(tokens.view(np.uint64)).tobytes() if most > LONG else b""
                    out.append((int(of[d]), int(tokens[0]), int(own[d]), -(-most // CROWD), P.pack(tokens), P.pack(np.sort(keys[mine]).view(np.int64)), told))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(("class", "first", "own", "spread", "tokens", "keys", "sketch"), kinds, strict=True))})

    return texts.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(decided, OPEN)


GROUP, KEYED, LINK = "gid long, classes binary, sizes binary, tokens binary, places binary", "class long, of long, label long, n long, own long, keys binary, sketch binary", "a long, b long"
FORMED = f"kind int, {GROUP}, {KEYED}, {LINK}"
FORMED_NAMES = [x.split()[0] for x in FORMED.split(", ")]
FORMED_KINDS = [pa.int32(), pa.int64(), *[pa.binary()] * 4, *[pa.int64()] * 5, pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def packed_places(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").tobytes())


def formed_groups(sets: DataFrame, percent: int, n_members: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of similar sets (the token-group matrix: tokens of the union, and for each member its places in it), the members
    with their keys and a label (sets with one label are connected), and links found while forming the groups."""

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid = TaskContext.get().partitionId() << 32
        before: list[tuple[int, int, np.ndarray]] = []  # label, class and tokens of the last group's members
        held: list[tuple[int, np.ndarray, bytes, int, bytes]] = []

        def close() -> pa.RecordBatch:
            nonlocal gid, before
            own = [(0, c, t) for c, t, *_ in held]
            every = before + own
            label = [x[0] for x in before] + [c for _, c, _ in own]
            sizes = np.array([len(t) for *_, t in every])
            tokens, at = np.unique(np.concatenate([t for *_, t in every]), return_inverse=True)
            has = np.zeros((len(every), len(tokens)), bool)
            has[np.repeat(np.arange(len(every)), sizes), at] = True
            bits = np.packbits(has, axis=1)
            links = []
            for i in range(len(before), len(every)):
                ok = linked(np.bitwise_count(bits[:i] & bits[i]).sum(axis=1, dtype=np.int64), sizes[:i], sizes[i], percent)
                for j in np.flatnonzero(ok).tolist():
                    if label[j] != label[i]:
                        links.append((every[j][1], every[i][1]))
                        old, new = label[i], label[j]
                        label = [new if x == old else x for x in label]
            union = np.unique(np.concatenate([t for *_, t in own]))
            places = [np.searchsorted(union, t) for *_, t in own]
            labels = label[len(before) :]
            group = (0, gid, P.pack(np.array([c for _, c, _ in own])), P.pack(sizes[len(before) :]), P.pack(union.view(np.int64)), packed_places(np.concatenate(places)), *[None] * 9)
            out = [group, *[(1, *[None] * 5, c, gid, x, len(t), mine, k, told, None, None) for (c, t, k, mine, told), x in zip(held, labels, strict=True)], *[(2, *[None] * 12, a, b) for a, b in links]]
            before = [(x, c, t) for x, (_, c, t) in zip(labels, own, strict=True)]
            gid += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(FORMED_KINDS)], names=FORMED_NAMES)

        n = 0
        for b in batches:
            for c, mine, t, k, told in zip(*(b.column(i).to_pylist() for i in (0, 2, 4, 5, 6)), strict=True):
                tokens = P.unpack(t).view(np.uint64)
                if held and (len(held) == n_members or n + len(tokens) > TOKENS):
                    yield close()
                    n = 0
                held.append((c, tokens, k, mine, told))
                n += len(tokens)
        if held:
            yield close()

    path = scratch_path(sets.sparkSession, "token-groups")
    near = sets.repartition("first", F.pmod(F.xxhash64("class"), F.col("spread"))).sortWithinPartitions("first", "own", "class")
    near.mapInArrow(form, FORMED).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    stored = lambda kind, schema: sets.sparkSession.read.schema(schema + ", kind int").parquet(path).where(F.col("kind") == kind).drop("kind")
    return stored(0, GROUP), stored(1, KEYED), stored(2, LINK)


def questions(keyed: DataFrame, buckets: int, percent: int, turn: int | None = None) -> DataFrame:
    """(gid, q, g), distinct: member q of group gid has a key in common with a member of group g that isn't known to be connected
    with, and neither their own tokens nor their sketches rule a link out; all such, each pair of groups one way. With a turn only
    a few of them, on a quarter of the keys: a crowd asks in proportion to its size."""
    told = ("classes", "gids", "labels", "ns", "owns")
    names = ["bucket", "tokens", "sets", *told, "words", "sketches"]
    cell = "bucket int, " + ", ".join(f"{x} binary" for x in names[1:])

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[int], bytes]] = []

        def flush() -> pa.RecordBatch:
            keys, which = np.concatenate([k for k, *_ in held]), np.repeat(np.arange(len(held)), [len(k) for k, *_ in held])
            facts, words = np.array([x for _, x, _ in held], np.int64), np.array([len(x) // 8 for *_, x in held])
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((keys, bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for i, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if hi > lo:
                    w = order[lo:hi]
                    sets, at = np.unique(which[w], return_inverse=True)
                    out.append((i, P.pack(keys[w].view(np.int64)), packed_places(at), *[P.pack(x) for x in facts[sets].T], P.pack(words[sets]), b"".join([held[x][2] for x in sets.tolist()])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int32() if not i else pa.binary()) for i in range(len(names))], names=names)

        n = 0
        for b in batches:
            for *facts, raw, bits in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                keys = P.unpack(raw).view(np.uint64)
                keys = keys if turn is None else keys[H.mix(keys) % np.uint64(TURNS) == turn]
                if len(keys):
                    held.append((keys, facts, bits))
                    n += len(keys)
            if n >= FLUSH:
                yield flush()
                n = 0
        if held:
            yield flush()

    def asked(table: pa.Table) -> pa.Table:
        rows, base, entries = table.to_pylist(), 0, []
        for r in rows:
            at = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["sets"]), "<u4").astype(np.int64)
            entries.append((P.unpack(r["tokens"]).view(np.uint64), at + base))
            base += int(at.max()) + 1
        token, at = (np.concatenate(x) for x in zip(*entries, strict=True))
        of, gid, label, n, own, words = (np.concatenate([P.unpack(r[c]) for r in rows]) for c in (*told, "words"))
        sketches = Sketches(words, b"".join([r["sketches"] for r in rows]))

        def open_pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Which of the pairs of sets ask."""
            left = np.flatnonzero((label[i] != label[j]) & (gid[i] != gid[j]))
            left = left[may_link(n[i[left]], n[j[left]], own[i[left]], own[j[left]], percent)]
            return left[sketches.differ(i[left], j[left]) <= may_differ(n[i[left]], n[j[left]], percent)]

        order = np.lexsort((of[at], own[at], at if turn is None else label[at], token))
        token, at = token[order], at[order]
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        sizes = np.diff(edges)
        found: list[np.ndarray] = []
        total = 0

        def add(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal total
            ask = open_pairs(i, j)
            if len(ask):
                i, j = i[ask], j[ask]
                i, j = np.where(gid[i] < gid[j], i, j), np.where(gid[i] < gid[j], j, i)
                found.append(np.unique(np.stack([gid[i], of[i], gid[j]]), axis=1))
                total += found[-1].shape[1]
                if total > 2_000_000:
                    found[:] = [np.unique(np.concatenate(found, axis=1), axis=1)]
                    total = found[0].shape[1]

        some = np.repeat(sizes <= LONG, sizes)
        for d in range(1, LONG if turn is None else 2):  # short runs: pairs at each distance; in a turn each label's first and the next label's
            i = np.flatnonzero(some[:-d] & (token[d:] == token[:-d]) & some[d:]) if d < len(token) else np.zeros(0, np.int64)
            add(at[i], at[i + d])
        for lo, hi in zip(edges[:-1][sizes > LONG].tolist(), edges[1:][sizes > LONG].tolist(), strict=True):
            run = at[lo:hi]
            labels, of_label = np.unique(label[run], return_inverse=True)
            if len(labels) == 1:
                continue
            if turn is not None:
                add(*nearest(run, run[np.argsort(own[run], kind="stable")[:CENTRES]], open_pairs, sketches))
                continue
            # long runs: every set beside the largest label's against all; two such sets meet once
            rest = of_label != np.argmax(np.bincount(of_label))
            ask, every = run[rest], np.concatenate([run[rest], run[~rest]])
            for s in range(0, len(ask), 512):
                for t in range(s, len(every), 2048):
                    i, j = ask[s : s + 512], every[t : t + 2048]
                    add(np.repeat(i, len(j)), np.tile(j, len(i)))
        asks = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("gid", "q", "g"), asks, strict=True)})

    return keyed.select("class", "of", "label", "n", "own", "keys", "sketch").mapInArrow(posted, cell).groupBy("bucket").applyInArrow(asked, "gid long, q long, g long").distinct()


def nearest(sets: np.ndarray, centres: np.ndarray, open_pairs: Callable[[np.ndarray, np.ndarray], np.ndarray], sketches: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Each set with the centre that differs least by sketches, of those that it can link to and isn't known to be connected with."""
    found = [np.zeros((2, 0), np.int64)]
    for s in range(0, len(sets), 4096):
        i, j = np.repeat(sets[s : s + 4096], len(centres)), np.tile(centres, len(sets[s : s + 4096]))
        ask = open_pairs(i, j)
        i, j = i[ask], j[ask]
        order = np.lexsort((sketches.differ(i, j), i))
        found.append(np.stack([i, j])[:, order[np.flatnonzero(np.diff(i[order], prepend=-1))]])
    i, j = np.concatenate(found, axis=1)
    return i, j


def dealt(rows: DataFrame, groups: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a part: a group of which over ASKED rows ask is copied to several tasks."""
    parts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts"))
    left = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64("q", "g"), F.col("parts")))
    right = groups.withColumnRenamed("gid", key).join(parts, key).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1L)")))
    return left.select(*rows.columns, "part"), right.drop("parts")


def answers(asked: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the asking sets with members of the groups asked, of each task as many as connect what its links connect."""

    def fetched(left: pa.Table, right: pa.Table) -> pa.Table:
        r = {n: right.column(n)[0].as_py() for n in ("classes", "sizes", "tokens", "places")}
        of, at = P.unpack(r["classes"]), np.concatenate([[0], np.cumsum(P.unpack(r["sizes"]))])
        tokens, places = P.unpack(r["tokens"]), np.frombuffer(zstandard.ZstdDecompressor().decompress(r["places"]), "<u4")
        q = left.column("q").to_numpy()
        cells = {c: P.pack(tokens[places[at[i] : at[i + 1]]]) for c in np.unique(q).tolist() for i in [int(np.flatnonzero(of == c)[0])]}
        return pa.table({"g": left.column("g"), "q": left.column("q"), "tokens": pa.array([cells[c] for c in q.tolist()], pa.binary())})

    def opened(left: pa.Table, right: pa.Table) -> pa.Table:
        r = {n: right.column(n)[0].as_py() for n in ("classes", "sizes", "union", "places")}
        of, sizes, union = P.unpack(r["classes"]), P.unpack(r["sizes"]), P.unpack(r["union"]).view(np.uint64)
        places, starts = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["places"]), "<u4"), np.cumsum(sizes) - sizes
        a, b = [], []
        for c, raw in zip(left.column("q").to_pylist(), left.column("tokens").to_pylist(), strict=True):
            own = P.unpack(raw).view(np.uint64)
            i = np.minimum(np.searchsorted(union, own), len(union) - 1)
            hit = union[i] == own
            if int(hit.sum()) < int(required(np.int64(len(own)), percent)):
                continue  # not even the union has enough of it
            row = np.zeros(len(union), np.int64)
            row[i[hit]] = 1
            ok = linked(np.add.reduceat(row[places], starts), sizes, len(own), percent)
            a += [c] * int(ok.sum())
            b += of[ok].tolist()
        x, y = spanning(np.array(a, np.int64), np.array(b, np.int64)) if a else (a, b)
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    left, right = dealt(asked, groups.select("gid", "classes", "sizes", "tokens", "places"), "gid")
    sets = left.groupBy("gid", "part").cogroup(right.groupBy("gid", "part")).applyInArrow(fetched, "g long, q long, tokens binary")
    left, right = dealt(written(sets, "asking"), groups.select("gid", "classes", "sizes", F.col("tokens").alias("union"), "places"), "g")
    return left.groupBy("g", "part").cogroup(right.groupBy("g", "part")).applyInArrow(opened, "a long, b long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, n_members: int = MEMBERS) -> DataFrame:
    """id, n_shingles and component_id of each row: the smallest id that links of at least `percent` % Jaccard similarity reach.

    A text's set: distinct runs of `shingle` words (lower-cased A-Z, without ASCII white space), or all its words where they are
    fewer. Sets are compared by 64-bit hashes of shingles. A text without words (also null) has an empty set, links to nothing
    and is its own component. A null id is larger than any other; a component of null ids only has a null component_id. One
    row per input row; rows that repeat id and text are in one component.
    """
    size = total_bytes(text_rows(docs, id_col, text_col))
    n = max(1, size // GROUP_BYTES)
    rows = written(members(docs, id_col, text_col, shingle), "members")
    texts = written(class_texts(docs, id_col, text_col, shingle, percent, n), "class-texts")
    shift = max(0, 64 - max(40, size.bit_length() + 8))  # leading bits that tell the corpus's tokens apart but for one in a thousand
    sets = open_sets(texts, shared_tokens(texts, shingle, shift, n), shingle, shift, percent)
    groups, keyed, near = formed_groups(sets, percent, n_members)
    links, known = near, keyed
    for turn in [*range(FIRST), None]:
        links = written(links.unionByName(answers(written(questions(known, n, percent, turn), "questions"), groups, percent)), "links")
        root = components(links, "a", "b")
        known = keyed.join(root, F.col("class") == root.node, "left").select("class", "of", F.coalesce("root", "class").alias("label"), "n", "own", "keys", "sketch")
    least = rows.where("n > 0").groupBy("class").agg(F.min("id").alias("least")).join(root, F.col("class") == root.node, "left")
    least = written(least.select("class", "least", F.coalesce("root", "class").alias("root")), "roots")
    first = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = least.join(first, "root").select("class", "component_id")
    linked_rows = rows.where("n > 0").join(of, "class").select("id", F.col("n").alias("n_shingles"), "component_id")
    return linked_rows.unionByName(rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
