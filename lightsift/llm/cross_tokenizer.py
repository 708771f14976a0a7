"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Each text is encoded by a byte-level BPE (A) and a SentencePiece model (B). A token of A and one of B are linked where
their byte ranges overlap. Documents are numbered inside of blocks; for each block and shard of pairs one posting row holds,
per pair (a, b), compressed bitmaps of the block's documents: plane k has the documents in which bit k of the number
of links is set. The OR of the planes counts documents, the weighted popcounts count links. Counts are added up over
blocks, and the postings carry the scores of their pairs back to the documents. A sparse bitmap is a list
of document numbers, a dense one bits; no task holds more than some blocks of one shard, or one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of, long_array, scratch_path, slices, text_buffer, text_rows, written
from .token_store import SHOWN, Encoder, Known, gathered

#: Shards of pairs (by the id of B), documents and text bytes of a block, blocks of a shard that meet its scores in a task.
SHARDS, BLOCK_DOCS, BLOCK_BYTES, MEET = 16, 4096, 4 << 20, 128
MARK = "▁"


class PlainBytes(Encoder):
    """The byte-level encoder, for which special tokens in a text are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []

    def spellings(self) -> list[bytes]:
        back = {chr(c): b for b, c in SHOWN.items()}
        pieces = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        return [bytes(back[c] for c in p) if all(c in back for c in p) else b"" for p in pieces]


class Pieces(Encoder):
    """Ids by a SentencePiece model of texts that start with the space which the model adds.

    Where no piece of the vocabulary has a space behind another character, a text is cut at each space that follows one:
    no merge crosses that, so the ids of a text are those of its parts. Parts are remembered as the other encoder's pieces are.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known, self.turn = Known(), 0
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        probe = "  a  b é é ﬁ\n c  "
        self.by_piece = not any(MARK in p.lstrip(MARK) for p in self.pieces) and self.spelled(self.model.encode(probe)) == (" " + probe).encode()

    def spelled(self, ids: list[int]) -> bytes:
        table = self.spellings()
        return b"".join(table[i] for i in ids)

    def starts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(buf) + 1, bool)
        space = buf == 32
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[off] = True
        cut[-1] = False
        return np.flatnonzero(cut)

    def asked(self, piece: str) -> list[int]:
        if piece.strip(" "):
            return self.model.encode(piece[1:])
        return self.model.encode("a" + piece)[len(self.model.encode("a")) :]  # spaces at the end of a text

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(i, "<u4") for i in self.model.encode([t[1:] for t in texts], num_threads=1)]

    def spellings(self) -> list[bytes]:
        """Bytes of each piece; control and unknown pieces have none."""
        m = self.model
        return [bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]


class Table:
    """Byte strings by number, back to back."""

    def __init__(self, cells: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(cells), np.uint8)
        self.size = np.array([len(c) for c in cells], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.flat, self.start[ids], self.size[ids])


@lru_cache(2)
def coder(kind: type, path: str) -> tuple[Encoder, Table]:
    """One per worker process."""
    made = kind(path)
    return made, Table(made.spellings())


@lru_cache(1)
def decimals(n: int) -> Table:
    return Table([b"%d," % i for i in range(n)])


def encoded(by: Encoder, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts back to back and the offsets of the texts in them."""
    if by.by_piece:
        return by.in_pieces(buf, off)
    ids = by.whole([bytes(buf[s:e]).decode() for s, e in zip(off[:-1], off[1:], strict=True)])
    return np.concatenate(ids) if ids else np.zeros(0, "<u4"), np.cumsum([0, *map(len, ids)])


def spells(ids: np.ndarray, at: np.ndarray, table: Table, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text whether its tokens' bytes in a row are the text."""
    size = table.size[ids]
    upto = np.concatenate([[0], np.cumsum(size)])[at]
    ok = (np.diff(upto) == np.diff(off)) & (np.diff(np.concatenate([[0], np.cumsum(size == 0)])[at]) == 0)
    which = np.flatnonzero(ok)
    if len(which):
        take = ids if ok.all() else ids[np.repeat(ok, np.diff(at))]
        told = buf if ok.all() else gathered(buf, off[which], np.diff(off)[which])
        wrong = table.spelled(take) != told
        if wrong.any():
            ok[which[np.unique(np.searchsorted(np.cumsum(np.diff(off)[which]), np.flatnonzero(wrong), "right"))]] = False
    return ok


def aligned(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> dict:
    """Links and groups of texts whose tokens spell the same bytes: per text counts and the group line, per link its text and pair."""
    ends_a, ends_b = np.cumsum(a_size), np.cumsum(b_size)
    ends = np.union1d(ends_a, ends_b)
    ia, ib = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    common = ends[(ends_a[ia] == ends) & (ends_b[ib] == ends)]
    doc_ends = ends_a[a_at[1:] - 1]
    ga, gb = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    line = np.empty(len(a) + len(b), np.int64)
    marks = np.full(len(line), ord(","), np.uint8)
    pos_a = np.arange(len(a)) + np.searchsorted(gb, ga)
    pos_b = np.arange(len(b)) + np.searchsorted(ga, gb, "right")
    line[pos_a], line[pos_b] = a, b
    marks[pos_a[np.append(ga[1:] != ga[:-1], True)]] = ord("|")
    marks[pos_b[np.append(gb[1:] != gb[:-1], True)]] = ord(";")
    told = decimals(1 + int(line.max()) // 65536 * 65536 + 65535)
    text = told.spelled(line)
    stops = np.cumsum(told.size[line])
    text[stops - 1] = marks
    cuts = np.concatenate([[0], stops[(a_at + b_at)[1:] - 1]])
    raw = text.tobytes()
    return {
        "doc": np.searchsorted(doc_ends, ends),
        "code": a[ia].astype(np.int64) << 32 | b[ib].astype(np.int64),
        "groups": np.diff(np.searchsorted(common, np.concatenate([[0], doc_ends]), "right")),
        "sha": [hashlib.sha256(raw[s : e - 1]).hexdigest() for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)],
    }


def bitmaps(at: np.ndarray, doc: np.ndarray, n_pairs: int, n_docs: int) -> bytes:
    """One plane: the bitmap over n_docs documents of each pair; (at, doc) ascend. Bits for pairs in over a sixteenth of them, else lists."""
    counts = np.bincount(at, minlength=n_pairs)
    dense = counts > n_docs // 16
    in_bits = dense[at]
    bits = np.zeros((int(dense.sum()), -(-n_docs // 8)), np.uint8)
    row = np.cumsum(dense) - 1
    np.bitwise_or.at(bits, (row[at[in_bits]], doc[in_bits] >> 3), (1 << (doc[in_bits] & 7)).astype(np.uint8))
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u2").tobytes() + doc[~in_bits].astype("<u2").tobytes() + bits.tobytes())


def opened(raw: bytes, n_pairs: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The (at, doc) of a plane, not in order."""
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    counts = body[: 2 * n_pairs].view("<u2").astype(np.int64)
    dense = counts > n_docs // 16
    n_sparse = int(counts[~dense].sum())
    doc = body[2 * n_pairs : 2 * (n_pairs + n_sparse)].view("<u2").astype(np.int64)
    rows, places = np.nonzero(np.unpackbits(body[2 * (n_pairs + n_sparse) :].reshape(int(dense.sum()), -1), axis=1, bitorder="little")) if dense.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return np.concatenate([np.repeat(np.flatnonzero(~dense), counts[~dense]), np.flatnonzero(dense)[rows]]), np.concatenate([doc, places])


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(x, prepend=0).astype("<i8").tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i8"))


POSTING = "block long, shard int, n_docs int, codes binary, planes array<binary>"
DOC = "id long, place int, n_a long, n_b long, n_groups long, n_links long, sha string"
ROW = f"kind int, {POSTING}, {DOC}"
NAMES = [x.split()[0] for x in ROW.split(", ")]
KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def posting_rows(block: int, doc: np.ndarray, code: np.ndarray, times: np.ndarray, n_docs: int) -> Iterator[tuple]:
    """Posting rows of a block from its distinct (document, pair) and their numbers of links."""
    shard = (code & 0xFFFFFFFF) % SHARDS
    order = np.lexsort((doc, code, shard))
    doc, code, times, shard = doc[order], code[order], times[order], shard[order]
    edges = np.searchsorted(shard, np.arange(SHARDS + 1))
    for s, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if hi > lo:
            d, t = doc[lo:hi], times[lo:hi]
            pairs, at = np.unique(code[lo:hi], return_inverse=True)
            planes = [bitmaps(at[m], d[m], len(pairs), n_docs) for k in range(int(t.max()).bit_length()) for m in [(t >> k & 1).astype(bool)]]
            yield 1, block, s, n_docs, packed(pairs), planes, *[None] * 7


def postings(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Posting rows by block and shard, and one row per document with its counts; both from one written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (enc_a, table_a), (enc_b, table_b) = coder(PlainBytes, byte_level), coder(Pieces, pieces)
        block, held, n_docs, n_bytes = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield rows(list(posting_rows(block, *(np.concatenate([h[i] for h in held]) for i in range(3)), n_docs)))

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(KINDS)], names=NAMES)

        for whole in slices(batches):
            for at in range(0, whole.num_rows, BLOCK_DOCS):
                b = whole.slice(at, BLOCK_DOCS)
                if n_docs + b.num_rows > BLOCK_DOCS or n_bytes > BLOCK_BYTES:
                    yield from flush()
                    block, n_docs, n_bytes = block + 1, 0, 0
                    held.clear()
                some = pc.not_equal(b.column(1), "").to_numpy(zero_copy_only=False)
                buf, off = text_buffer(pc.binary_join_element_wise(pa.scalar(" "), b.column(1).filter(pa.array(some)), ""))
                a, a_at = encoded(enc_a, buf, off)
                c, c_at = encoded(enc_b, buf, off)
                ok = spells(a, a_at, table_a, buf, off) & spells(c, c_at, table_b, buf, off)
                counts = np.zeros((4, b.num_rows), np.int64)
                sha = [""] * b.num_rows
                own = np.flatnonzero(some)[ok]
                if len(own):
                    if not ok.all():
                        a, a_at = a[np.repeat(ok, np.diff(a_at))], np.concatenate([[0], np.cumsum(np.diff(a_at)[ok])])
                        c, c_at = c[np.repeat(ok, np.diff(c_at))], np.concatenate([[0], np.cumsum(np.diff(c_at)[ok])])
                    got = aligned(a, a_at, table_a.size[a], c, c_at, table_b.size[c])
                    counts[:, own] = np.diff(a_at), np.diff(c_at), got["groups"], np.bincount(got["doc"], minlength=len(own))
                    for i, s in zip(own.tolist(), got["sha"], strict=True):
                        sha[i] = s
                    order = np.lexsort((got["code"], got["doc"]))
                    doc, code = got["doc"][order], got["code"][order]
                    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])]))
                    held.append((n_docs + own[doc[first]], code[first], np.diff(first, append=len(doc))))
                none = [None] * b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * b.num_rows, pa.int32()), pa.array([block] * b.num_rows, pa.int64()), *[pa.array(none, t) for t in KINDS[2:6]], long_array(ids_of(b.column(0))), pa.array(np.arange(n_docs, n_docs + b.num_rows), pa.int32()), *[pa.array(x) for x in counts], pa.array(sha, pa.string())],
                    names=NAMES,
                )
                n_docs += b.num_rows
                n_bytes += len(buf)
        yield from flush()

    path = scratch_path(docs.sparkSession, "pairs")
    text_rows(docs, id_col, text_col).mapInArrow(run, ROW).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    stored = lambda kind, schema: docs.sparkSession.read.schema(schema + ", kind int").parquet(path).where(F.col("kind") == kind).drop("kind")
    return stored(1, POSTING), stored(0, "block long, " + DOC)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(code, n_docs, n_links) of every pair; code is the id of A times 2**32 plus the id of B."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def added() -> tuple:
            codes, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            sums = []
            for i in (1, 2):
                out = np.zeros(len(codes), np.int64)
                np.add.at(out, at, np.concatenate([h[i] for h in held]))
                sums.append(out)
            return codes, *sums

        for b in batches:
            for n_docs, codes, planes in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                pairs = unpacked(codes)
                links, seen = np.zeros(len(pairs), np.int64), []
                for k, raw in enumerate(planes):
                    at, doc = opened(raw, len(pairs), n_docs)
                    links += np.bincount(at, minlength=len(pairs)) << k
                    seen.append(at * n_docs + doc)
                some = seen[0] if len(seen) == 1 else np.unique(np.concatenate(seen))
                held.append((pairs, np.bincount(some // n_docs, minlength=len(pairs)), links))
            if sum(len(h[0]) for h in held) > 1_000_000:
                held[:] = [added()]
                if len(held[0][0]) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held.pop()], names=["code", "n_docs", "n_links"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in added()], names=["code", "n_docs", "n_links"])

    some = rows.mapInArrow(counted, "code long, n_docs long, n_links long")
    return some.groupBy("code").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))


def document_scores(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(block, places, best, total) packed: what the postings of a shard return to the documents of a block, from (code, n_links, best)."""
    shard = F.pmod(F.col("code").bitwiseAND(0xFFFFFFFF), F.lit(SHARDS)).cast("int").alias("shard")

    def sorted_(table: pa.Table) -> pa.Table:
        code, links, best = (table.column(i).to_numpy() for i in (1, 2, 3))
        order = np.argsort(code)
        cells = [table.column(0).to_pylist()[:1], [packed(code[order])], [packed(links[order])], [packed(best[order].astype(np.int64))]]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("shard", "codes", "links", "best"), cells, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)})

    shards = pairs.select(shard, "code", "n_links", "best").groupBy("shard").applyInArrow(sorted_, "shard int, codes binary, links binary, best binary")
    n = rows.select("block").distinct().count()
    salts = max(1, -(-n // MEET))
    salted = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            codes, links, best = (unpacked(right.column(n)[0].as_py()) for n in ("codes", "links", "best"))
            for block, n_docs, own, planes in zip(*(left.column(n).to_pylist() for n in ("block", "n_docs", "codes", "planes")), strict=True):
                pairs = unpacked(own)
                score, top = links[(i := np.searchsorted(codes, pairs))], best[i]
                total, n_best = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
                for k, raw in enumerate(planes):
                    at, doc = opened(raw, len(pairs), n_docs)
                    np.add.at(total, doc, score[at] << k)
                    np.add.at(n_best, doc, top[at] << k)
                out.append((block, packed(n_best), packed(total)))
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("block", pa.int64()), ("best", pa.binary()), ("total", pa.binary())))})

    return dealt.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(scored, "block long, best binary, total binary")


def cross_tokenizer(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: how the tokens of two tokenizers overlap in each document.

    A text counts with a space before it. byte_level: file of a byte-level BPE of the tokenizers library; pieces: a SentencePiece
    model that adds that space. Special tokens in a text are plain text. n_groups: parts between byte offsets where both have
    a token's end; n_links: overlapping pairs of tokens; count_sum: sum over them of how many links of all documents have
    the same two ids; n_best: links whose count is the highest that their id of B has with any (ties included).
    groups_sha256: of the groups as decimal ids, `a1,a2|b1;a3|b2,b3`. Null and empty texts, and texts that the tokens of
    either don't spell, have no tokens: zeros and an empty string. Repeated rows and ids are documents each.
    """
    rows, own = postings(docs, byte_level, pieces, id_col, text_col)
    pairs = written(pair_counts(rows), "pair-counts")
    b = F.col("code").bitwiseAND(0xFFFFFFFF)
    most = pairs.groupBy(b.alias("b")).agg(F.max("n_links").alias("most"))
    told = pairs.withColumn("b", b).join(most, "b").select("code", "n_links", (F.col("n_links") == F.col("most")).cast("long").alias("best"))
    back = document_scores(rows, told)

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        sums = {n: np.zeros(left.num_rows, np.int64) for n in ("best", "total")}
        place = left.column("place").to_numpy()
        size = int(place.max()) + 1 if len(place) else 0
        for n in sums:
            whole = np.zeros(size, np.int64)
            for raw in right.column(n).to_pylist():
                x = unpacked(raw)
                whole[: len(x)] += x
            sums[n] = whole[place]
        keep = [left.column(n) for n in ("id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*keep, pa.array(sums["best"]), pa.array(sums["total"]), left.column("sha")], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kinds = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(final, kinds)
