"""Token-id output as a content-addressed store.

Layout under `path` (Parquet, zstd):
  store/kind=0  unique chunks: sha (SHA-256 of the ids as little-endian unsigned 32-bit integers),
                n (ids), width (2 or 4 bytes per stored id), payload (zstd of the ids)
  store/kind=1  recipes: id, key, n (ids with the end id), shas (chunk digests in order), root (Merkle)
  recipes       the recipes in ascending id order with start, the ids of all documents before
A chunk ends where a rolling hash of the last 16 ids has ten zero bits, so equal passages give equal
chunks wherever they stand; each unique chunk is stored once.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import MERGE, NULL_ID, ids_of, long_array, numbered, slices, text_buffer, text_rows

ROLL, MASK, LEAST, MOST = 16, (1 << 10) - 1, 256, 8192
#: Pieces whose ids a worker keeps (about 50 bytes each), and chunk digests that a task remembers having sent.
PIECES, SENT = 800_000, 100_000
#: Longer pieces are asked for each time they occur.
PIECE_BYTES = 64
#: A word of these letters alone, a space before it or not, is one word to the byte-level pattern.
LETTERS = re.compile("( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)")


def shown() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 characters stand for themselves, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: b if b in plain else 256 + rest.index(b) for b in range(256)}


SHOWN = shown()
SPACE = chr(SHOWN[32])
# Classes of bytes for the cuts: 1 printable ASCII, 2 letter, 4 one of these marks, 8 no white space can start with it.
KIND = np.zeros(256, np.uint8)
KIND[33:127] |= 1
KIND[[*range(65, 91), *range(97, 123)]] |= 2
KIND[[ord(c) for c in ".,;:!?"]] |= 4
KIND[33:127] |= 8
KIND[128:] |= 8
KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = 0
LINE = 10


def piece_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places where a word of the byte-level pattern certainly starts, whatever stands around: the starts of the texts, a
    space that leads a word, a mark or line end after a letter, a line end after a mark, and a word after a single line end."""
    k = KIND[buf]
    cut = np.zeros(len(buf) + 1, bool)
    line = buf == LINE
    letter = (k & 2).astype(bool)
    mark = (k & 4).astype(bool)
    cut[:-2] |= (buf[:-1] == 32) & (k[1:] & 8).astype(bool)
    cut[1:-1] |= letter[:-1] & (mark[1:] | line[1:]) | mark[:-1] & line[1:]
    cut[2:-1] |= (k[:-2] & 1).astype(bool) & line[1:-1] & (k[2:] & 1).astype(bool)
    cut[off] = True
    cut[-1] = False
    return np.flatnonzero(cut)


class Known:
    """Ids of pieces by a hash of their bytes, as sorted arrays; when full, the half that was used last stays."""

    def __init__(self) -> None:
        self.keys, self.checks, self.start, self.size, self.used = (np.zeros(0, t) for t in (np.uint64, np.uint32, np.int64, np.int32, np.int32))
        self.ids = np.zeros(0, "<u4")

    def add(self, at: np.ndarray, keys: np.ndarray, checks: np.ndarray, size: np.ndarray, ids: np.ndarray, turn: int) -> None:
        """at: where the keys belong; both ascend."""
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        for name, new in (("keys", keys), ("checks", checks), ("start", start), ("size", size), ("used", np.full(len(keys), turn, np.int32))):
            setattr(self, name, np.insert(getattr(self, name), at, new))

    def shrink(self, most: int) -> None:
        if len(self.keys) > most:
            stay = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
            self.ids = gathered(self.ids, self.start[stay], self.size[stay])
            self.keys, self.checks, self.size, self.used = self.keys[stay], self.checks[stay], self.size[stay], self.used[stay]
            self.start = np.cumsum(self.size) - self.size


def gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs [start, start + size) of ids back to back."""
    return ids[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


class Encoder:
    """Ids of texts by the tokenizers library; pieces seen before are remembered.

    Texts are cut where the byte-level word pattern certainly starts a word, so the ids of a text are
    those of its pieces in a row. The library's model is asked once per new piece (by its own word
    splitter where a piece is more than Latin letters), which spares the offsets that encode() keeps.
    What allows this is the tokenizer's file alone: a byte-level BPE without normalizer, prefix space
    or dropout. All other tokenizers, and texts that hold an added token, go through encode_batch_fast().
    Pieces of up to PIECE_BYTES bytes are told apart by 96 bits of hash, longer ones are always asked for.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.words = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known, self.turn = Known(), 0
        told = json.loads(self.tokenizer.to_str())
        before, model = told["pre_tokenizer"] or {}, told["model"]
        self.by_piece = told["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and model["type"] == "BPE" and not model.get("dropout")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def asked(self, piece: str) -> list[int]:
        if m := LETTERS.fullmatch(piece):
            word = m[2] if piece.isascii() else m[2].encode().decode("latin-1").translate(SHOWN)
            return [t.id for t in self.model.tokenize(SPACE + word if m[1] else word)]
        return [t.id for word, _ in self.words.pre_tokenize_str(piece) for t in self.model.tokenize(word)]

    def starts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        return piece_starts(buf, off)

    def in_pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, and the offsets of the texts in them."""
        start = self.starts(buf, off)
        end = np.append(start[1:], len(buf))
        sums = np.zeros(len(buf) + 1, np.uint32)
        np.cumsum(CHECKS[buf], out=sums[1:], dtype=np.uint32)
        key = H.mix(H.between(H.byte_prefix(buf), start, end, H.BASE_BYTES) + (end - start).astype(np.uint64))
        which, unique = pd.factorize(key)
        first = np.zeros(len(unique), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        order = np.argsort(unique)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which, keys, first = rank[which], unique[order], first[order]
        every = sums[end] - sums[start]
        checks = every[first]
        if (checks[which] != every).any():  # two pieces of one key in these texts
            whole = self.whole([bytes(buf[s:e]).decode() for s, e in zip(off[:-1], off[1:], strict=True)])
            return np.concatenate(whole), np.cumsum([0, *map(len, whole)])
        k = self.known
        at = np.searchsorted(k.keys, keys)
        there = at < len(k.keys)
        there[there] = (k.keys[at[there]] == keys[there]) & (k.checks[at[there]] == checks[there])
        self.turn += 1
        k.used[at[there]] = self.turn
        new = np.flatnonzero(~there)
        raw = buf.tobytes()
        got = [self.asked(raw[s:e].decode()) for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
        size = np.array([len(g) for g in got], np.int64)
        ids = np.fromiter((i for g in got for i in g), "<u4", int(size.sum()))
        # ids of this call's pieces: those known, then the new ones
        base = gathered(k.ids, k.start[at[there]], k.size[at[there]])
        sizes = np.zeros(len(keys), np.int64)
        sizes[there], sizes[new] = k.size[at[there]], size
        place = np.zeros(len(keys), np.int64)
        place[there] = np.cumsum(sizes[there]) - sizes[there]
        place[new] = len(base) + np.cumsum(size) - size
        out = gathered(np.concatenate([base, ids]), place[which], sizes[which])
        # a piece of the same key as another one, or a long one, is not kept
        fresh = (end - start)[first[new]] <= PIECE_BYTES
        fresh &= (at[new] >= len(k.keys)) | (k.keys[np.minimum(at[new], max(len(k.keys) - 1, 0))] != keys[new]) if len(k.keys) else fresh
        keep = np.flatnonzero(fresh)
        k.add(at[new][keep], keys[new][keep], checks[new][keep], size[keep], gathered(ids, (np.cumsum(size) - size)[keep], size[keep]), self.turn)
        k.shrink(PIECES)
        upto = np.concatenate([[0], np.cumsum(sizes[which])])
        return out, upto[np.searchsorted(start, off)]

    def encode(self, col: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of each text of a string column, and `end`."""
        last = np.array([end], "<u4")
        if not self.by_piece:
            return [np.append(i, last) for i in self.whole(pc.fill_null(col, "").to_pylist())]
        odd = np.zeros(len(col), bool)
        for token in self.added:
            odd |= pc.fill_null(pc.match_substring(col, token), False).to_numpy(zero_copy_only=False)
        ids, at = self.in_pieces(*text_buffer(col.filter(pa.array(~odd)) if odd.any() else col))
        plain = (np.append(ids[s:e], last) for s, e in zip(at[:-1], at[1:], strict=True))
        rest = iter(self.whole(col.filter(pa.array(odd)).to_pylist()) if odd.any() else ())
        return [np.append(next(rest), last) if o else next(plain) for o in odd]


CHECKS = np.random.default_rng(31).integers(0, 1 << 32, 256, dtype=np.uint32)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One per worker process: later tasks of that worker find the pieces known."""
    return Encoder(path)


def all_chunk_ends(streams: list[np.ndarray]) -> list[list[int]]:
    """Ends of the chunks of each id stream; those longer than a least chunk are hashed together."""
    long = [s for s in streams if len(s) > LEAST]
    ids = np.concatenate(long) if long else np.zeros(0, "<u4")
    cuts = np.flatnonzero(H.window_hashes(H.mix(ids.astype(np.uint64)), ROLL) & np.uint64(MASK) == 0) + ROLL
    out, base = [], 0
    for s in streams:
        n = len(s)
        if n <= LEAST:
            out.append([n] if n else [])
            continue
        own = cuts[np.searchsorted(cuts, base + ROLL) : np.searchsorted(cuts, base + n, "right")] - base
        out.append(chunk_ends(n, own.tolist()))
        base += n
    return out


def chunk_ends(n: int, cuts: list[int]) -> list[int]:
    """Ends of the chunks of n ids: the cuts, but none after fewer than LEAST or more than MOST ids."""
    ends, at = [], 0
    for c in [*cuts, n]:
        while c - at > MOST:
            at += MOST
            ends.append(at)
        if c - at >= LEAST or c == n and c > at:
            at = c
            ends.append(at)
    return ends


def merkle(shas: list[bytes]) -> bytes:
    """Root of the binary hash tree over the chunk digests."""
    level = shas
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def raw_ids(payload: bytes, width: int) -> bytes:
    """Stored payload to ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), f"<u{width}").astype("<u4").tobytes()


ROW = "kind int, route long, sha binary, n long, width int, payload binary, id long, key long, shas array<binary>, root binary"
NAMES = ["kind", "route", "sha", "n", "width", "payload", "id", "key", "shas", "root"]
KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary()]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append end_id and write the store; one shuffle, of unique chunks.

    Each map batch sends a chunk once however often it repeats there; the tasks that write drop what
    other batches sent as well. Rows that repeat id and text get a recipe each.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        sent: set[bytes] = set()
        for b in slices(batches):
            if len(sent) > SENT:
                sent.clear()
            out = []
            streams = coder.encode(b.column(1), end_id)
            for i, key, ids, ends in zip(ids_of(b.column(0)).tolist(), b.column(2).to_pylist(), streams, all_chunk_ends(streams), strict=True):
                shas, at = [], 0
                for to in ends:
                    part = ids[at:to]
                    at = to
                    sha = hashlib.sha256(part).digest()
                    shas.append(sha)
                    if sha not in sent:
                        sent.add(sha)
                        width = 2 if part.max() < 65536 else 4
                        out.append((0, int.from_bytes(sha[:8], "little", signed=True), sha, len(part), width, packer.compress(part.astype(f"<u{width}")), None, None, None, None))
                out.append((1, key, None, len(ids), None, None, None if i == NULL_ID else i, key, shas, merkle(shas)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(KINDS)], names=NAMES)

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by digest, so a repeated chunk follows its like."""
        last = None
        for b in batches:
            shas = b.column(2).to_pylist()
            yield b.filter(pa.array([s is None or s != before for s, before in zip(shas, [last, *shas], strict=False)], pa.bool_()))
            last = shas[-1] if shas else last

    rows = text_rows(docs, id_col, text_col).mapInArrow(encoded, ROW)
    rows.repartition("route").sortWithinPartitions("sha").mapInArrow(unique, ROW).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/store")
    spark = docs.sparkSession
    recipes = stored(spark, path, 1, "n long, id long, key long, shas array<binary>, root binary")
    placed = numbered(recipes.withColumn("place", F.coalesce("id", F.lit(int(NULL_ID)))), ["place", "key"], {"start": "n"}, "starts")
    placed.drop("place").write.option("compression", "zstd").parquet(f"{path}/recipes")


def stored(spark: SparkSession, path: str, kind: int, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", kind int").parquet(f"{path}/store").where(F.col("kind") == kind).drop("kind")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """sha, n, crc of every stored chunk, computed from the stored bytes; a chunk that isn't what its address says fails the job."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = []
            for sha, width, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = raw_ids(payload, width)
                if hashlib.sha256(raw).digest() != sha:
                    raise ValueError(f"chunk {sha.hex()} is damaged")
                crc.append((len(raw) // 4, zlib.crc32(raw)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in crc], pa.int64()), pa.array([c for _, c in crc], pa.int64())], names=["sha", "n", "crc"])

    return stored(spark, path, 0, "sha binary, width int, payload binary").mapInArrow(check, "sha binary, n long, crc long")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n long, id long, key long, shas array<binary>, root binary, start long").parquet(f"{path}/recipes")


def verify_tokens(spark: SparkSession, path: str) -> DataFrame:
    """id, start, n_tokens, crc of each document, from the files: stored chunks are hashed anew, recipes are
    checked against their Merkle roots, and the CRC-32 of a document is combined from those of its chunks."""
    parts = read_recipes(spark, path).select("start", F.posexplode("shas").alias("pos", "sha"))
    got = parts.join(read_chunks(spark, path).hint(MERGE), "sha").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc"))).alias("chunks"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ns, crcs = [], [], [], []
            for i, start, n, shas, root, chunks in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if merkle(shas) != root or [c["pos"] for c in chunks] != list(range(len(shas))) or sum(c["n"] for c in chunks) != n:
                    raise ValueError(f"document {i} can't be rebuilt from the store")
                crc = 0
                for c in chunks:
                    crc = crc_joined(crc, c["crc"], 4 * c["n"])
                ids.append(i)
                starts.append(start)
                ns.append(n)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ns, crcs)], names=["id", "start", "n_tokens", "crc"])

    recipes = read_recipes(spark, path).join(got.hint(MERGE), "start").select("id", "start", "n", "shas", "root", "chunks")
    return recipes.mapInArrow(combine, "id long, start long, n_tokens long, crc long")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """id, start and ids (array) of every document, rebuilt from its chunks."""
    parts = read_recipes(spark, path).select("id", "start", F.posexplode("shas").alias("pos", "sha"))
    chunks = stored(spark, path, 0, "sha binary, width int, payload binary")
    whole = parts.join(chunks, "sha").groupBy("id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "width", "payload"))).alias("chunks"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(raw_ids(c["payload"], c["width"]) for c in chunks), "<u4").astype(np.int64) for chunks in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["id", "start", "ids"])

    return whole.mapInArrow(rebuild, "id long, start long, ids array<long>")


def times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial (bit 31 is the constant term)."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        a = (a >> 1) ^ (0xEDB88320 if a & 1 else 0)
        b = (b << 1) & 0xFFFFFFFF
    return out


@lru_cache(1 << 14)
def shift(length: int) -> int:
    """x to the power of 8 * length: what `length` more bytes do to a CRC."""
    out, square = 0x80000000, 0x00800000  # 1, and x^8: one byte
    while length:
        if length & 1:
            out = times(out, square)
        square = times(square, square)
        length >>= 1
    return out


def crc_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings in a row, from theirs and the length of the second."""
    return times(shift(length), first) ^ second if first else second
