"""Content dedup, greedy elimination of look-alikes, RAW and JPEG pairs, training labels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightsift.functions.vectors import dot, normalized
from lightsift.session import discard, scratch, written

from .graph import components
from .ordering import running

ALIKE = 0.9995
RAW = ("cr2", "cr3", "nef", "arw", "raf", "rw2", "orf", "dng")


def first_of_content(files: DataFrame, digest: str, order: list[Column]) -> DataFrame:
    """The first row of each digest in the given order."""
    return files.withColumn("_n", F.row_number().over(Window.partitionBy(digest).orderBy(*order))).where("_n = 1").drop("_n")


def training_rows(files: DataFrame, digest: str, path: str, label: str) -> DataFrame:
    """One row per content: its first path, and the largest label of all copies."""
    return files.groupBy(digest).agg(F.min(path).alias(path), F.max(label).alias(label))


def without_paired_raw(files: DataFrame) -> DataFrame:
    """Files (dir, stem, ext) without the RAW ones that have another format beside them."""
    raw = F.lower("ext").isin(*RAW)
    plain = files.where(~raw).select("dir", "stem").distinct().withColumn("_raw", F.lit(True))
    return files.withColumn("_raw", raw).join(plain, ["dir", "stem", "_raw"], "left_anti").drop("_raw")


#: Rows of a block that is compared with another in one task.
BLOCK = 2048


def unit_rows(vectors: DataFrame, key: str, emb: str) -> DataFrame:
    """(k, v): keys and unit vectors, written once; rows without a vector are left out."""
    return written(vectors.select(F.col(key).alias("k"), normalized(F.col(emb)).alias("v")).where("v IS NOT NULL"))


def alike_edges(vectors: DataFrame, key: str, emb: str, threshold: float = ALIKE, block: int = BLOCK, axes: int | None = None, recall: float | None = None) -> DataFrame:
    """Pairs a < b whose cosine is at least threshold, with it. One row per key.

    Without `recall` exact: alike unit vectors lie within sqrt(2 - 2 threshold) of each other, so along each of some fixed
    orthogonal axes they fall into the same or neighbouring cells of that width: a vector is compared with those of the cells
    around its own only. That tells few vectors apart where they have hundreds of dimensions, and none where the width is over a half.
    With `recall` (below 1) candidates come from hash tables, see `hashed_edges`: each pair at the threshold is found with at
    least that probability, nearer ones with a higher one, and whatever is found is checked by its cosine.
    """
    unit = unit_rows(vectors, key, emb)
    return exact_edges(unit, threshold, block, axes) if recall is None else hashed_edges(unit, threshold, recall)


def exact_edges(unit: DataFrame, threshold: float, block: int = BLOCK, axes: int | None = None) -> DataFrame:
    """All pairs; blocks of about `block` rows meet in a task, however many rows a cell or the table has."""
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    n, kind = unit.count(), unit.schema["k"].dataType.simpleString()
    if axes is None:
        axes = 0 if width > 0.5 or n <= block else 2 if n < 10_000_000 else 3
    size = unit.select(F.size("v").alias("n")).first() if axes else None
    axes = min(axes, size["n"]) if size else 0
    if not axes:
        return all_pairs(unit, n, threshold, block)
    basis = np.linalg.qr(np.random.default_rng(17).normal(size=(size["n"], axes)))[0].T
    places = [F.floor(dot(F.col("v"), F.array(*[F.lit(float(x)) for x in axis])) / width).cast("int") for axis in basis]
    homes = unit.withColumn("cell", F.array(*places))
    around = [list(o) for o in product((-1, 0, 1), repeat=axes)]
    near = F.array(*[F.array(*[F.get("cell", i) + F.lit(d) for i, d in enumerate(o)]) for o in around])
    every = homes.select("k", "v", F.explode(near).alias("cell"))
    blocks = lambda df, c: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(c))
    grid = written(blocks(homes, "rows").join(blocks(every, "cols"), "cell"))
    own = homes.join(grid, "cell").select("cell", F.pmod(F.xxhash64("k"), "rows").cast("int").alias("i"), F.explode(F.expr("sequence(0, cols - 1)")).alias("j"), F.lit(True).alias("home"), "k", "v")
    others = every.join(grid, "cell").select("cell", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), F.pmod(F.xxhash64("k"), "cols").cast("int").alias("j"), F.lit(False).alias("home"), "k", "v")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["home"]], pdf[~pdf["home"]]
        if not len(a) or not len(b):
            none = pdf["k"].head(0)
            return pd.DataFrame({"a": none, "b": none, "cos": np.zeros(0)})
        sims = np.stack(a["v"].to_list()) @ np.stack(b["v"].to_list()).T
        ka, kb = a["k"].to_numpy(), b["k"].to_numpy()
        x, y = np.nonzero((sims >= threshold) & (ka[:, None] < kb[None, :]))
        return pd.DataFrame({"a": ka[x], "b": kb[y], "cos": sims[x, y]})

    return own.unionByName(others).groupBy("cell", "i", "j").applyInPandas(pairs, f"a {kind}, b {kind}, cos double")


#: Bytes of vectors in a block at most, and blocks that one task writes.
BLOCK_BYTES, FILE = 2 << 20, 2


def packed(unit: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """(i, ks, m): the n rows of unit, but those without a key, in blocks of up to `block` keys with the bytes of their vectors, written once.
    Blocks are in ascending order: a smaller i has smaller keys."""
    kind = unit.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, rows, typ = TaskContext.get().partitionId() << 32, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            typ, lengths = b.schema.field(0).type, pc.list_value_length(b.column(1)).to_numpy()
            full = max(1, min(block, BLOCK_BYTES // (8 * max(1, int(lengths.max())))))
            for k, v in zip(b.column(0).to_pylist(), np.split(b.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)[:-1]), strict=True):
                keys.append(k)
                rows.append(v)
                if len(keys) >= full:
                    yield block_row(at, keys, np.stack(rows), typ)
                    at, keys, rows = at + 1, [], []
        if keys:
            yield block_row(at, keys, np.stack(rows), typ)

    ordered = unit.where("k IS NOT NULL").select("k", "v").repartitionByRange(max(1, math.ceil(n / (FILE * block))), "k").sortWithinPartitions("k")
    return written(ordered.mapInArrow(run, f"i long, ks array<{kind}>, m binary"))


def block_row(i: int, keys: list, rows: np.ndarray, typ: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([keys], pa.list_(typ)), pa.array([rows.astype("<f8").tobytes()], pa.binary())], names=["i", "ks", "m"])


def matrix(keys: int, m: bytes) -> np.ndarray:
    return np.frombuffer(m, "<f8").reshape(keys, -1)


def all_pairs(unit: DataFrame, n: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """Pairs of rows, each compared with each: n * n / 2 products. Tasks read the blocks of two parts of the written table, so nothing is
    shuffled and a task holds two parts, however many rows there are; only the pairs found may grow with the square."""
    kind = unit.schema["k"].dataType.simpleString()
    blocks = packed(unit, n, block)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            typ = batch.schema.field(1).type.value_type
            for i, own, x, j, others, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                u, v = matrix(len(own), x), matrix(len(others), y).T
                own, others = pa.array(own, typ).to_numpy(zero_copy_only=False), pa.array(others, typ).to_numpy(zero_copy_only=False)
                for at in range(0, len(own), 512):
                    sims = u[at : at + 512] @ v
                    p, q = np.nonzero(sims >= threshold)
                    cos = sims[p, q]
                    a, b = own[at + p], others[q]
                    less = a < b  # blocks are in order of their keys
                    if not less.all():
                        a, b, cos = a[less], b[less], cos[less]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a, typ), pa.array(b, typ), pa.array(cos)], names=["a", "b", "cos"])

    left, right = blocks.select("i", "ks", "m"), blocks.select(F.col("i").alias("j"), F.col("ks").alias("ls"), F.col("m").alias("o"))
    return left.join(right.hint(REPLICATE), F.col("i") <= F.col("j")).mapInArrow(compare, f"a {kind}, b {kind}, cos double")


#: Hint of a join that meets two tables part by part: nothing is broadcast or shuffled.
REPLICATE = "shuffle_replicate_nl"
#: Rows of a stretch of the greedy pass, and bytes of its vectors, at most (and a block more).
STRETCH, STRETCH_BYTES = 8192, 16 << 20


def greedy_alike(vectors: DataFrame, key: str, emb: str, threshold: float = ALIKE, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """`greedy` over all pairs with a cosine of at least threshold, without the pairs: keys that a pass in ascending order keeps.

    The next keys, up to `stretch` of them, are walked in one task; those that stay are compared with all rows behind them, in many tasks,
    and only rows that none of them resembles go on. Work is rows times rows kept, tables are as large as the rows that go on, and
    the one before is deleted. Rows without a key or a vector stay. One row per key.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    unit = unit_rows(vectors.where(F.col(key).isNotNull()), key, emb)
    alone = vectors.where(F.col(key).isNull() | F.col(emb).isNull()).select(key)
    rest, kept = packed(unit, unit.count(), block), scratch("kept", spark)
    none = True

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All blocks of a stretch in order: one block of the rows that stay."""
        keys, stay, typ = [], None, None
        for batch in batches:
            typ = batch.schema.field(1).type.value_type
            for ks, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = matrix(len(ks), m)
                for at in range(0, len(ks), 256):
                    part = rows[at : at + 256]
                    gone = np.zeros(len(part), bool) if stay is None else (part @ stay.T >= threshold).any(axis=1)
                    alike, own = part @ part.T >= threshold, []
                    for r in range(len(part)):
                        if not gone[r]:
                            gone |= alike[r]
                            own.append(r)
                    keys += [ks[at + r] for r in own]
                    stay = part[own] if stay is None else np.concatenate([stay, part[own]])
        if keys:
            yield block_row(0, keys, stay, typ)

    def going_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            typ = batch.schema.field(1).type.value_type
            for i, ks, m, n, stay in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, stay = matrix(len(ks), m), matrix(n, stay).T
                on = np.concatenate([np.flatnonzero(~(rows[at : at + 512] @ stay >= threshold).any(axis=1)) + at for at in range(0, len(ks), 512)])
                if len(on):
                    yield block_row(i, [ks[r] for r in on], rows[on], typ)

    while sizes := rest.select("i", F.size("ks").alias("n"), F.octet_length("m").alias("bytes")).orderBy("i").collect():  # a row for each block
        last, n, size = sizes[0]
        for r in sizes[1:]:
            n, size = n + r["n"], size + r["bytes"]
            if n > stretch or size > STRETCH_BYTES:
                break
            last = r["i"]
        stay = written(rest.where(F.col("i") <= last).repartition(1).sortWithinPartitions("i").mapInArrow(walked, rest.schema))
        stay.select(F.explode("ks").alias(key)).write.mode("append").parquet(kept)
        none = False
        behind = rest.where(F.col("i") > last).join(stay.select(F.size("ks").alias("n"), F.col("m").alias("stay")).hint(REPLICATE))
        before, rest = rest, written(behind.mapInArrow(going_on, rest.schema))
        discard(before)
        discard(stay)
    discard(unit)
    return alone if none else alone.unionByName(spark.read.schema(f"`{key}` {kind}").parquet(kept))


#: Bits of a table's hash from which one is chosen, the most tables, and bits of the sketch that candidates are compared by.
BITS, TABLES, SKETCH = (8, 12, 16, 20, 24, 28, 32), 48, 256
#: Rows of a bucket that meet in one task.
CROWD = 8192


def table_count(threshold: float, bits: int, recall: float) -> int:
    """Hash tables that find a pair at the threshold with probability `recall`: a random plane through the origin parts
    two vectors with the probability of their angle over pi."""
    same = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-same))) if same < 1 else 1


def plane_matrix(dim: int, tables: int) -> np.ndarray:
    """Fixed random planes: 32 for each table, then those of the sketch."""
    return np.random.default_rng(23).normal(size=(32 * tables + SKETCH, dim))


def hash_rows(unit: DataFrame, dim: int, tables: int) -> DataFrame:
    """(k, codes, sketch): for each table 32 sign bits, and SKETCH more."""
    kind = unit.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = plane_matrix(dim, tables)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                bits = np.packbits(v @ planes.T > 0, axis=1, bitorder="little")
                codes = pa.array(list(bits[:, : 4 * tables].copy().view("<u4").astype(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), codes, pa.array([r.tobytes() for r in bits[:, 4 * tables :]], pa.binary())], names=["k", "codes", "sketch"])

    return unit.mapInArrow(run, f"k {kind}, codes array<long>, sketch binary")


def table_plan(hashed: DataFrame, threshold: float, recall: float) -> tuple[int, int, float] | None:
    """(bits, tables, share): how many bits of a hash to use and how many tables, so that the fewest pairs are compared, and the
    share of all pairs that are. None if comparing all of them is no more work. Counted over all rows of one table."""
    n = F.col("n").cast("double")
    by = hashed.groupBy(F.col("codes")[0].alias("c")).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n")).first()[0] or 0
    best = None
    for bits in BITS:
        tables = table_count(threshold, bits, recall)
        if tables <= TABLES:
            met = by.groupBy(F.col("c") % (1 << bits)).agg(F.sum("n").alias("n")).agg(F.sum(n * n)).first()[0] or 0.0
            share = tables * met / max(1, total) ** 2
            if best is None or share < best[2]:
                best = bits, tables, share
    return best if best and (best[2] < 1 or total <= 1) else None


def hashed_edges(unit: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Pairs a < b of unit vectors with cosine at least threshold, each found with probability `recall` or higher.

    Sign bits of random projections go to tables, keys and a short sketch meet in the tables' buckets, pairs whose sketches differ in
    more bits than any pair at the threshold plausibly does (six standard deviations) are dropped, and the vectors are fetched for
    what is left, once for each pair. A bucket of any size is compared block by block. Vectors don't travel to the tables.
    """
    first = unit.select(F.size("v").alias("n")).first()
    kind = unit.schema["k"].dataType.simpleString()
    if first is None:
        return unit.sparkSession.createDataFrame([], f"a {kind}, b {kind}, cos double")
    most = max((table_count(threshold, b, recall) for b in BITS if table_count(threshold, b, recall) <= TABLES), default=0)
    if not most:
        return exact_edges(unit, threshold)
    hashed = written(hash_rows(unit, first["n"], most))
    plan = table_plan(hashed, threshold, recall)
    if plan is None:
        return exact_edges(unit, threshold)
    bits, tables, _ = plan
    part = math.acos(min(1.0, threshold)) / math.pi
    apart = int(SKETCH * part + 6 * math.sqrt(SKETCH * part * (1 - part)) + 3)
    spread = hashed.select("k", "sketch", F.posexplode(F.slice("codes", 1, tables)).alias("t", "c")).select("k", "sketch", "t", (F.col("c") % (1 << bits)).alias("c"))
    sizes = spread.groupBy("t", "c").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    homes = spread.join(sizes, ["t", "c"]).withColumn("i", F.pmod(F.xxhash64("k"), "parts").cast("int"))
    # block i meets block j >= i: a row goes to (i, j) as a home and to (j, i) as another
    cells = F.explode(F.expr("transform(sequence(0, parts - 1), j -> struct(least(i, j) AS lo, greatest(i, j) AS hi))"))
    dealt = homes.select("t", "c", "k", "sketch", "i", cells.alias("p")).select("t", "c", "p.lo", "p.hi", "k", "sketch", "i")

    def near(table: pa.Table) -> pa.Table:
        keys, own = table.column("k").to_numpy(zero_copy_only=False), table.column("i").to_numpy()
        words = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u8").reshape(len(keys), -1)
        lo, hi = int(table.column("lo")[0].as_py()), int(table.column("hi")[0].as_py())
        x, y = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        a, b = [], []
        for s in range(0, len(x), 256):
            for t in range(0, len(y), 2048):
                i, j = x[s : s + 256], y[t : t + 2048]
                far = np.zeros((len(i), len(j)), np.int64)
                for w in range(words.shape[1]):
                    far += np.bitwise_count(words[i, w][:, None] ^ words[j, w][None, :])
                p, q = np.nonzero(far <= apart)
                u, v = keys[i[p]], keys[j[q]]
                less = u < v
                ok = less if lo == hi else u != v
                a.append(np.where(less, u, v)[ok])
                b.append(np.where(less, v, u)[ok])
        typ = table.schema.field("k").type
        cat = lambda z: pa.array(np.concatenate(z).tolist(), typ) if z else pa.array([], typ)
        return pa.table({"a": cat(a), "b": cat(b)})

    pairs = dealt.groupBy("t", "c", "lo", "hi").applyInArrow(near, f"a {kind}, b {kind}").distinct()
    left, right = unit.select(F.col("k").alias("a"), F.col("v").alias("va")), unit.select(F.col("k").alias("b"), F.col("v").alias("vb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", dot(F.col("va"), F.col("vb")).alias("cos")).where(F.col("cos") >= threshold)


#: Edges of a component that one task walks at a time.
WALK = 2_000_000


def greedy(keys: DataFrame, key: str, edges: DataFrame, walk: int = WALK) -> DataFrame:
    """Keys that a pass in ascending order keeps: a key stays unless a smaller key that stays is its neighbour.

    Components of the edges don't depend on each other: each is walked in order in a task, many small ones in one. Of a component
    with more than `walk` edges one stretch of keys is walked after the other, given what the stretches before have dropped; only
    such components need more than one round, and the length of a chain doesn't matter.
    """
    root = components(edges)
    placed = edges.select("a", "b").distinct().join(root, F.col("b") == root.node).select("root", "a", "b")
    counts = placed.groupBy("root", "b").agg(F.count(F.lit(1)).alias("n"))
    upto = written(running(counts, ["root", "b"], {"before": "n"}))
    start = upto.groupBy("root").agg(F.min("before").alias("start"))
    stretch = upto.join(start, "root").select("root", "b", F.floor((F.col("before") - F.col("start")) / walk).cast("int").alias("stretch"))
    open_ = written(placed.join(stretch, ["root", "b"]))
    rounds = open_.agg(F.coalesce(F.max("stretch") + 1, F.lit(0))).first()[0]
    kind = edges.schema["b"].dataType.simpleString()

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges come by component, larger key and smaller key; one whose smaller key stays drops the larger."""
        now, dropped = None, set()
        for batch in batches:
            out = []
            for r, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if r != now:
                    now, dropped = r, set()
                if a not in dropped and b not in dropped:
                    dropped.add(b)
                    out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(2).type)], names=["n"])

    gone = None
    for i in range(rounds):
        own = open_.where(F.col("stretch") == i).select("root", "a", "b")
        if gone is not None:
            own = own.join(gone, own.a == gone.n, "left_anti")
        new = written(own.repartition("root").sortWithinPartitions("root", "b", "a").mapInArrow(walked, f"n {kind}"))
        gone = new if gone is None else gone.unionByName(new)
    kept = keys.select(F.col(key).alias("n"))
    return (kept if gone is None else kept.join(gone, "n", "left_anti")).select(F.col("n").alias(key))
