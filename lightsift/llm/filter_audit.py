"""Filter interaction audit: what five quality filters remove together, one by one, in any order.

Filter E (a text that a smaller id has) needs equal texts of the whole table. A counting Bloom filter goes before it: tasks
make partial counters from 64-bit text hashes, partial counters are added up by shard, and a text with a counter of one
is certainly unique. Only the others' texts are shuffled, whole, for the least id of each. The flags of a row are
a mask of five bits, so counts by part and mask are all that the audit of every order needs: they are additive.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
WHITE = r"[\x20\x09-\x0D]+"
#: Counters of a shard, counters of a text, and what the whole filter may take: each counter is one bit where it is read.
#: Beyond that bound the filter gets denser and clears fewer texts; what it doesn't clear is compared exactly anyway.
SHARD, PER_TEXT, MOST_BYTES = 1 << 20, 16, 128 << 20
FLUSH = 2_000_000
#: Stands for a null id.
NO_ID = (1 << 63) - 1


def text_flags(text: Column) -> Column:
    """Bits of the filters that look at the text alone: A 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(text, WHITE), "")
    rules = (F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(r, 1 << i).otherwise(0) for i, r in enumerate(rules)), F.lit(0))


def places(h: Column, shards: int) -> list[Column]:
    """Shard of a text hash, and its two counters there."""
    return [F.pmod(h, F.lit(shards)).cast("int").alias("shard"), *[F.pmod(F.xxhash64(h, F.lit(i)), F.lit(SHARD)).cast("int").alias(f"c{i}") for i in (1, 2)]]


def possible_repeats(hashes: DataFrame, shards: int) -> DataFrame:
    """(shard, words): of each shard of the counting filter over the hashes `h`, one bit per counter, set if it counts two or more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            edges = np.flatnonzero(np.diff(at // SHARD, prepend=-1))
            rows = [(int(at[lo] // SHARD), at[lo:hi], n[lo:hi]) for lo, hi in zip(edges, [*edges[1:], len(at)], strict=True)]
            cells = [[(a[c == 1] % SHARD).astype("<u4").tobytes(), (a[c > 1] % SHARD).astype("<u4").tobytes()] for _, a, c in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([c[i] for c in cells], pa.binary()) for i in (0, 1)]], names=["shard", "once", "more"])

        for b in batches:
            if b.num_rows:
                shard, one, two = (b.column(i).to_numpy().astype(np.int64) for i in range(3))
                # a hash whose two counters coincide counts once there
                held.append(np.concatenate([shard * SHARD + one, (shard * SHARD + two)[one != two]]))
            if sum(map(len, held)) >= FLUSH:
                yield flush()
                held.clear()
        if held:
            yield flush()

    def merged(table: pa.Table) -> pa.Table:
        counts = np.zeros(SHARD, np.uint8)
        for once, more in zip(table.column("once").to_pylist(), table.column("more").to_pylist(), strict=True):
            at = np.frombuffer(once, "<u4")
            counts[at] = np.minimum(counts[at] + 1, 2)
            counts[np.frombuffer(more, "<u4")] = 2
        words = np.packbits(counts > 1, bitorder="little").view("<i8")
        return pa.table({"shard": pa.array(table.column("shard").to_numpy()[:1], pa.int32()), "words": pa.array([words], pa.list_(pa.int64()))})

    cells = hashes.select(*places(F.col("h"), shards)).mapInArrow(partial, "shard int, once binary, more binary")
    return cells.groupBy("shard").applyInArrow(merged, "shard int, words array<long>")


def screened(rows: DataFrame, planes: DataFrame, shards: int) -> DataFrame:
    """rows (h, ...) that the filter can't clear."""
    at = rows.select("*", *places(F.col("h"), shards))
    hit = [F.getbit(F.get("words", F.expr(f"c{i} div 64")), F.col(f"c{i}") % 64) == 1 for i in (1, 2)]
    return at.join(F.broadcast(planes), "shard").where(hit[0] & hit[1]).select(*rows.columns)  # at most MOST_BYTES


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and failed filters, and how many of them `labels` calls quality 1 and toxic 1.

    A null text is empty and a null part is the empty string. A null id is larger than any other and has no labels; an id
    with several labels has each that any of them gives. Rows that repeat id and text fail filter E for the sake of
    smaller ids only, each for itself. Columns other than the ones named are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    narrow = written(rows.select("id", "part", "h", text_flags(F.col("text")).alias("mask")), "flags")
    shards = max(1, min(-(-narrow.count() * PER_TEXT // SHARD), MOST_BYTES * 8 // SHARD))
    planes = written(possible_repeats(narrow, shards), "filter")
    # the least id of each text that may repeat, by whole texts; every other row of such a text fails filter E
    least = screened(rows.select("id", "text", "h"), planes, shards).groupBy("text").agg(F.min("id").alias("id"), F.first("h").alias("h"))
    open_ = screened(narrow, planes, shards).groupBy("id", "h", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    repeats = written(open_.join(least.select("id", "h").distinct(), ["id", "h"], "left_anti"), "repeats")
    both = F.explode(F.array(F.struct("mask", (-F.col("n")).alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), F.col("n").alias("n"))))
    moved = repeats.select("id", "part", both.alias("m")).select("id", "part", "m.*")
    every = narrow.select("id", "part", "mask", F.lit(1).cast("long").alias("n")).unionByName(moved)
    told = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")).where("good = 1 OR toxic = 1")
    labelled = every.where(F.col("id") != NO_ID).groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).join(told, "id")
    zero = F.lit(0).cast("long")
    counts = every.groupBy("part", "mask").agg(F.sum("n").alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    flagged = labelled.select("part", "mask", zero.alias("n"), *[(F.col("n") * F.coalesce(F.col(c), zero)).alias(c) for c in ("good", "toxic")])
    return counts.unionByName(flagged).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, from the counts of `masks` (at most 32 rows a part).

    kept: rows that pass the filters up to this step; removed: rows that this step's filter is the first to take; redundant:
    rows that fail it but were taken before; unique_fails: rows that fail it alone; good_lost and toxic_lost: labels
    of the removed; shapley: what the filter removes over all 120 orders (a row that fails k filters falls to each of them 120 / k times).
    """
    of_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = of_part.select("part", "c", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = F.transform(F.split("filter_order", ""), lambda x: F.pow(F.lit(2), F.ascii(x) - 65).cast("int"))
    steps = steps.withColumn("bits", bits).withColumn("own", F.element_at("bits", F.col("step")))
    steps = steps.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a.bitwiseOR(x)))

    def total(what: str, keep) -> Column:
        fails = lambda m: (m.bitwiseAND(F.col("own")) > 0, m.bitwiseAND(F.col("before")) > 0)
        return F.aggregate("c", F.lit(0).cast("long"), lambda a, r: a + F.when(keep(*fails(r["mask"]), r["mask"]), r[what]).otherwise(0))

    share = F.aggregate("c", F.lit(0).cast("long"), lambda a, r: a + F.when(r["mask"].bitwiseAND(F.col("own")) > 0, r["n"] * 120 / F.bit_count(r["mask"])).otherwise(0).cast("long"))
    removed = lambda own, before, m: own & ~before
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("n", lambda own, before, m: ~own & ~before).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda own, before, m: own & before).alias("redundant"),
        total("n", lambda own, before, m: m == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of all orders of the five filters for each part of docs; see `masks` and `audit`. No documents give no rows."""
    return audit(masks(docs, labels, id_col, text_col, part_col))
