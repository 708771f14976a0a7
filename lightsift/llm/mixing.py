"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS, STEP = 60, 12
WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def hash_of(id_col: str) -> Column:
    """60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def copies_of(u: Column) -> Column:
    return (F.col("times") + F.when((F.col("need") > 0) & (u < F.col("cut")), 1).otherwise(0)).cast("int")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mixture itself: the rows of docs, all columns, each as often as `mix_sources` takes it, repeated rows each for itself.

    Documents without words (and null texts) have no size and are taken by their hash like any other. Texts are not
    shuffled as long as Spark finds the table of sources small enough to send to every task.
    """
    _, limits = mix_limits(docs, id_col, text_col, source_col, weights, share, most)
    l = limits.select(F.col("source").alias("__source__"), "times", "need", "cut")  # noqa: E741
    joined = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row__"), hash_of(id_col).alias("__u__"), F.col(source_col).cast("string").alias("__of__")).join(l, F.col("__of__").eqNullSafe(F.col("__source__")))
    times = joined.select("__row__", copies_of(F.col("__u__")).alias("__n__")).where("__n__ > 0")
    return times.select("__row__", F.explode(F.sequence(F.lit(1), "__n__"))).select("__row__.*")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Take about `target` words of each source, whole documents only, none more than `most` times.

    A document's size is its number of words (null: 0). Sources in code-point order, null last, weigh
    `weights` in turn and share `share` times all words; a target stops at `most` times its source and
    what is over is shared by weight again until no target is above. Each document has a 60-bit hash of
    its id. A source is taken whole as often as its target allows; the rest is the longest run of hash
    values whose words fit, found by histograms of 12 bits: only the bucket where the budget ends is
    refined, nothing is sorted. Documents that repeat an id share a hash and are taken or left together.

    Returns id, source, size, source_size, target and taken (words taken, repeats counted).
    The table of sources (one row each) is ranked in one task; documents never are.
    """
    sized, limits = mix_limits(docs, id_col, text_col, source_col, weights, share, most)
    taken = F.col("size") * copies_of(F.col("u"))
    return sized.alias("d").join(limits.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source"))).select("id", "d.source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_limits(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of the documents; per source its size, target, whole copies and the hash below which one more is taken."""
    sized = written(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(source_col).cast("string").alias("source"),
            size_of(text_col).alias("size"),
            hash_of(id_col).alias("u"),
        ),
        "sizes",
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = by_source.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap"))
    # sources whose cap comes first are full; the level of the others is the largest over all prefixes
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = upto.rowsBetween(Window.unboundedPreceding, -1), upto.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest)
    filled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("w"))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = filled.withColumn("target", target).select("source", "source_size", "target", times.cast("long").alias("times"))
    sources = written(sources.withColumn("need", F.col("target") - F.col("times") * F.col("source_size")), "sources")

    # per source: the hash range [low, low + 2**left) still to be split, and the words that may be taken of it
    state = sources.select("source", F.lit(0).cast("long").alias("low"), F.lit(BITS).alias("left"), F.col("need").alias("room"))
    cuts = []
    while True:
        inside = sized.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).where("u >= low AND u - low < shiftleft(1L, left)")
        width = F.col("left") - STEP
        histogram = inside.groupBy(F.col("s.source").alias("source"), "low", "left", "room", F.expr(f"shiftright(u - low, left - {STEP})").alias("bucket")).agg(F.sum("size").alias("words"), F.min("u").alias("first"), F.max("u").alias("last"))
        so_far = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        over = histogram.withColumn("upto", so_far).where(F.col("upto") > F.col("room"))
        edge = over.groupBy("source").agg(F.min_by(F.struct("low", "left", "room", "bucket", "words", "upto", "first", "last"), "bucket").alias("e")).select("source", "e.*")
        edge = written(edge, "edges")
        cuts.append(edge.where(F.col("first") == F.col("last")).select("source", F.col("first").alias("cut")))
        state = edge.where(F.col("first") < F.col("last")).select("source", (F.col("low") + F.expr(f"shiftleft(bucket, left - {STEP})")).alias("low"), width.alias("left"), (F.col("room") - F.col("upto") + F.col("words")).alias("room"))
        if state.isEmpty():
            break
    cut = reduce(DataFrame.unionByName, cuts)
    limits = written(sources.alias("s").join(cut.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select("s.*", F.coalesce("cut", F.lit(1 << BITS)).alias("cut")), "limits")
    return sized, limits
