"""Running sums, ranks and quantiles over whole tables without gathering them in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightsift.session import written


def running(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """df with, for each (new, old) in sums, the sum of the long column old over all rows before in the given order.

    The order must be total. Rows are range partitioned and sorted, each task sums its own rows, and one total
    per partition is summed up in turn; the sorted rows are written once, so both passes see the same partitions.
    """
    olds = list(sums.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base = TaskContext.get().partitionId(), [0] * len(olds)
        for b in batches:
            cols = list(b.columns)
            for i, old in enumerate(olds):
                v = pc.fill_null(b.column(b.schema.get_field_index(old)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(v)
                cols.append(pa.array(base[i] + upto - v))
                base[i] += int(upto[-1]) if len(upto) else 0
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(b.num_rows, part, np.int32))], names=[*b.schema.names, *[f"_s{i}" for i in range(len(olds))], "_part"])

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"_s{i} long" for i in range(len(olds))] + ["_part int"])
    out = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, kinds))
    totals = out.groupBy("_part").agg(*[F.sum(o).alias(f"_t{i}") for i, o in enumerate(olds)])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).cast("long").alias(f"_b{i}") for i in range(len(olds))])
    joined = out.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, *[(F.col(f"_s{i}") + F.col(f"_b{i}")).alias(new) for i, new in enumerate(sums)])


def row_numbers(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with its place (from 1) in a total order."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}).withColumn(name, F.col(name) + 1).drop("_one")


def value_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """(value, rank): for each value of the column one more than the number of rows with a greater one; ties share it.
    Null is the least value of all."""
    by = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    return running(by, [F.desc_nulls_last(value)], {name: "_n"}).select(value, (F.col(name) + 1).alias(name))


def quantiles(df: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """One row, q: the quantiles with linear interpolation, from counts of distinct values; nulls without any value."""
    by = df.select(value.cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    counted = running(by, ["v"], {"below": "n"})
    total = counted.agg(F.sum("n").alias("total"))  # one row
    parts = []
    for i, p in enumerate(shares):
        at = F.col("total").cast("double") - 1
        for side, place in (("lo", F.floor(at * p)), ("hi", F.ceil(at * p))):
            parts.append(F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col("v"))).alias(f"{side}{i}"))
        parts.append(F.max(at * p - F.floor(at * p)).alias(f"part{i}"))
    found = counted.crossJoin(F.broadcast(total)).agg(*parts)
    return found.select(F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}") for i in range(len(shares))]).alias("q"))
