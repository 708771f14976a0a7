"""Shared plumbing of the corpus operators: scratch tables, row keys, Arrow batch slicing and ordered numbering.

Conventions that every operator follows unless its docstring says otherwise
* a null text counts as an empty text;
* a row is identified by its id together with its text (``row_key``), so null ids and repeated
  ids are legal: rows that repeat both id and text are given the same answer each;
* a null id sorts after every other id (it is never the "smaller" document);
* columns other than the ones named are ignored, whatever they are called;
* an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsift.session import scratch

#: Ordering value of a null id inside packed postings.
NULL_ID = np.iinfo(np.int64).max
#: Text bytes that a task turns into NumPy arrays at a time (a longer single document goes alone).
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and Python: 10,000 long texts (Spark's default bound of rows) are too many at once.
BATCH_CONF, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20

#: Hint of joins whose sides both grow with the corpus: what is made in Python, exploded or read from compressed files is larger than
#: Spark's estimate, and the driver would hold it to broadcast it.
MERGE = "merge"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir (a local one for a local master without it)."""
    return scratch(tag, spark)


def written(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared scratch folder and return the table: lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the bytes of Arrow batches in its session, unless the user has set a bound."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF).rstrip("b") == str(BATCH_DEFAULT):
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key): the two columns an operator needs, null text as '', and a 64-bit row key."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return small_batches(df).select(F.col(id_col).cast("long").alias("id"), text.alias("text"), text_rows_key(id_col, text_col).alias("key"))


def text_rows_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def total_bytes(rows: DataFrame) -> int:
    """UTF-8 bytes of the text column, one scan without a shuffle of rows; sizes buckets and groups."""
    return int(rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column back to back, and the n+1 offsets of its rows."""
    col = pc.fill_null(col, "")
    off_type = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, off_type)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit text bytes, so that NumPy temporaries stay bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def rows_where(docs: DataFrame, text_col: str, rule: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """The rows of docs, all columns, for whose texts the predicate is true. rule() makes it in each task; it gets bytes and offsets."""

    at, plain = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = rule()
        for b in slices(batches, plain[at]):
            yield b.filter(pa.array(keep(*text_buffer(b.column(at))), pa.bool_()))

    named = small_batches(docs).toDF(*plain)  # names with dots can't be passed on as they are
    return named.mapInArrow(run, named.schema).toDF(*docs.columns)


def ids_of(col: pa.Array) -> np.ndarray:
    return pc.fill_null(col, int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def long_array(ids: np.ndarray) -> pa.Array:
    """The inverse of ids_of: NULL_ID becomes null again."""
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def numbered(df: DataFrame, keys: list[str], sums: dict[str, str], tag: str) -> DataFrame:
    """df in ascending order of keys with, for each (new, old) in sums, the exclusive running sum of the long column old.

    Range partitioning sorts in parallel; each task sums its own rows and only one total per
    partition reaches the driver, so no task sees the whole table. The sorted table is written to
    the scratch folder before the totals are read, hence both passes see the same partitions.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    olds = list(sums.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, base, seq = TaskContext.get().partitionId(), [0] * len(olds), 0
        for b in batches:
            cols = list(b.columns)
            for i, old in enumerate(olds):
                v = pc.fill_null(b.column(b.schema.get_field_index(old)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                c = np.cumsum(v)
                cols.append(pa.array(base[i] + c - v, pa.int64()))
                base[i] += int(c[-1]) if len(c) else 0
            cols += [pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(np.arange(seq, seq + b.num_rows, dtype=np.int64))]
            seq += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *[f"_s{i}" for i in range(len(olds))], "_pid", "_seq"])

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"_s{i} long" for i in range(len(olds))] + ["_pid int", "_seq long"])
    out = written(ordered.mapInArrow(run, kinds), tag)
    totals = out.groupBy("_pid").agg(*[F.max(F.col(f"_s{i}") + F.coalesce(F.col(o), F.lit(0))).alias(f"t{i}") for i, o in enumerate(olds)]).orderBy("_pid").collect()
    base, rows = [0] * len(olds), []
    for r in totals:
        rows.append((r["_pid"], *base))
        base = [b + int(r[f"t{i}"]) for i, b in enumerate(base)]
    at = df.sparkSession.createDataFrame(rows, ", ".join(["_pid int"] + [f"_b{i} long" for i in range(len(olds))]))
    joined = out.join(F.broadcast(at), "_pid")  # one row per partition
    return joined.select(*df.columns, *[(F.col(f"_s{i}") + F.col(f"_b{i}")).alias(new) for i, new in enumerate(sums)])
