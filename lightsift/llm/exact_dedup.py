"""Exact dedup by deterministic block naming (Karp-Miller-Rosenberg).

Texts are cut into fixed-size blocks. All blocks are sorted across the cluster and equal blocks get
one integer name; then neighbouring names are paired and the pairs named the same way, until every
document has one name. Two documents of equal block count have equal names exactly if their texts
are equal: no hash decides. A document that has a block or pair nobody else has is unique and stops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same, text_rows, written

#: A name is the partition it was first met in times this, plus its rank there.
STRIDE = 1 << 40
#: Parts that the documents of one group are dealt to when they get their answer.
SALTS = 256
KEYS = ["id", "key", "pos"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 2048, pattern: str = r"[\x20\x09-\x0D]+", by: str = " ") -> DataFrame:
    """Group equal texts; runs of `pattern` count as `by`.

    Returns id, keep_id (the group's smallest id), group_size, kept and text_sha256 of the normalised
    text. Null text is an empty text, and empty texts are equal to each other. One row per input row: rows
    that repeat id and text are compared as one document, count each in group_size and are given one row
    each. A null id is larger than any other. One row of each group is kept, also of rows that repeat an id.
    """
    norm = text_rows(docs, id_col, text_col).select("id", "key", F.regexp_replace("text", pattern, by).alias("text"))
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    blocks = norm.select("id", "key", F.sha2("text", 256).alias("sha"), F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(cut).alias("cut"))
    blocks = blocks.select("id", "key", "sha", F.size("cut").alias("n"), F.posexplode("cut").alias("pos", "block"))
    blocks = blocks.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha"))).withColumn("copies", F.when(F.col("pos") == 0, F.lit(1).cast("long")))
    state = whole(named(written(blocks, "cut"), ["block"]))  # range bounds are sampled from what was written: one scan of the texts
    done = []
    while True:
        open_ = F.size("names") > 1
        done.append(state.where(F.col("solo") | ~open_))
        pairs = state.where(~F.col("solo") & open_).select("id", "key", "n", "sha", "copies", F.posexplode(F.expr("transform(sequence(0, size(names) - 1, 2), i -> struct(names[i] AS l, coalesce(get(names, i + 1), -1L) AS r))")).alias("pos", "pair"))
        if pairs.isEmpty():
            break
        pairs = pairs.select("id", "key", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), F.when(F.col("pos") == 0, F.col("copies")).alias("copies"), "n", "pos", "pair.l", "pair.r")
        state = whole(named(pairs, ["l", "r"]))
    all_ = done[0]
    for d in done[1:]:
        all_ = all_.unionByName(d)
    own = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    rest = all_.where(~F.col("solo")).select("id", "key", "sha", "copies", "n", F.col("names")[0].alias("name"), own.alias("own"), F.pmod("key", F.lit(SALTS)).alias("salt"))
    # a large group's documents are dealt out by salt, and so is its answer: one row for each salt it has
    parts = rest.groupBy("n", "name", "salt").agg(F.min("own").alias("best"), F.sum("copies").alias("size"))
    classes = parts.groupBy("n", "name").agg(F.min("best").alias("best"), F.sum("size").alias("group_size"))
    answers = parts.select("n", "name", "salt").join(classes, ["n", "name"])
    first = same(F.col("own.id"), F.col("best.id")) & (F.col("own.key") == F.col("best.key"))
    grouped = rest.join(answers, ["n", "name", "salt"]).select("id", F.col("best.id").alias("keep_id"), "group_size", first.alias("first"), "sha", "copies")
    alone = all_.where("solo").select("id", F.col("id").alias("keep_id"), F.col("copies").alias("group_size"), F.lit(True).alias("first"), "sha", "copies")
    each = alone.unionByName(grouped).select("*", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return each.select("id", "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def whole(names: DataFrame) -> DataFrame:
    """One row per document: its names in order, its number of input rows, and whether one of the names is its own alone."""
    out = names.groupBy("id", "key").agg(F.max("n").alias("n"), F.max("sha").alias("sha"), F.sum("copies").alias("copies"), F.max("solo").alias("solo"), F.transform(F.array_sort(F.collect_set(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    return written(out, "blocks")


def named(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with `name` for its cols: equal values get one integer.

    Rows are sorted by a hash of the value, then the value: the sample that sets the range bounds holds
    short keys only. Rows of a frequent value are spread over several partitions by id; the few names
    that meet at partition edges are joined afterwards. Values, never hashes, decide what is equal.
    """
    keyed = df.select("id", "key", "sha", "copies", "n", "pos", *cols, F.xxhash64(*cols).alias("h"))
    sorted_ = keyed.repartitionByRange("h", *KEYS).sortWithinPartitions("h", *cols, *KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, rank = TaskContext.get().partitionId(), 0
        first: dict[bytes, int] = {}
        last: dict[bytes, int] = {}
        first_h = last_h = last_value = None
        for b in batches:
            if not b.num_rows:
                continue
            values = [b.column(b.schema.get_field_index(c)) for c in cols]
            h = b.column(b.schema.get_field_index("h")).to_numpy()
            value = [v[0].as_py() for v in values]
            new = np.zeros(b.num_rows, bool)
            for v in values:
                new[1:] |= pc.not_equal(v.slice(1), v.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] = value != last_value
            names = pid * STRIDE + rank + np.cumsum(new)
            rank, last_value = rank + int(new.sum()), [v[b.num_rows - 1].as_py() for v in values]
            first_h = h[0] if first_h is None else first_h
            if h[-1] != last_h:
                last_h, last = h[-1], {}
            for at, group in ((first_h, first), (last_h, last)):
                for i in np.flatnonzero(new & (h == at)).tolist():
                    group[hashlib.sha256(repr([v[i].as_py() for v in values]).encode()).digest()] = int(names[i])
            # alone: no neighbour has the same hash; not told at the edges of a batch
            solo = np.zeros(b.num_rows, bool)
            solo[1:-1] = (h[1:-1] != h[:-2]) & (h[1:-1] != h[2:])
            keep = [b.column(b.schema.get_field_index(c)) for c in ("id", "key", "sha", "copies", "n", "pos")]
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*keep, pa.array(names, pa.int64()), pa.array(solo), none, none], names=OUT)
        edges = [(n, d, None) for d, n in first.items()] + [(n, None, d) for d, n in last.items()]
        if edges:
            at = [first_h, last_h]
            m = len(edges)
            yield pa.RecordBatch.from_arrays([pa.array([int(at[e[1] is None]) for e in edges], pa.int64()), pa.array([pid] * m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.array([e[0] for e in edges], pa.int64()), pa.array([False] * m), pa.array([e[1] for e in edges], pa.binary()), pa.array([e[2] for e in edges], pa.binary())], names=OUT)

    out = written(sorted_.mapInArrow(run, "id long, key long, sha string, copies long, n int, pos int, name long, solo boolean, first binary, last binary"), "names")
    told = F.col("first").isNotNull() | F.col("last").isNotNull()
    edges = out.where(told).select(F.col("id").alias("h"), F.col("key").alias("pid"), "name", "first", "last").orderBy("pid").collect()  # about two rows per partition
    alias: dict[int, int] = {}
    before: dict[bytes, int] = {}
    before_h = None
    for _, part in groupby(edges, lambda e: e["pid"]):
        part = list(part)
        for e in part:
            if e["first"] is not None and bytes(e["first"]) in before:
                alias[e["name"]] = before[bytes(e["first"])]
        end = {bytes(e["last"]): alias.get(e["name"], e["name"]) for e in part if e["last"] is not None}
        end_h = next(e["h"] for e in part if e["last"] is not None)
        before = before | end if end_h == before_h else end
        before_h = end_h
    rows = out.where(~told).drop("first", "last")
    if not alias:
        return rows
    to = df.sparkSession.createDataFrame(list(alias.items()), "name long, other long")
    return rows.join(F.broadcast(to), "name", "left").select("id", "key", "sha", "copies", "n", "pos", F.coalesce("other", "name").alias("name"), "solo")


OUT = ["id", "key", "sha", "copies", "n", "pos", "name", "solo", "first", "last"]
