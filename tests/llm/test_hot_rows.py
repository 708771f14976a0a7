"""Many rows that repeat id and text: sent once per batch, answered each; training rows are bounded."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lightsift.llm import hashing as H
from lightsift.llm import postings as P
from lightsift.llm import toxicity as T
from lightsift.llm.substring_dedup import substring_dedup


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_repeated_rows_travel_once():
    rows = [(1, "a", 7)] * 5 + [(None, "", 9)] * 3 + [(2, "a", 8)]
    b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64()))], names=["id", "text", "key"])
    got = [tuple(r.values()) for x in P.distinct_rows([b, b.slice(8)]) for r in x.to_pylist()]
    assert sorted(got, key=repr) == sorted([(1, "a", 7, 5), (None, "", 9, 3), (2, "a", 8, 1), (2, "a", 8, 1)], key=repr)
    # equal keys of different texts stay apart
    c = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array(["x", "y"]), pa.array([5, 5])], names=["id", "text", "key"])
    assert [r["copies"] for x in P.distinct_rows([c]) for r in x.to_pylist()] == [1, 1]


def test_substring_of_a_row_many_times(spark):
    hot, first = prose(1, 400), prose(2, 60)
    rows = [(5, hot)] * 3000 + [(None, hot)] * 700 + [(9, hot + " end")] * 2 + [(1, first), (7, first + " more"), (None, None), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = substring_dedup(docs, group_bytes=100_000)
    by = {(r.id, r.n_words, r.kept_text): r.n for r in out.groupBy("id", "n_words", "kept_text").agg(F.count("*").alias("n")).collect()}
    assert by == {(5, 400, hot): 3000, (None, 400, ""): 700, (9, 401, "end"): 2, (1, 60, first): 1, (7, 61, "more"): 1, (None, 0, ""): 2, (3, 0, ""): 1}
    assert set(out.columns) == {"id", "n_words", "kept_text", "spans"}


def test_long_texts_are_learnt_from_in_part():
    coord = np.arange(50).repeat(2)
    text = np.tile([0, 1], 50)
    order = np.lexsort((coord, text))
    c, t = T.bounded(coord[order], text[order], 8)
    assert list(np.bincount(t)) == [8, 8] and all((np.diff(c[t == i]) > 0).all() for i in (0, 1))
    assert set(c[t == 0]) == set(np.argsort(H.mix(np.arange(50, dtype=np.uint64)))[:8])
    same = T.bounded(coord[order], text[order], 50)
    assert (same[0] == coord[order]).all() and (same[1] == text[order]).all()


def test_one_training_row_an_id(spark):
    """Rows that repeat a labelled id teach once, the one with the least key."""
    one = [(i, prose(i, 30) + (" vile words here" if i % 3 == 0 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    plain = T.learnt(spark.createDataFrame(one, "doc_id long, text string"), labels)
    many = spark.createDataFrame(one * 20, "doc_id long, text string").repartition(5)
    assert plain and T.learnt(many, labels) == plain
    two = spark.createDataFrame(one + [(i, t + " other") for i, t in one], "doc_id long, text string")
    assert T.learnt(two, labels) == T.learnt(two.orderBy(F.desc("text")), labels)
    few = T.train(two, labels, row_features=3).collect()
    assert few is not None
