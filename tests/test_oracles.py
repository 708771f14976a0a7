"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    cols = sorted(df.columns)
    rows = df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)
    return cols, sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_same_as_sql(spark, duck, name):
    got, want = plain(entry.queries()[name](spark, SF).toPandas()), plain(duck.execute(entry.oracle_sql()[name]).df())
    assert got == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_linear_ranker_is_the_plain_fit(spark):
    import numpy as np

    from lightsift.operators.learn import fit_ranker

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 4)), np.arange(200) % 2
    x[y == 1, 2] += 2
    d = x[y == 1] - x[y == 0]
    pairs = spark.createDataFrame([([float(v) for v in r],) for r in d], "d array<double>").repartition(3)
    w = np.zeros(4)
    for _ in range(30):
        w = w * (1 - 1e-4) + (d / (1 + np.exp(d @ w))[:, None]).mean(axis=0)
    assert np.allclose(fit_ranker(pairs, 4), w, atol=1e-9)
    assert entry.queries()["ranknet_scores"](spark, SF).where("score IS NULL").count() == 0
