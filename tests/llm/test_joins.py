"""Tables that grow with the corpus are not broadcast, however small Spark takes them for."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pytest

from lightsift.llm.common import scratch_path, written
from lightsift.llm.simhash_dedup import links, simhash_dedup, without_copies
from lightsift.llm.token_store import verify_tokens, write_tokens


def broadcasts(df) -> list[str]:
    """Broadcast exchanges of the plan that df ended with."""
    df.collect()
    return re.findall(r"BroadcastExchange.*", df._jdf.queryExecution().executedPlan().toString())


def test_points_at_their_anchors_are_not_broadcast(spark):
    """Each point comes back 61 times from Python, which Spark's estimate doesn't know."""
    points = written(spark.createDataFrame([(int(f),) for f in np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 3000)], "fp long"), "points")
    found = links(points)
    assert broadcasts(found) == []


@pytest.fixture(scope="module")
def alike(spark):
    """Few and short bytes in a file, many rows: equal documents."""
    return spark.range(2000).selectExpr("id AS doc_id", "repeat('the same words again ', 50) AS text", "'web' AS source")


def test_documents_are_not_broadcast(alike):
    got = simhash_dedup(alike)
    assert broadcasts(got) == [] and [r.id for r in got.where("best").collect()] == [0]
    stay = without_copies(alike)
    assert broadcasts(stay) == [] and [r.doc_id for r in stay.collect()] == [0]


def test_chunks_are_not_broadcast(spark, alike):
    path = scratch_path(spark, "tokens")
    write_tokens(alike, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    got = verify_tokens(spark, path)
    assert broadcasts(got) == [] and got.count() == 2000 and got.select("crc").distinct().count() == 1
