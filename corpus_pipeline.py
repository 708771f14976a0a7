"""Corpus pipeline: each stage calls one operator, and its result is written and read again as the next one's documents.

All stages: null texts count as empty and null ids are legal; an empty table gives an empty one; other columns than doc_id,
text and source pass through untouched, whatever they are called (the last stage returns its own columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightsift.llm.common import scratch_path, written
from lightsift.llm.decontaminate import clean
from lightsift.llm.mixing import mix_documents
from lightsift.llm.queries import END_ID, table
from lightsift.llm.simhash_dedup import without_copies
from lightsift.llm.token_store import verify_tokens, write_tokens
from lightsift.llm.toxicity import accepted, learnt


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the weights are learnt from the labels of the documents given.

    Without usable labels (none, all null, or none outside of the held-out fold) nothing is learnt and all documents stay.
    Rows that repeat a text stay or go together.
    """
    return accepted(docs, learnt(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of linked SimHash fingerprints; of rows that repeat id and
    text the least by all columns in order."""
    return without_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window (or whole shorter item) with the benchmark. Repeated rows stay or go together."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for: not at all, once or twice. Rows that repeat an id share its hash, so
    they are taken alike, each for itself; a null source is a source."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of the mixture, read back: doc_id, start, n_tokens and ids_crc32 of each copy, repeats each for itself
    (equal rows stand in any order among themselves)."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return verify_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix), ("token_store", tokens)]
#: A learnt classifier and XXH64 fingerprints have no SQL; tests/llm hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
