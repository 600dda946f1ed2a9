"""The corpus pipeline: each stage filters, cleans, mixes or encodes what its predecessor kept.

Null and empty texts have no words, so the quality rules reject them; the other stages keep them if
they are given any. Repeated rows are one document for the near-duplicate stage. An empty table
gives an empty result of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, minhash, mixing, quality, secretscan
from corpusmill.llm.base import table
from corpusmill.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return minhash.one_of_each(docs, length=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of every secret; ``n_chars`` follows."""
    return secretscan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the text they decode to."""
    tokens, pattern = bpe.public_vocabulary()
    return bpe.round_trip(docs, tokens, pattern)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_quality),
    ("near duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("source mix", mix_sources),
    ("byte-level BPE", encode_bpe),
]

# Learned rules and merge ranks have no SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``.

    Every stage is written to the shared folder and read again, so that no stage is computed twice
    and a lost executor costs tasks of one stage only. The folder goes when the last stage is done.
    """
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return scratch.finish(STAGES[-1][1](spark, docs, sf_dir))
