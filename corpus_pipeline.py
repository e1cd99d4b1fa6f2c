"""Corpus pipeline over ``documents``: quality, repeated lines, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. The first four return the columns of
``documents``; the last returns doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers) and the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotloom.llm import bpe, decontam, linededup, quality, simhash
from spotloom.llm.common import read
from spotloom.llm.queries import tokenizer
from spotloom.session import ship_package, stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from ``labels`` and the documents themselves."""
    return quality.keep_good(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines stay at their first place only; ``n_chars`` follows the text."""
    out = linededup.deduplicate_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicate(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the text they decode to."""
    return bpe.round_trip(docs, *tokenizer())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("byte-level BPE", encode_and_decode),
]

#: Trained models, fingerprints and edit distances are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
