"""The corpus pipeline: documents in, token ids out. Every stage reads all rows of the one before it.

A stage's result has to be written before the next stage is called, which first removes
the tables that the last one kept in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import golay, mixing, pieces, radix, repetition
from feedloom.llm.common import documents
from feedloom.session import next_scratch, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    next_scratch(spark)
    return repetition.keep(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of each group with the same text but for white space."""
    next_scratch(spark)
    return radix.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    next_scratch(spark)
    return golay.near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus mixed to its sources' weights: documents repeated, left out, or cut at the edge of a quota."""
    next_scratch(spark)
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row of the mixed corpus, and whether they decode to its text."""
    next_scratch(spark, last=True)
    return pieces.ids_of(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokens),
]

ORACLE_SQL = None


def written(docs: DataFrame) -> DataFrame:
    """``docs`` as Parquet in the shared folder, read again."""
    path = shared_folder(docs.sparkSession)
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
