"""The registered queries of this package and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import alignment, dac, entropy, golay, hosts, merkle, mixing, pieces, radix, repeats, repetition, ring, transducer
from feedloom.llm.common import documents
from feedloom.session import shared_folder


def op1_repetition(spark: SparkSession, path: str) -> DataFrame:
    return repetition.repetition(documents(spark, path))


def op2_ring_shards(spark: SparkSession, path: str) -> DataFrame:
    """Law ``rows``: with no slack every shard has the floor or the ceiling of the mean."""
    return ring.assign(documents(spark, path), shards=16, vnodes=128, slack=0.0).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_dac_tokens(spark: SparkSession, path: str) -> DataFrame:
    folder = shared_folder(spark)
    dac.write(documents(spark, path), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return dac.tokens_of(dac.read(spark, folder))


def op4_host_words(spark: SparkSession, path: str) -> DataFrame:
    return hosts.judge(spark.read.parquet(f"{path}/pages.parquet"))


def op5_suffix_repeats(spark: SparkSession, path: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, path))


def op6_golay_simhash(spark: SparkSession, path: str) -> DataFrame:
    return golay.near_groups(documents(spark, path))


def op7_piece_round_trip(spark: SparkSession, path: str) -> DataFrame:
    return pieces.round_trip(documents(spark, path), public_tokenizers.path("piece_bpe_32k.model"))


def op8_radix_dedup(spark: SparkSession, path: str) -> DataFrame:
    return radix.classes(documents(spark, path).select("doc_id", "text"))


def op9_sainte_lague_mix(spark: SparkSession, path: str) -> DataFrame:
    return mixing.taken(documents(spark, path))


def op10_entropy_secrets(spark: SparkSession, path: str) -> DataFrame:
    return entropy.scan(documents(spark, path))


def op11_token_alignment(spark: SparkSession, path: str) -> DataFrame:
    return alignment.align(
        documents(spark, path), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.PATTERN,
    )


def op12_bpe_transducer(spark: SparkSession, path: str) -> DataFrame:
    return transducer.round_trip(documents(spark, path), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_merkle_manifest(spark: SparkSession, path: str) -> DataFrame:
    return merkle.manifest_check(documents(spark, path), shared_folder(spark))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repetition, op2_ring_shards, op3_dac_tokens, op4_host_words, op5_suffix_repeats, op6_golay_simhash, op7_piece_round_trip,
        op8_radix_dedup, op9_sainte_lague_mix, op10_entropy_secrets, op11_token_alignment, op12_bpe_transducer,
        op13_merkle_manifest,
    )
}
#: Texts are equal after white space is deleted.
OP8_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, row_number() OVER () AS nth,
           regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST, nth)
"""

ORACLE_SQL: dict[str, str] = {
    "op8_radix_dedup": OP8_SQL, "op9_sainte_lague_mix": mixing.oracle_sql(), "op10_entropy_secrets": entropy.oracle_sql(),
}
