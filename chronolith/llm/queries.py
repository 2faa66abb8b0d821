"""The operators of this subpackage as queries over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .licenses import license_scan
from .minhash_dedup import minhash_dedup
from .oracles import ORACLE_SQL
from .packing import pack
from .rabitq import embedding_dedup
from .suffix_dedup import suffix_array_dedup
from .syncmers import fingerprints
from .toxicity import toxicity
from .transcripts import recover_roles
from .warc import warc_round_trip

__all__ = ["ORACLE_SQL", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rabitq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), 0.9)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), percent=85)


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("n_offending", F.size("offending")).drop("offending")


def op8_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recover_roles(table(spark, sf_dir, "conversations"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rabitq_dedup": op1_rabitq_dedup,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_length_buckets": op3_length_buckets,
    "op4_warc_index": op4_warc_index,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_syncmer_fingerprints": op6_syncmer_fingerprints,
    "op7_toxicity": op7_toxicity,
    "op8_transcript_roles": op8_transcript_roles,
    "op9_license_scan": op9_license_scan,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}
