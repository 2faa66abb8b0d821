"""The corpus pipeline: toxicity, near-duplicates, repeated passages, packing; each stage a table in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import Scratch
from chronolith.llm.minhash_dedup import one_of_each
from chronolith.llm.packing import pack
from chronolith.llm.suffix_dedup import suffix_array_dedup
from chronolith.llm.toxicity import without_toxic

#: Shorter than the operator's own default; passages of over fifty words that are shorter still are found by their words.
PASSAGE_BYTES, PASSAGE_WORDS = 256, 51


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, doesn't reject."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similarity 0.8 or more."""
    return one_of_each(docs, percent=80)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings or over fifty words that stand elsewhere too; characters cut in part go; other columns stay."""
    cut = suffix_array_dedup(docs, PASSAGE_BYTES, with_row=True, words=PASSAGE_WORDS)
    changed = F.col("n_removed") > 0
    own = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in length buckets and token-budget batches."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
