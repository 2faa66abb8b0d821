"""Document sources: gzipped JSON lines, text files, folders of text, question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of files that hold text; files without an ending do too (fixed values).
TEXT_ENDINGS = ["txt", "md", "rst", "text", "log"]

CORPUS = "cleaned_content string, raw_content string, company_name string, year string, quarter string"


def corpus(spark: SparkSession, path: str, limit: int | None = 3) -> DataFrame:
    """Rows of JSON lines, gzipped or not: the first ``limit`` in the file's order, or all."""
    rows = spark.read.schema(CORPUS).json(path)
    if limit is None:
        return rows
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.withColumn("__at", at).orderBy("__at").limit(limit).drop("__at")


def as_documents(rows: DataFrame) -> DataFrame:
    """``(title, doc)`` of corpus rows: cleaned text before raw, titles of company, year and quarter as far as known."""
    quarter = F.regexp_replace(F.upper("quarter"), "^Q", "")
    title = F.when(F.col("year").isNotNull() & F.col("quarter").isNotNull(), F.concat_ws(" ", "company_name", "year", F.concat(F.lit("Q"), quarter))).otherwise(F.concat_ws(" ", "company_name", "year"))
    return rows.select(title.alias("title"), F.coalesce("cleaned_content", "raw_content").alias("doc")).where("doc is not null")


def _texts(files: DataFrame, title) -> DataFrame:  # noqa: ANN001
    doc = F.regexp_replace(F.try_validate_utf8(F.col("content")), "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")
    return files.select(title.alias("title"), doc.alias("doc")).where("doc is not null and doc <> ''").orderBy("title")


def text_file(spark: SparkSession, path: str) -> DataFrame:
    """One document of a text file, named by the file without its ending; no row if there is nothing in it."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    return _texts(spark.read.format("binaryFile").load(path), name)


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """A document for each text file below a folder, by name: its path there without the ending. Files that are empty
    or no UTF-8 are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/").split("://")[-1]
    relative = F.element_at(F.split("path", "\\Q" + base.rstrip("/") + "/\\E"), -1)
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, "\\.([^.]*)$", 1))
    return _texts(files.where((ending == "") | ending.isin(TEXT_ENDINGS)), F.regexp_replace(relative, "\\.[^./]*$", ""))


def documents(spark: SparkSession, path: str, limit: int | None = 3) -> DataFrame:
    """``(title, doc)`` of whatever a path holds: JSON lines by their ending, a text file, else a folder."""
    from .stores import exists

    if not any(c in path for c in "*?[{") and not exists(spark, path):
        raise FileNotFoundError(path)
    low = path.lower()
    if low.endswith((".jsonl", ".json", ".jsonl.gz", ".json.gz", ".gz")):
        return as_documents(corpus(spark, path, limit))
    if low.endswith(tuple("." + e for e in TEXT_ENDINGS)):
        return text_file(spark, path)
    return text_folder(spark, path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """``(question, role, type)``."""
    return spark.read.schema("question string, role string, type string").json(path)
