"""Streaming ingest: late-tolerant deduplication and windowed counts, and micro-batches into the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import hash_id
from ..plans.engine import TemporalGraph


def new_documents(stream: DataFrame, text_col: str = "doc", time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """Documents of a stream, each content once within the watermark."""
    keyed = stream.withColumn("doc_id", hash_id(F.col(text_col), "doc-")).withColumn(time_col, F.col(time_col).cast("timestamp"))
    return keyed.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["doc_id"])


def window_counts(stream: DataFrame, key: str, time_col: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per key and window of event time."""
    rows = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return rows.groupBy(F.window(time_col, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def insert_stream(stream: DataFrame, engine: TemporalGraph, checkpoint: str) -> StreamingQuery:
    """Micro-batches of ``(title, doc)`` into the engine; its own deduplication makes a repeated batch harmless."""
    return stream.writeStream.foreachBatch(lambda batch, _: engine.insert(batch.select("title", "doc"))).option("checkpointLocation", checkpoint).start()
