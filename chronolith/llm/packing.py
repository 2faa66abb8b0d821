"""Length buckets with least padding, and batches of a token budget inside each bucket.

Texts are cut to pieces of at most ``max_tokens`` words; a text's pieces, one after another, are the text again. Over the
histogram of all piece lengths - never more than
``max_tokens`` numbers, whatever the input - dynamic programming finds the ``buckets`` upper bounds that minimise the
padding in total. A bucket's batches hold as many pieces as the budget has room for at the bucket's bound, so all are
full but the last. Places in a bucket follow from counts of its slices (prefix sums) and row numbers inside a slice. A
bucket has slices by the bytes of its pieces, so one that holds a third of them has as many more; none is sorted as a whole.

Null and wordless texts make one piece of no tokens, outside all buckets. Rows of one id, or of none, are packed one by one,
equal rows too. Extra columns are passed by; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits, map_arrow, text_bytes

MAX_TOKENS, BUCKETS, BUDGET = 2048, 16, 16_384
#: Bytes of text in a slice of a bucket, about, and what a piece counts beside its text: slices of long pieces have fewer.
SLICE_BYTES, PIECE_BYTES = 2 << 20, 64
#: Bytes of text that are looked at together.
CHUNK = 1 << 22


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin in texts that lie one behind the other; they stand between spaces, tabs and line ends."""
    found = [offsets[:-1][offsets[:-1] < len(data)]]
    found[0] = found[0][(data[found[0]] != 32) & ((data[found[0]] < 9) | (data[found[0]] > 13))]
    for a in range(1, len(data), CHUNK):
        own = data[a - 1 : a + CHUNK]
        solid = (own != 32) & ((own < 9) | (own > 13))
        found.append(np.flatnonzero(solid[1:] & ~solid[:-1]) + a)
    return np.unique(np.concatenate(found))


def _pieces(max_tokens: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        starts = word_starts(data, offsets)
        at = np.searchsorted(starts, offsets)
        words = np.diff(at)
        several = np.maximum(1, -(-words // max_tokens))
        rows = np.repeat(np.arange(len(words)), several)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(several) - several, several)
        first = piece * max_tokens
        cuts = offsets[rows]
        later = piece > 0
        cuts[later] = starts[at[rows[later]] + first[later]]
        text = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
        n_bytes = np.diff(np.append(cuts, len(data)))
        arrays = [batch.column(0).take(pa.array(rows)), pa.array(piece), pa.array(first), pa.array(np.minimum(words[rows] - first, max_tokens)), pa.array(n_bytes), text.cast(pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "first_token", "n_tokens", "n_bytes", "text"])

    return fn


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets, of least total padding; the last is the largest length.

    cost(i, j) = bound j times the pieces in (i, j] less their tokens; best(k, j) = min over i of best(k-1, i) + cost(i, j).
    """
    if not len(lengths):
        return []
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    n = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    d, k = len(lengths), min(buckets, len(lengths))
    best = np.full((k + 1, d + 1), np.iinfo(np.int64).max // 4)
    best[0, 0] = 0
    back = np.zeros((k + 1, d + 1), np.int64)
    for j in range(1, d + 1):
        cost = lengths[j - 1] * (n[j] - n[:j]) - (tokens[j] - tokens[:j])
        total = best[:k, :j] + cost
        back[1:, j] = total.argmin(1)
        best[1:, j] = total.min(1)
    used = int(best[1:, d].argmin()) + 1
    bounds, j = [], d
    for b in range(used, 0, -1):
        bounds.append(int(lengths[j - 1]))
        j = int(back[b, j])
    return bounds[::-1]


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``(doc_id, piece, first_token, n_tokens, bucket_tokens, batch, slot, n_padding, text)`` for every piece."""
    arrow_limits(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, piece long, first_token long, n_tokens long, n_bytes long, text string"
    # the partition tells equal rows apart; it is written, so all that follows sees the same
    spread = F.xxhash64("doc_id", "piece", F.spark_partition_id()).alias("spread")
    pieces = scratch.save(map_arrow(rows, _pieces(max_tokens), schema).select("*", spread), "pieces")

    histogram = pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)), F.sum("n_bytes")).collect()  # max_tokens rows at most
    bounds = optimal_bounds(np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64), buckets)
    held = {b: sum(r[1] * PIECE_BYTES + r[2] for r in histogram if low < r[0] <= b) for low, b in zip([0, *bounds], bounds, strict=False)}
    bucket = F.lit(None).cast("long")
    slices = F.lit(1)
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
        slices = F.when(F.col("n_tokens") <= b, F.lit(-(-held[b] // slice_bytes))).otherwise(slices)
    empty = F.col("n_tokens") == 0
    placed = pieces.withColumn("bucket_tokens", F.when(~empty, bucket)).withColumn("slice", F.pmod("spread", slices).cast("int"))

    full = placed.where(~empty)
    counts = full.groupBy("bucket_tokens", "slice").count()
    before = Window.partitionBy("bucket_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket_tokens", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket_tokens", "slice").orderBy("n_tokens", "doc_id", "piece")
    numbered = full.withColumn("row", F.row_number().over(inside)).join(offsets, ["bucket_tokens", "slice"])
    place = F.col("offset") + F.col("row") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_tokens")))
    packed = numbered.select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket_tokens", F.floor(place / room).alias("batch"), (place % room).alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("n_padding"), "text"
    )
    nothing = F.lit(None).cast("long")
    return packed.union(placed.where(empty).select("doc_id", "piece", "first_token", "n_tokens", nothing, nothing, nothing, nothing, "text"))
