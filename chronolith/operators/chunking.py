"""Text chunking: token windows with titles, separator-aware splits, overlaps, and keyed chunk tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_id, tokens
from .window import last_write


def token_windows(docs: DataFrame, size: int = 1200, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text", title: Column | None = None) -> DataFrame:
    """``(full_doc_id, chunk_order_index, tokens, content)``: windows at a fixed stride, each behind the title's tokens.

    The stride is what the title leaves of ``size`` less the overlap, one at least; windows start at every stride below
    the number of tokens, so the last may repeat an overlap only. A title of ``size`` tokens or more fails.
    """
    toks = tokens(F.coalesce(F.col(text_col), F.lit("")))
    head = tokens(title) if title is not None else F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("full_doc_id"), toks.alias("t"), head.alias("h"))
    room = F.lit(size) - F.size("h")
    rows = rows.withColumn("room", F.when(room > 0, room).otherwise(F.raise_error(F.lit("a title leaves no room in its chunks")).cast("int")))
    rows = rows.withColumn("step", F.greatest(F.lit(1), F.col("room") - overlap)).where(F.size("t") > 0)
    rows = rows.select("*", F.posexplode(F.sequence(F.lit(0), F.size("t") - 1, F.col("step"))).alias("chunk_order_index", "start"))
    content = F.array_join(F.concat("h", F.slice("t", F.col("start") + 1, F.col("room"))), " ")
    count = F.least(F.lit(size), F.size("t") - F.col("start") + F.size("h"))
    return rows.select("full_doc_id", "chunk_order_index", count.alias("tokens"), content.alias("content"))


def coded_windows(
    docs: DataFrame,
    encode: Callable[[str], list[int]],
    decode: Callable[[list[int]], str],
    size: int = 1200,
    overlap: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    title_col: str | None = None,
) -> DataFrame:
    """``token_windows`` of a tokenizer of one's own: ``encode`` and ``decode`` run in Arrow batches of whole documents."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for key, text, title in zip(pdf["k"], pdf["t"], pdf["h"], strict=True):
                toks, head = encode(text), encode(title)
                room = size - len(head)
                if room <= 0:
                    raise ValueError("a title leaves no room in its chunks")
                for i, a in enumerate(range(0, len(toks), max(1, room - overlap))):
                    own = head + toks[a : a + room]
                    out.append((key, i, len(own), decode(own)))
            yield pd.DataFrame(out, columns=["full_doc_id", "chunk_order_index", "tokens", "content"])

    title = F.coalesce(F.col(title_col), F.lit("")) if title_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), title.alias("h"))
    return rows.mapInPandas(run, f"full_doc_id {id_type}, chunk_order_index int, tokens int, content string")


def keyed_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks under the md5 of their content; of equal contents the last in order stays."""
    keyed = chunks.withColumn("chunk_id", hash_id(F.col("content"), "chunk-"))
    keyed = keyed.withColumn("__at", F.struct("full_doc_id", "chunk_order_index"))
    return last_write(keyed, ["chunk_id"], "__at").drop("__at")


def split_at(toks: Sequence[str], separators: Sequence[Sequence[str]], keep: str | bool = "end") -> list[list[str]]:
    """Pieces between separators (sequences of tokens), which stay at the end or start of a piece, or go."""
    pieces: list[list[str]] = [[]]
    i = 0
    while i < len(toks):
        hit = next((s for s in separators if s and list(toks[i : i + len(s)]) == list(s)), None)
        if hit is None:
            pieces[-1].append(toks[i])
            i += 1
            continue
        if keep in (True, "end"):
            pieces[-1] += hit
        pieces.append(list(hit) if keep == "start" else [])
        i += len(hit)
    return [p for p in pieces if p]


def merge_pieces(pieces: list[list[str]], size: int, overlap: int) -> list[list[str]]:
    """Pieces joined greedily up to ``size``; a lone oversized one is cut at a stride; each then begins with the end of
    the one before, as far as it fits."""
    chunks: list[list[str]] = []
    for p in pieces:
        if chunks and len(chunks[-1]) + len(p) <= size:
            chunks[-1] = chunks[-1] + p
        else:
            chunks.append(p)
    if len(chunks) == 1 and len(chunks[0]) > size:
        whole = chunks[0]
        cut = [whole[i : i + size] for i in range(0, len(whole), max(1, size - overlap))]
        return [c for c in cut if len(c) > overlap]
    if overlap <= 0:
        return chunks
    return chunks[:1] + [(before[-overlap:] + own)[:size] for before, own in zip(chunks, chunks[1:], strict=False)]


def separator_chunks(docs: DataFrame, separators: Sequence[str], size: int = 1200, overlap: int = 100, keep: str | bool = "end", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(full_doc_id, chunk_order_index, tokens, content)`` of texts split at separators of whole tokens.

    The greedy merge carries state from piece to piece, so it runs on Arrow batches of whole documents.
    """
    id_type = dict(docs.dtypes)[id_col]
    marks = [s.split() for s in separators]

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for key, toks in zip(pdf["k"], pdf["t"], strict=True):
                for i, chunk in enumerate(merge_pieces(split_at(list(toks), marks, keep), size, overlap)):
                    out.append((key, i, len(chunk), " ".join(chunk)))
            yield pd.DataFrame(out, columns=["full_doc_id", "chunk_order_index", "tokens", "content"])

    rows = docs.select(F.col(id_col).alias("k"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return rows.mapInPandas(run, f"full_doc_id {id_type}, chunk_order_index int, tokens int, content string")


def with_overlap(chunks: DataFrame, size: int, overlap: int, tokens_col: str = "toks") -> DataFrame:
    """Each chunk's token array behind the last tokens of the chunk before it in its document, cut to ``size``."""
    w = Window.partitionBy("full_doc_id").orderBy("chunk_order_index")
    before = F.coalesce(F.lag(tokens_col).over(w), F.array().cast("array<string>"))
    tail = F.slice(before, F.greatest(F.lit(1), F.size(before) - overlap + 1), overlap)
    return chunks.withColumn(tokens_col, F.when(F.lag(tokens_col).over(w).isNull(), F.col(tokens_col)).otherwise(F.slice(F.concat(tail, F.col(tokens_col)), 1, size)))
