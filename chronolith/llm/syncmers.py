"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer if its smallest inner s-mer (by hash; of equals any) lies at its left or right
edge. That depends on the k-mer alone, so the same passage has the same anchors wherever it stands. A fingerprint holds
all anchors with all their places, so any passage of some length that two texts share leaves anchors in both. Likeness
pairs the n-th place of an anchor in one text with its n-th in the other; a pair counts as shared if it keeps the order
of the other shared ones (longest increasing chain), so scattered chance matches don't add up. Twice the shared over the
anchors of both: 1 for equal texts, about a half for texts that agree in a half of their length.

Texts without a syncmer, those shorter than k among them, use themselves as the one anchor; empty and null texts have an
empty fingerprint, like each other only. Fingerprints are strings of ``hash:place`` in hexadecimal, in order of place.
Ids are integers; rows without one come first, rows of one id go by their texts; an empty table gives an empty one. A very
long text is looked at ``CHUNK`` characters at a time, so a task holds the text, its anchors and arrays of one chunk.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, U64, arrow_limits, mix, powers, sliding

#: Characters of a k-mer and of its inner s-mers: the production parameters.
K, S = 12, 5
#: Characters of a text that are hashed at a time.
CHUNK = 1 << 20
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of code points."""
    h = np.zeros(len(codes) - n + 1, U64)
    for j in range(n):
        h += codes[j : len(codes) - n + 1 + j] * powers(BASE, n)[j]
    return mix(h)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U64) + U64(1)


def _syncmers(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inner = _grams(codes, s)
    least = sliding(inner, k - s + 1, np.minimum)
    places = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least))
    whole = np.zeros(len(places), U64)
    for j in range(k):
        whole += codes[places + j] * powers(BASE, k)[j]
    return mix(whole), places


def syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the closed syncmers of a text; a text without any is one anchor."""
    parts = [_syncmers(_codes(text[a : a + CHUNK + k - 1]), k, s) for a in range(0, len(text), CHUNK)]
    hashes = np.concatenate([h for h, _ in parts] or [np.zeros(0, U64)])
    places = np.concatenate([p + i * CHUNK for i, (_, p) in enumerate(parts)] or [np.zeros(0, np.int64)])
    if len(places) or not text:
        return hashes, places
    codes = _codes(text)
    return mix((codes * powers(BASE, len(codes))).sum(dtype=U64, keepdims=True)), np.zeros(1, np.int64)


def sketch(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """All anchors, by hash and place: hashes of 32 bits (eight digits) and places."""
    hashes, places = syncmers(text, k, s)
    both = (hashes >> U64(32) << U64(32)) | places.astype(U64)
    both.sort()
    return both >> U64(32), (both & U64(0xFFFFFFFF)).astype(np.int64)


def render(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    both = (fingerprint[1].astype(U64) << U64(32)) | fingerprint[0].astype(U64)
    if not len(both):
        return ""
    both.sort()
    hashes, places = both & U64(0xFFFFFFFF), both >> U64(32)
    width = max(1, (int(places[-1]).bit_length() + 3) // 4)
    out = np.full((len(both), 10 + width), ord(" "), np.uint8)
    for j in range(8):
        out[:, j] = HEX[((hashes >> U64(28 - 4 * j)) & U64(15)).astype(np.intp)]
    out[:, 8] = ord(":")
    shown = np.ones(out.shape, bool)
    for j in range(width):
        rest = places >> U64(4 * (width - 1 - j))
        out[:, 9 + j] = HEX[(rest & U64(15)).astype(np.intp)]
        if j < width - 1:
            shown[:, 9 + j] = rest > 0
    return out[shown][:-1].tobytes().decode()


def parse(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((int(h, 16), int(p, 16)) for h, p in (x.split(":") for x in fingerprint.split()))
    return np.array([h for h, _ in pairs], U64), np.array([p for _, p in pairs], np.int64)


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes in order, each with its number among the equal ones below it."""
    at = np.arange(len(hashes))
    first = np.maximum.accumulate(np.where(np.append(True, hashes[1:] != hashes[:-1]), at, 0))
    return (hashes << U64(32)) | (at - first).astype(U64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; see the module."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    own, other = _numbered(a[0]), _numbered(b[0])
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    shared = other[at] == own
    places = b[1][at[shared]][np.argsort(a[1][shared])]
    chain: list[int] = []
    for p in places.tolist():
        if not chain or p > chain[-1]:
            chain.append(p)
        else:
            chain[bisect_left(chain, p)] = p
    return 2 * len(chain) / (len(own) + len(other))


# ---------------------------------------------------------------- operator

#: Rows of a stretch of ids, and the most stretches (their first ids are all that the driver learns). Past the most, a
#: stretch gets longer, but it is sorted by Spark, which spills, and read row by row.
STRETCH_ROWS, STRETCHES = 4_000, 16_384
LEAST = -(1 << 63)


def _stretch(bounds: list[int]) -> Column:
    """Number of bounds up to the order column: counted in two levels, so a row looks at about 2 * sqrt(n) of them."""
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    outer = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda x: x <= F.col("o")))
    own = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.greatest(outer, F.lit(1)))
    return F.when(outer == 0, 0).otherwise((outer - 1) * width + F.size(F.filter(own, lambda x: x <= F.col("o"))))


def with_next(rows: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text)`` dealt to stretches of ascending ids, each sorted, and closed by the next stretch's head.

    ``tail`` marks the rows that only close a stretch; the last stretch is closed by the first one's head. Nulls come
    first, and rows of one id go by their text.
    """
    ordered = rows.withColumn("o", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)))
    count = ordered.count()
    n = min(STRETCHES, max(1, math.ceil(count / STRETCH_ROWS)))
    cuts = ordered.agg(F.percentile_approx("o", [i / n for i in range(1, n)] or [0.5], 50_000)).first()[0] if count else []
    placed = ordered.withColumn("stretch", _stretch(sorted(set(cuts or [0]))))
    heads = sorted(tuple(x) for x in placed.groupBy("stretch").agg(F.min("o")).collect())
    before = {heads[i][1]: heads[i - 1][0] for i in range(len(heads))}
    previous = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("o")) if before else F.lit(None).cast("int")
    both = placed.withColumn("at", F.explode(F.filter(F.array(F.struct(F.col("stretch"), F.lit(0).alias("tail")), F.struct(previous.alias("stretch"), F.lit(1).alias("tail"))), lambda x: x["stretch"].isNotNull())))
    both = both.select("at.stretch", "at.tail", "o", "doc_id", "text")
    # a stretch is a task: a hash of so few keys would put several into one
    return both.repartitionById(max(n, 1), F.col("stretch").cast("int")).sortWithinPartitions("stretch", "tail", "o", "text")


def _compare(k: int, s: int, id_type: pa.DataType):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, open_, out = None, None, []

        def row(now: tuple, text: str, fingerprint: tuple) -> tuple:
            doc_id, own_text, own = now
            n = len(own_text)
            edited = own_text[: n - n // 2] + text[: n // 2]
            other = sketch(edited, k, s)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return doc_id, n, digest, render(own), render(other), likeness(own, other), likeness(own, fingerprint)

        for batch in batches:
            stretches, tails, ids, texts = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for at, tail, doc_id, text in zip(stretches, tails, ids, texts, strict=True):
                if at != stretch:
                    stretch, open_ = at, None
                if tail and open_ is None:
                    continue
                fingerprint = sketch(text, k, s)
                if open_ is not None:
                    out.append(row(open_, text, fingerprint))
                open_ = None if tail else (doc_id, text, fingerprint)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """For every row: its fingerprint, that of its text edited by the next one's head, and likenesses to both.

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The edited text
    has its last half (floor) of characters replaced by as many, or all, of the next row's first ones.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(rows).mapInArrow(_compare(k, s, pa.int32() if id_type == "int" else pa.int64()), schema)
