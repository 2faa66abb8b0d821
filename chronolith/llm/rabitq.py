"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

1. Equal vectors are one class. Pivots are a bounded sample of the classes (``PIVOTS`` at most, chosen by a hash, and
   thinned so that no two are alike: a crowd of near copies gives one pivot); every class is indexed at its ``PROBES``
   nearest. Two vectors of cosine 0.9 share a pivot with near certainty (the tests measure it).
2. In a cell, each vector is rotated at random ``ROTATIONS`` times; the signs are its codes, and the inner product of
   the code with the rotated vector itself is kept. A query is quantised to four bit planes; population counts of AND
   give its product with a code, which divided by the kept factor is an unbiased estimate of the cosine. The bound of
   ``SIGMAS`` standard deviations around the mean of the estimates decides which pairs are computed anew, in doubles.
3. A pair counts in the first cell that both share. Tasks return link counts and spanning stars, never pairs; a cell
   with many members is worked on as pairs of blocks.

Ids are integers. Vectors that are null, zero, or hold null or non-finite components link with nothing; so do rows without an id, whose
component is null. Vectors of different lengths never link. Equal rows count once as the same vector. Extra columns are
passed by; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, arrow_limits, connected_components, union_find

PIVOTS, PER_PIVOT, PROBES = 4096, 64, 10
#: Sampled pivots closer than this to one already taken are left out.
ALIKE = 0.8
ROTATIONS, PLANES, SIGMAS = 4, 4, 6.0
#: Members of a cell that one task compares; larger cells are cut into blocks of half of that.
CELL = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotations(dims: int) -> np.ndarray:
    """Random orthogonal matrices over ``dims`` padded to whole 64-bit words; the same for every task."""
    rng = np.random.default_rng(dims)
    size = -(-dims // 64) * 64
    return np.stack([np.linalg.qr(rng.standard_normal((size, size)))[0][:dims] for _ in range(ROTATIONS)])


class Codes:
    """Codes and correction factors of unit vectors, and estimates of their products with each other."""

    def __init__(self, unit: np.ndarray):
        turns = rotations(unit.shape[1])
        self.size = turns.shape[2]
        self.rotated = np.einsum("nd,rds->rns", unit, turns)
        bits = np.packbits(self.rotated > 0, axis=2, bitorder="little")
        self.codes = bits.view(U64)
        self.ones = np.bitwise_count(self.codes).sum(2, dtype=np.int32)
        self.factor = np.abs(self.rotated).sum(2) / math.sqrt(self.size)

    def planes(self, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Four-bit planes of rotated queries, with what undoes the quantisation."""
        q = self.rotated[:, rows]
        low = q.min(2)
        step = np.maximum(q.max(2) - low, 1e-12) / (2**PLANES - 1)
        level = np.rint((q - low[..., None]) / step[..., None]).astype(np.uint8)
        planes = np.stack([np.packbits((level >> b) & 1, axis=2, bitorder="little").view(U64) for b in range(PLANES)])
        return planes, low, step, step * level.sum(2) + low * self.size

    def estimate(self, rows: slice, others: slice) -> tuple[np.ndarray, np.ndarray]:
        """(mean of the unbiased estimates, its standard deviation) for each query row and other vector."""
        planes, low, step, total = self.planes(rows)
        mean, variance = 0.0, 0.0
        for r in range(ROTATIONS):
            code, factor = self.codes[r, others], self.factor[r, others]
            counts = 0.0
            for b in range(PLANES):
                both = np.bitwise_count(planes[b, r][:, None, :] & code[None, :, :])
                counts = counts + (both[:, :, 0] if both.shape[2] == 1 else both.sum(2, dtype=np.int32)) * np.float32(1 << b)
            chosen = step[r][:, None] * counts + low[r][:, None] * self.ones[r, others]
            mean = mean + (2 * chosen - total[r][:, None]) / math.sqrt(self.size) / factor
            variance = variance + (1 - factor**2) / (factor**2 * max(1, self.size - 1)) + (step[r][:, None] ** 2 / 3) / factor**2
        return mean / ROTATIONS, np.sqrt(variance) / ROTATIONS


def links(vectors: np.ndarray, cells: np.ndarray, cell: int, block: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a task, i < j, of at least the threshold, whose first shared cell is this one."""
    unit = _unit(vectors)
    codes = Codes(unit)
    norm = np.sqrt((vectors * vectors).sum(1))
    found = []
    for a in range(0, len(unit), 128):
        mean, deviation = codes.estimate(slice(a, a + 128), slice(a, None))
        near = mean + SIGMAS * deviation >= threshold
        near &= np.arange(near.shape[1]) > np.arange(near.shape[0])[:, None]
        if across:
            near &= block[a : a + 128, None] != block[a:]
        i, j = np.nonzero(near)
        for at in range(0, len(i), 1 << 15):
            x, y = i[at : at + (1 << 15)] + a, j[at : at + (1 << 15)] + a
            cosine = np.einsum("nd,nd->n", vectors[x], vectors[y]) / (norm[x] * norm[y])
            x, y = x[cosine >= threshold], y[cosine >= threshold]
            shared = cells[x][:, :, None] == cells[y][:, None, :]
            first = np.where(shared.any(2), cells[x], np.iinfo(np.int64).max).min(1)
            found.append(np.stack([x[first == cell], y[first == cell]]))
    return tuple(np.concatenate(found, 1)) if found else (np.zeros(0, np.int64),) * 2


def _matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    taken = column.take(pa.array(rows))
    return taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _index(pivots: dict[int, np.ndarray], base: dict[int, int]):
    """Classes (rep, times, vector) to one row for each of their cells, with the list of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                if int(dims) not in pivots:  # lengths that the sample didn't meet have one cell of their own
                    near = np.full((len(rows), 1), -int(dims), np.int64)
                else:
                    p = pivots[int(dims)]
                    k = min(PROBES, len(p))
                    score = _unit(_matrix(vectors, rows)) @ p.T
                    near = np.sort(np.argpartition(-score, k - 1, axis=1)[:, :k], axis=1).astype(np.int64) + base[int(dims)]
                taken = pa.array(np.repeat(rows, near.shape[1]))
                lists = pa.array(np.repeat(near, near.shape[1], axis=0).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), batch.column(0).take(taken), batch.column(1).take(taken), vectors.take(taken), lists], names=["cell", "rep", "times", "vector", "cells"])

    return run


def _solve(threshold: float):
    """Rows (cell, lower, upper, block, rep, times, vector, cells) sorted by the first three to (rep, links, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, parts: list[tuple]) -> pa.RecordBatch:
            reps, times, blocks, vectors, cells = (np.concatenate(x) for x in zip(*parts, strict=True))
            i, j = links(vectors, cells, key[0], blocks, key[1] != key[2], threshold)
            counts = np.zeros(len(reps), np.int64)
            np.add.at(counts, i, times[j])
            np.add.at(counts, j, times[i])
            order = np.argsort(reps, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            root = reps[order][union_find(len(reps), place[i], place[j])][place]
            some = counts > 0
            return pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(counts[some]), pa.array(root[some])], names=["rep", "links", "root"])

        key, parts = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for rows in np.split(np.arange(batch.num_rows), cuts):
                group = tuple(keys[rows[0]].tolist())
                if group != key:
                    if parts:
                        yield done(key, parts)
                    key, parts = group, []
                block, rep, times = (batch.column(i).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4, 5))
                parts.append((rep, times, block, _matrix(batch.column(6), rows), _matrix(batch.column(7), rows).astype(np.int64)))
        if parts:
            yield done(key, parts)

    return run


def sample_pivots(classes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Unit pivots by vector length, thinned; at most PIVOTS rows come to the driver."""
    wanted = min(PIVOTS, max(1, math.ceil(count / PER_PIVOT)))
    rows = [r[0] for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("vector").collect()]
    out = {}
    for dims in sorted({len(r) for r in rows}):
        unit = _unit(np.array([r for r in rows if len(r) == dims], float))
        kept: list[np.ndarray] = []
        for x in unit:
            if not kept or (np.stack(kept) @ x).max() < ALIKE:
                kept.append(x)
        out[dims] = np.stack(kept)
    return out


def embedding_dedup(embeddings: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row: vectors of cosine >= ``threshold`` link."""
    spark = embeddings.sparkSession
    arrow_limits(spark)
    scratch = Scratch(spark, "rabitq")
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.col("vec_id").isNotNull()
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.withColumn("vector", F.when(good & finite & F.exists("vector", lambda x: x != 0), F.col("vector")))
    classes = rows.where("vector is not null").select("vec_id", "vector").distinct().groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"))
    classes = scratch.save(classes, "classes")
    pivots = sample_pivots(classes, classes.count())
    base, at = {}, 0
    for dims, p in pivots.items():
        base[dims], at = at, at + len(p)

    vector = dict(classes.dtypes)["vector"]
    indexed = classes.select("rep", "times", "vector").mapInArrow(_index(pivots, base), f"cell long, rep long, times long, vector {vector}, cells array<long>")
    indexed = scratch.save(indexed, "index")
    sizes = indexed.groupBy("cell").count().select("cell", F.when(F.col("count") <= cell, 1).otherwise(F.ceil(F.col("count") / (cell / 2))).cast("int").alias("blocks"))
    # cells of pivots are PIVOTS at most; those of lengths that the sample missed go through a plain join
    placed = indexed.where("cell >= 0").join(F.broadcast(sizes.where("cell >= 0")), "cell").unionByName(indexed.where("cell < 0").join(sizes.where("cell < 0"), "cell"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cell", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), "block", "rep", "times", "vector", "cells")
    placed = placed.repartition("cell", "lower", "upper").sortWithinPartitions("cell", "lower", "upper")
    found = scratch.save(placed.mapInArrow(_solve(threshold), "rep long, links long, root long"), "found")

    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch, "parts").toDF("rep", "label")
    known = classes.join(counts, "rep", "left").join(component, "rep", "left")
    known = known.select("vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("label", "rep").alias("label"))
    known = scratch.save(known, "known")
    scratch.drop("index", "found", "classes")
    out = rows.join(known, "vector", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("label", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
