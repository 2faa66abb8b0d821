"""Near-duplicate documents by MinHash bands and odd sketches, links confirmed on full shingle sets.

1. Every text gives its set of distinct word shingles (as 64-bit hashes), a MinHash signature, band keys of it, and an
   odd sketch: the samples folded into a parity bitmap, in which two samples of one value leave no trace, so the
   population count of the XOR of two sketches tells how many samples differ.
2. Texts of equal sets are one class from the start (sum and mixed sum of the set's hashes, 128 bits).
3. Classes that share a band are candidates. In each band bucket their sketches are compared, before any text is read: a
   pair whose sketches rule the similarity out (six standard deviations) is none. Each bucket gives a spanning forest of
   the pairs left, never the pairs; a bucket of over ``GROUP`` classes gives a star, its pairs are sifted in the next step.
   Components of these links are the groups to look at.
4. A group is worked on in one task if it is small, else as pairs of blocks. A pair that the sketches rule out is skipped,
   and so is one already connected; every other pair is confirmed on the full sets. So all components are those of the
   exact links.

Null and wordless texts have empty sets and link with nothing. Rows of one id are one document of several texts, each
of which may link. Rows without an id get a null class of their own. Extra columns are passed by; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, arrow_limits, connected_components, join_spread, map_arrow, unsent, mix, prefix_hash, span_hash, text_bytes, union_find

#: Bands and samples in each: two sets of similarity 0.85 miss all bands once in a million pairs.
BANDS, ROWS = 26, 5
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
BITS = 512
#: A group of at most so many classes and shingles is one task; larger ones are cut into blocks of half of that.
GROUP, GROUP_SHINGLES = 2048, 2_000_000
#: Bytes of text hashed at a time.
CHUNK = 1 << 19

_XOR = (mix(np.arange(1, SAMPLES + 1, dtype=U64) * U64(0xA24BAED4963EE407)) >> U64(32)).astype(np.uint32)
_MUL = (mix(np.arange(1, SAMPLES + 1, dtype=U64) * U64(0x9FB21C651E98DF25)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_STEP = [U64(pow(0xC2B2AE3D27D4EB4F, j, 1 << 64)) for j in range(64)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text of a batch."""
    out: list[np.ndarray] = []
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        out += _shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], words)
        first = last
    return out


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    solid = (data != 32) & ((data < 9) | (data > 13))
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] |= solid[inner]
    end[inner - 1] |= solid[inner - 1]
    lo, hi = np.flatnonzero(begin), np.flatnonzero(end) + 1
    word = span_hash(prefix_hash(data), lo, hi)
    at = np.searchsorted(lo, offsets)
    full = np.zeros(max(0, len(word) - words + 1), U64)
    for j in range(words):
        full += word[j : len(word) - words + 1 + j] * _STEP[j]
    full = mix(full)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            h = np.sort(full[a : b - words + 1])
            out.append(h[np.append(True, h[1:] != h[:-1])])
        elif b > a:
            few = (word[a:b] * np.array(_STEP[: b - a], U64)).sum(dtype=U64) + U64(b - a)
            out.append(mix(np.array([few], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, one row a set; empty sets have the largest value throughout."""
    out = np.full((len(sets), SAMPLES), np.uint32(0xFFFFFFFF))
    for i, s in enumerate(sets):
        h = (s >> U64(32)).astype(np.uint32)
        for a in range(0, len(h), 1024):
            np.minimum(out[i], ((h[a : a + 1024, None] ^ _XOR) * _MUL).min(0), out=out[i])
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    parts = samples.reshape(len(samples), BANDS, ROWS).astype(U64)
    key = np.broadcast_to(np.arange(BANDS, dtype=U64), (len(samples), BANDS)).copy()
    for j in range(ROWS):
        key = mix(key * _STEP[1] + parts[:, :, j])
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the (sample number, value) pairs, as 64-bit words."""
    place = mix(samples.astype(U64) + (np.arange(SAMPLES, dtype=U64) << U64(32))) % U64(BITS)
    flat = place.astype(np.int64) + np.arange(len(samples))[:, None] * BITS
    parity = (np.bincount(flat.ravel(), minlength=len(samples) * BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(len(samples), BITS), axis=1).view(U64)


def sketch_similarity(differing: np.ndarray | int) -> np.ndarray:
    """The estimate from the population count of an XOR: 1 + n/(4k) ln(1 - 2z/n)."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * np.asarray(differing) / BITS, 1e-9))


def largest_count(similarity: float) -> int:
    """XOR bits that similar sets stay below: each differing sample turns two bits at most; six deviations are allowed."""
    differ = SAMPLES * (1 - similarity) + 6 * np.sqrt(SAMPLES * similarity * (1 - similarity))
    return 2 * int(np.ceil(differ))


def set_keys(sets: list[np.ndarray]) -> list[bytes | None]:
    return [s.sum(dtype=U64).tobytes() + mix(s ^ _STEP[3]).sum(dtype=U64).tobytes() if len(s) else None for s in sets]


def _features(words: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*text_bytes(batch.column(1)), words)
        samples = signatures(sets)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(band_keys(samples).ravel()))
        sketches = pa.array([x.tobytes() for x in odd_sketches(samples)], pa.binary())
        arrays = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_keys(sets), pa.binary()), bands, sketches]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return fn


# ---------------------------------------------------------------- groups


def possible_pairs(sketches: np.ndarray, sizes: np.ndarray, percent: int, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs (i, j), i < j, sketches and set sizes allow, differing bits) of some rows with all."""
    z = np.bitwise_count(sketches[rows, None, :] ^ sketches[None, :, :]).sum(-1, dtype=np.int32)
    own = np.arange(len(sizes))
    ok = (z <= largest_count(percent / 100)) & (own[rows, None] < own)
    small, large = np.minimum(sizes[rows, None], sizes), np.maximum(sizes[rows, None], sizes)
    return ok & (100 * small >= percent * large), z


def _bucket_forests(percent: int):
    """Rows (band, rep, n_shingles, sketch) sorted by band to links (a, b): a spanning forest of each bucket's possible pairs."""

    def forest(reps: list[int], sizes: list[int], sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = np.array(reps, np.int64), np.array(sizes, np.int64)
        words = np.frombuffer(b"".join(sketches), U64).reshape(len(ids), -1)
        parent = np.arange(len(ids))
        for a in range(0, len(ids), 128):
            ok, _ = possible_pairs(words, n, percent, slice(a, a + 128))
            i, j = np.nonzero(ok)
            parent = union_find(len(ids), i + a, j, parent)
        own = parent != np.arange(len(ids))
        return ids[own], ids[parent[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    if len(rows) > 1:
                        out.append(forest(*zip(*rows, strict=True)))
                    key, rows = row[0], []
                rows.append(row[1:])
            yield from flush()
        if len(rows) > 1:
            out.append(forest(*zip(*rows, strict=True)))
        yield from flush()

    return run


def exact_links(sets: list[np.ndarray], sketches: np.ndarray, side: np.ndarray | None, percent: int) -> np.ndarray:
    """Component (smallest index) of each set under the links of at least ``percent``; with ``side``, of pairs across."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, np.cumsum(sizes)[:-1])
    found = []
    for a in range(0, m, 128):
        ok, z = possible_pairs(sketches, sizes, percent, slice(a, a + 128))
        if side is not None:
            ok &= side[a : a + 128, None] != side
        i, j = np.nonzero(ok)
        found.append(np.stack([i + a, j, z[i, j]]).astype(np.int32))
    i, j, z = np.concatenate(found, 1)
    order = np.argsort(z, kind="stable")
    i, j = i[order].astype(np.int64), j[order].astype(np.int64)
    parent = np.arange(m)
    mark = np.zeros(max((x.max() for x in ids if len(x)), default=0) + 1, bool)
    at, step = 0, 4 * m
    while at < len(i):
        x, y = i[at : at + step], j[at : at + step]
        at, step = at + step, 1 << 15
        apart = parent[x] != parent[y]
        x, y = x[apart], y[apart]
        linked = np.zeros(len(x), bool)
        by = np.argsort(x, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(x[by])) + 1) if len(by) else []:
            own = ids[x[part[0]]]
            mark[own] = True
            for q in range(0, len(part), 256):
                few = part[q : q + 256]
                other = sizes[y[few]]
                common = np.add.reduceat(mark[np.concatenate([ids[t] for t in y[few]])], np.cumsum(other) - other, dtype=np.int64)
                linked[few] = 100 * common >= percent * (len(own) + other - common)
            mark[own] = False
        parent = union_find(m, x[linked], y[linked], parent)
    return parent


def _solve(words: int, percent: int):
    """Rows (group, lower, upper, block, rep, set_key, sketch, text) sorted by the first three to links (rep, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, rows: dict) -> pa.RecordBatch:
            reps = np.array([rep for rep, _ in rows], np.int64)
            sets, sketches, blocks = zip(*rows.values(), strict=True)
            side = np.array(blocks) if key[1] != key[2] else None
            parent = exact_links(list(sets), np.stack(sketches), side, percent)
            own = parent != np.arange(len(reps))
            return pa.RecordBatch.from_arrays([pa.array(reps[own]), pa.array(reps[parent[own]])], names=["a", "b"])

        key, rows = None, {}
        for batch in batches:
            plain = [batch.column(i).to_pylist() for i in range(7)]
            sets = shingle_sets(*text_bytes(batch.column(7)), words)
            keys = set_keys(sets)
            for i in range(batch.num_rows):
                group = tuple(c[i] for c in plain[:3])
                if group != key:
                    if len(rows) > 1:
                        yield done(key, rows)
                    key, rows = group, {}
                if keys[i] == plain[5][i]:  # of an id that stands for several texts, the one meant
                    rows[plain[4][i], plain[5][i]] = (sets[i], np.frombuffer(plain[6][i], U64), plain[3][i])
        if len(rows) > 1:
            yield done(key, rows)

    return run


# ---------------------------------------------------------------- operator


def minhash_dedup(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``; ids are integers.

    Documents whose shingle sets have ``100 * intersection >= percent * union`` link; ``component_id`` is the smallest
    id reachable and ``kept`` marks the document that has it.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    features = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"
    rows = scratch.save(map_arrow(texts, _features(words), features), "features")

    some = rows.where("n_shingles > 0 and doc_id is not null")
    # of an id with several texts, each text is a class of its own name, joined through the id's links below
    first = F.min_by(F.struct(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sketch"), "doc_id").alias("first")
    named = scratch.save(some.groupBy("set_key").agg(first).select("set_key", "first.*"), "classes")
    reps = named.select("set_key", "rep")

    banded = named.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.save(banded.join(unsent(buckets), "band"), "shared")
    crowded = shared.where((F.col("n") > group) & (F.col("rep") != F.col("first"))).select(F.col("rep").alias("a"), F.col("first").alias("b"))
    sketched = shared.where(F.col("n") <= group).select("rep", "band").join(unsent(named.select("rep", "n_shingles", "sketch")), "rep")
    sketched = sketched.select("band", "rep", "n_shingles", "sketch").repartition("band").sortWithinPartitions("band")
    loose = scratch.save(sketched.mapInArrow(_bucket_forests(percent), "a long, b long").union(crowded), "possible")
    loose = connected_components(loose, scratch, "loose")

    members = named.join(unsent(loose.withColumnRenamed("node", "rep")), "rep").select("rep", "set_key", "sketch", "n_shingles", F.col("label").alias("group"))
    members = scratch.save(members, "members")
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    blocks = F.when((F.col("n") <= group) & (F.col("shingles") <= group_shingles), 1).otherwise(F.ceil(F.greatest(F.col("n") / (group / 2), F.col("shingles") / (group_shingles / 2)))).cast("int")
    sizes = scratch.save(sizes.select("group", blocks.alias("blocks")), "sizes")
    placed = join_spread(members, sizes, "group", "rep").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    placed = placed.join(unsent(texts.withColumnRenamed("doc_id", "rep")), "rep")
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("group", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), "block", "rep", "set_key", "sketch", "text")
    placed = placed.repartition("group", "lower", "upper").sortWithinPartitions("group", "lower", "upper")
    links = scratch.save(placed.mapInArrow(_solve(words, percent), "a long, b long"), "links")

    twice = some.select("doc_id", "set_key").distinct().groupBy("doc_id").count().where("count > 1")
    ids = some.select("doc_id", "set_key").join(unsent(twice.select("doc_id")), "doc_id", "left_semi").distinct().join(unsent(reps), "set_key")
    ids = ids.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    found = connected_components(links.union(ids), scratch, "exact").withColumnRenamed("node", "rep")

    classes = scratch.save(reps.join(unsent(found), "rep", "left").select("set_key", F.coalesce("label", "rep").alias("label")), "labels")
    out = join_spread(rows.select("doc_id", "n_shingles", "set_key"), classes, "set_key", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id")
    out = out.select("doc_id", "n_shingles", component)
    scratch.drop("classes", "shared", "possible", "members", "links", "sizes")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns: of each group of near-duplicates the one with the smallest id."""
    own = F.col(f"`{id_col}`")
    kept = minhash_dedup(docs, percent, id_col=id_col, text_col=text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept"))
    return docs.join(unsent(kept), own == F.col("__kept"), "left_semi").unionByName(docs.where(own.isNull()))
