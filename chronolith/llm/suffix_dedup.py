"""Removal of long repeated byte strings by suffix arrays.

A byte goes if a string of ``min_bytes`` bytes that covers it also starts anywhere else, in the same text or another.

1. Anchors. The window of ``min_bytes`` bytes at each position is named by the smallest hash of the grams inside it, a
   function of its bytes alone, so equal windows have equal names. Neighbouring windows of one name form a *run*. Only
   runs whose name occurs twice can hold repeats; runs that are equal as a whole (128-bit BLAKE2 digests of their bytes)
   are settled by counting.
2. Shards. The other runs of a name go to one shard, whose bytes are bounded. There a suffix array is built by
   Larsson-Sadakane refinement in numpy, common prefixes follow by Kasai's bound, and a window repeats if it shares
   ``min_bytes`` bytes with a neighbour in the array.
3. Hot names. Runs of a name with more bytes than a shard are dealt to several shards. Each sorts the digests of its
   distinct windows' bytes, cuts them by range with binary search, and the shards' sorted lists of a range are merged by
   binary search.

Nulls count as empty texts; empty and short texts keep all their bytes; equal rows are repeats of each other; an empty
table gives an empty one; columns other than the id and the text are passed by. A very long text is looked at ``CHUNK``
windows at a time, so that beside the text itself a task holds arrays of a chunk or a shard only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, U64, Scratch, arrow_limits, join_spread, map_arrow, prefix_hash, sliding, span_hash, text_bytes

#: Bytes of text in a shard, about; below 2**21, so that two ranks and a position share a 64-bit sort key.
SHARD_BYTES = 1 << 19
#: Shards that a task solves one after another, about.
SHARDS_PER_TASK = 6
#: Windows of a text that are named at a time.
CHUNK = 1 << 20
#: First key: seven characters of nine bits.
HEAD = 7


# ---------------------------------------------------------------- suffix arrays


def suffix_array(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, rank) of all suffixes of a text of pieces.

    ``text``: characters 1..256, and 0 at each piece's end, where ``ends`` points for every position. Each end differs
    from every other, so all suffixes differ and the order is total. Larsson-Sadakane: groups sorted by their first h
    characters are sorted by the rank of the suffix h further on, and only groups of several suffixes are looked at.
    """
    n = len(text)
    key = np.zeros(n, U64)
    wide = np.zeros(n + HEAD, np.uint16)
    wide[:n] = text
    left = ends - np.arange(n)
    for j in range(HEAD):
        key = (key << U64(9)) | np.where(left > j, wide[j : n + j], 0).astype(U64)
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    first = np.ones(n, bool)
    first[1:] = (k[1:] != k[:-1]) | (left[sa[1:]] < HEAD)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    h, bits = HEAD, max(1, int(n).bit_length())
    size = np.bincount(start, minlength=n)
    slots = np.flatnonzero(size[start] > 1)
    while len(slots):
        pos = sa[slots]
        group, nxt = rank[pos], rank[pos + h]
        if 3 * bits <= 64:
            packed = (group.astype(U64) << U64(2 * bits)) | (nxt.astype(U64) << U64(bits)) | pos.astype(U64)
            packed.sort()
            pos = (packed & U64((1 << bits) - 1)).astype(np.int64)
            two = packed >> U64(bits)
        else:
            two = group.astype(U64) * U64(n) + nxt.astype(U64)
            order = np.argsort(two, kind="stable")
            pos, two = pos[order], two[order]
        sa[slots] = pos  # groups keep their slots, in the order of their ranks
        new = np.ones(len(pos), bool)
        new[1:] = two[1:] != two[:-1]
        at = np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))
        rank[pos] = slots[at]
        run = np.diff(np.append(np.flatnonzero(new), len(pos)))
        slots = slots[np.repeat(run, run) > 1]
        h *= 2
    return sa, rank


def common_prefixes(data: np.ndarray, ends: np.ndarray, sa: np.ndarray, rank: np.ndarray, cap: int) -> np.ndarray:
    """lcp[r], at most ``cap``, of sa[r] and sa[r-1]; lcp[0] is 0.

    Kasai's bound: the suffix one further on shares at most one byte less with its own predecessor. Positions are done
    by strides of 64, 32 .. 1: each starts from the bound left by the stride before it, all of a stride at once, eight
    bytes at a time.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    words = np.zeros(n, U64)
    for j in range(8):
        words |= padded[j : n + j].astype(U64) << U64(8 * j)
    pred = np.full(n, -1, np.int64)
    pred[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)
    stride = 64
    positions = np.arange(0, n, stride)
    while True:
        i = positions
        if stride < 64:
            before = i - stride
            bound = np.where(ends[before] == ends[i], plcp[before] - stride, 0)
            plcp[i] = np.maximum(bound, 0)
        i = i[pred[i] >= 0]
        most = np.minimum(np.minimum(ends[i] - i, ends[pred[i]] - pred[i]), cap)
        length = np.minimum(plcp[i], most)
        plcp[i] = length
        live = np.flatnonzero(length < most)
        while len(live):
            a = i[live] + length[live]
            differ = words[a] ^ words[pred[i[live]] + length[live]]
            low = differ & (~differ + U64(1))
            step = np.where(differ == 0, 8, (np.bitwise_count(low - U64(1)) >> 3).astype(np.int64))
            length[live] = np.minimum(length[live] + step, most[live])
            live = live[(differ == 0) & (length[live] < most[live])]
        plcp[i] = length
        if stride == 1:
            break
        stride //= 2
        positions = np.arange(stride, n, 2 * stride)
    return plcp[sa]


def join_pieces(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with one more at each piece's end, end of the piece of each position, starts of pieces)."""
    sizes = np.array([len(p) + 1 for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.zeros(int(sizes.sum()), np.uint8)
    for s, p in zip(starts, pieces, strict=True):
        data[s : s + len(p)] = p
    return data, np.repeat(starts + sizes - 1, sizes), starts


def repeats(pieces: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of ``length`` bytes stand twice: (bytes, starts of pieces, repeated by position, class leaders).

    A class leader is the first in the suffix array of the windows that share ``length`` bytes.
    """
    data, ends, starts = join_pieces(pieces)
    text = data.astype(np.uint16) + 1
    text[ends[starts]] = 0
    sa, rank = suffix_array(text, ends)
    lcp = common_prefixes(data, ends, sa, rank, length)
    linked = lcp >= length
    again = linked.copy()
    again[:-1] |= linked[1:]
    full = ends - np.arange(len(data)) >= length
    by_position, leader = np.empty(len(data), bool), np.empty(len(data), bool)
    by_position[sa], leader[sa] = again, ~linked
    return data, starts, by_position & full, leader & full


# ---------------------------------------------------------------- runs


def runs(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(name, lo, hi, own) of the runs of windows of a text; windows start in [lo, hi - length].

    ``own``: the naming gram stands twice in the run, so a window may repeat inside it. A run over a chunk's end is two.
    """
    parts = [_runs(data[a : a + CHUNK + length - 1], length, a) for a in range(0, max(1, len(data) - length + 1), CHUNK)]
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs(data: np.ndarray, length: int, at: int) -> tuple[np.ndarray, ...]:
    gram = length // 2
    if len(data) < length:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    s = prefix_hash(data)
    places = np.arange(len(data) - gram + 1)
    grams, width = span_hash(s, places, places + gram), length - gram + 1
    least = sliding(grams, width, np.minimum)
    lo = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    hi = np.append(lo[1:], len(least)) - 1 + length
    name, own, rim = least[lo], np.zeros(len(lo), bool), np.zeros(width - 1, U64)
    chosen = np.flatnonzero(sliding(np.concatenate([rim, least, rim]), width, np.maximum) == grams)
    values, which = np.unique(grams[chosen], return_inverse=True)
    if len(values) < len(chosen):
        places = np.sort(which * len(data) + chosen)
        base = np.searchsorted(values, name) * len(data)
        own = np.searchsorted(places, base + hi - gram + 1) - np.searchsorted(places, base + lo) > 1
    return name, lo + at, hi + at, own


def _digests(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    view = memoryview(np.ascontiguousarray(data))
    return [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def _emit_runs(length: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        found = [runs(data[a:b], length) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        rows = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        name, lo, hi, own = (np.concatenate(x) for x in zip(*found, strict=True))
        whole = _digests(data, lo + offsets[rows], hi + offsets[rows])
        arrays = [pa.array(name.view(np.int64)), pa.array(whole, pa.binary()), batch.column(0).take(pa.array(rows)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(own)]
        return pa.RecordBatch.from_arrays(arrays, names=["name", "whole", "key", "lo", "hi", "own"])

    return fn


def word_windows(data: np.ndarray, words: int, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, lo, hi) of the windows of ``words`` words, by white space, of fewer than ``below`` bytes."""
    parts = []
    for a in range(0, max(1, len(data)), CHUNK):  # with the byte before it, and as many behind it as a window may have
        first = max(0, a - 1)
        own = data[first : a + CHUNK + below]
        inside = np.concatenate([[False], (own != 32) & ((own < 9) | (own > 13)), [False]])
        lo, hi = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        lo, hi = lo[: max(0, len(lo) - words + 1)], hi[words - 1 :]
        good = (hi - lo < below) & (lo + first >= a) & (lo + first < a + CHUNK)
        lo, hi = lo[good], hi[good]
        parts.append((span_hash(prefix_hash(own), lo, hi) if len(lo) else np.zeros(0, U64), lo + first, hi + first))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _emit_words(words: int, below: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        found = [word_windows(data[a:b], words, below) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        rows = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        name, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), batch.column(0).take(pa.array(rows)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["name", "key", "lo", "hi"])

    return fn


#: Digests as numpy compares them: sixteen bytes, the first ones first.
DIGEST = np.dtype("S16")
OUT = "key binary, lo int, hi int, name long, slice int, hashes binary, keys array<binary>, piece binary, start binary"


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _shard(length: int, shard_bytes: int):
    """Rows sorted by (name, salt) to spans of repeated windows; for salted names also slices of sorted window keys."""
    names = ["key", "lo", "hi", "name", "slice", "hashes", "keys", "piece", "start"]

    def solve(rows: list[tuple]) -> Iterator[dict]:
        data, starts, again, leader = repeats([r[5] for r in rows], length)
        for (name, salts, key, lo, _, piece), at in zip(rows, starts, strict=True):
            for a, b in zip(*_spans(again[at : at + len(piece)]), strict=True):
                yield {"key": key, "lo": lo + int(a), "hi": lo + int(b) - 1 + length}
        if rows[0][1] > 1:  # one hot name, dealt to several shards
            at = np.flatnonzero(leader)
            hashes = np.frombuffer(b"".join(_digests(data, at, at + length)), DIGEST)
            order = np.argsort(hashes)
            hashes, at = hashes[order], at[order]
            piece = np.searchsorted(starts, at, "right") - 1
            single = ~again[at]
            start = np.where(single, at - starts[piece] + np.array([r[3] for r in rows])[piece], -1)
            salts = rows[0][1]
            cuts = np.searchsorted(hashes, np.array([((i << 128) // salts).to_bytes(16, "big") for i in range(1, salts)], DIGEST))
            for i, (h, p, t) in enumerate(zip(np.split(hashes, cuts), np.split(piece, cuts), np.split(start, cuts), strict=True)):
                used, inverse = np.unique(p, return_inverse=True)
                if len(h):
                    yield {"name": rows[0][0], "slice": i, "hashes": h.tobytes(), "keys": [rows[j][2] for j in used], "piece": inverse.astype(np.int32).tobytes(), "start": t.astype(np.int64).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("key", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("name", pa.int64()), ("slice", pa.int32()), ("hashes", pa.binary()), ("keys", pa.list_(pa.binary())), ("piece", pa.binary()), ("start", pa.binary())])

        def done(rows: list[tuple]) -> pa.RecordBatch:
            out = list(solve(rows))
            return pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in out], types.field(n).type) for n in names], schema=types)

        rows, size, group = [], 0, None
        for batch in batches:
            data, offsets = text_bytes(batch.column(5))
            plain = [batch.column(i).to_pylist() for i in range(5)]
            for i in range(batch.num_rows):
                name, salts, key, lo, salt = (c[i] for c in plain)
                if group is not None and (name, salt) != group and (size >= shard_bytes // 2 or salts > 1 or rows[0][1] > 1):
                    yield done(rows)
                    rows, size = [], 0
                group = (name, salt)
                rows.append((name, salts, key, lo, salt, data[offsets[i] : offsets[i + 1]].copy()))
                size += int(offsets[i + 1] - offsets[i])
        if rows:
            yield done(rows)

    return run


def _merge(length: int):
    """Sorted window digests of the shards of one hot name and range, merged by binary search, one shard after another."""
    import pandas as pd

    def fn(part: pd.DataFrame) -> pd.DataFrame:
        merged, counts = np.zeros(0, DIGEST), np.zeros(0, np.int64)
        lists = [np.frombuffer(x, DIGEST) for x in part["hashes"]]
        for h in lists:
            at = np.searchsorted(merged, h)
            hit = at < len(merged)
            hit[hit] = merged[at[hit]] == h[hit]
            counts[at[hit]] += 1
            merged, counts = np.insert(merged, at[~hit], h[~hit]), np.insert(counts, at[~hit], 1)
        keys, los = [], []
        for h, own, piece, start in zip(lists, part["keys"], part["piece"], part["start"], strict=True):
            start = np.frombuffer(start, np.int64)
            found = (counts[np.searchsorted(merged, h)] > 1) & (start >= 0)
            keys += [own[p] for p in np.frombuffer(piece, np.int32)[found]]
            los += start[found].tolist()
        return pd.DataFrame({"key": keys, "lo": np.array(los, np.int32), "hi": np.array(los, np.int32) + length})

    return fn


# ---------------------------------------------------------------- operator


def repeated_spans(texts: DataFrame, scratch: Scratch, min_bytes: int = 400, shard_bytes: int = SHARD_BYTES, words: int | None = None) -> DataFrame:
    """``(key, spans array<struct<lo,hi>>)`` of the texts of ``(key binary, doc_id, text)`` that hold repeats.

    ``key`` names the text (equal texts have equal keys); spans may overlap. With ``words``, windows of so many words
    that repeat count too if they have fewer bytes than ``min_bytes``.
    """
    long_enough = texts.where(F.octet_length("text") >= min_bytes)
    found = scratch.save(map_arrow(long_enough.select("key", "text"), _emit_runs(min_bytes), "name long, whole binary, key binary, lo int, hi int, own boolean"), "runs")
    # one row for each different run, with the first place where it stands; then what its name holds altogether
    each = found.groupBy("name", "whole").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "lo", "hi")).alias("at"), F.max("own").alias("own"))
    each = scratch.save(each, "each")
    of_name = each.groupBy("name").agg(F.sum("times").alias("stands"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("at.hi") - F.col("at.lo") + 1).alias("bytes"), F.max("own").alias("any_own"))
    known = scratch.save(each.join(of_name.where("stands > 1 or any_own"), "name"), "known")
    equal = found.join(known.where("times > 1").select("name", "whole"), ["name", "whole"]).select("key", "lo", "hi").distinct()
    # runs of a name that differ meet in a shard; hot names are dealt to several
    salts = F.ceil(F.col("bytes") / F.lit(shard_bytes)).cast("int")
    open_ = known.where("kinds > 1 or any_own").select("name", "whole", "at.*", salts.alias("salts"))
    wanted = open_.groupBy("key").agg(F.collect_list(F.struct("name", "salts", "lo", "hi", F.pmod(F.xxhash64("whole"), "salts").cast("int").alias("salt"))).alias("wanted"))
    # of equal texts one is enough; each task keeps one of its own before the shuffle
    one = long_enough.select("key", "text").dropDuplicates(["key"]).join(wanted, "key").withColumn("data", F.col("text").cast("binary"))
    pieces = one.select("key", "data", F.explode("wanted").alias("w"))
    pieces = pieces.select("w.name", "w.salts", "key", "w.lo", "w.salt", F.substring("data", F.col("w.lo") + 1, F.col("w.hi") - F.col("w.lo")).alias("piece"))
    size = open_.agg(F.sum(F.col("hi") - F.col("lo"))).first()[0] or 0
    tasks = max(1, -(-size // (SHARDS_PER_TASK * shard_bytes)))
    pieces = pieces.repartition(tasks, "name", "salt").sortWithinPartitions("name", "salt")
    solved = scratch.save(pieces.mapInArrow(_shard(min_bytes, shard_bytes), OUT), "solved")
    merged = solved.where("slice is not null").groupBy("name", "slice").applyInPandas(_merge(min_bytes), "key binary, lo int, hi int")
    spans = equal.union(solved.where("slice is null").select("key", "lo", "hi")).union(merged)
    if words:
        short = map_arrow(texts.where(F.octet_length("text") >= 2 * words - 1).select("key", "text"), _emit_words(words, min_bytes), "name long, key binary, lo int, hi int")
        # written as they come: what goes through the first shuffle is names and counts only
        short = scratch.save(short, "words").withColumn("size", F.col("hi") - F.col("lo"))
        stands = scratch.save(short.groupBy("name", "size").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "stands")
        # windows with many rows repeat for certain: they need no shuffle, and no task gets all rows of one
        limit = max(HOT_ROWS, short.count() // HOT_SHARE)
        hot = F.broadcast(stands.where(F.col("rows") > limit).select("name", "size"))  # HOT_SHARE at most
        rest = short.join(hot, ["name", "size"], "left_anti").join(stands.where(F.col("rows") <= limit), ["name", "size"], "left_semi")
        # windows of equal texts are told once
        spans = spans.union(rest.union(short.join(hot, ["name", "size"], "left_semi")).select("key", "lo", "hi").distinct())
    spans = scratch.save(spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    scratch.drop("runs", "each", "known", "solved", *["words", "stands"] * bool(words))
    return spans


def cut(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans joined: starts and ends of the removed stretches."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    first = np.append(True, lo[1:] > reach[:-1])
    return lo[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(lo) - 1)]


def whole_characters(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of UTF-8 text widened to the ends of the characters that they cut."""
    inner = np.append((data & 0xC0) == 0x80, False)
    for _ in range(3):
        lo, hi = lo - inner[lo], hi + inner[hi]
    return lo, hi


def _without(data: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    return b"".join(data[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(data)], strict=True))


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"), row)


def _apply(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column(1))
    sizes = np.diff(offsets)
    several = pc.list_value_length(batch.column(2)).fill_null(0).to_numpy()
    flat = batch.column(2).flatten()
    los, his = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("lo", "hi"))
    removed, count, digest, kept = [], [], [], []
    for a, b, n, end in zip(offsets[:-1], offsets[1:], several, np.cumsum(several), strict=True):
        own = data[a:b]
        whole = own.tobytes()
        left, text = whole, whole
        lo = hi = np.zeros(0, np.int64)
        if n:
            lo, hi = cut(los[end - n : end], his[end - n : end])
            left, text = _without(whole, lo, hi), _without(whole, *whole_characters(own, lo, hi))
        removed.append(int((hi - lo).sum()))
        count.append(len(lo))
        digest.append(hashlib.sha256(left).hexdigest())
        kept.append(text.decode())
    arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest), pa.array(kept, pa.string()), *batch.columns[3:]]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *batch.schema.names[3:]])


def suffix_array_dedup(docs: DataFrame, min_bytes: int = 400, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, with_row: bool = False, words: int | None = None) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` for every row of ``docs``.

    ``kept`` is what is left of the text, without the characters that lost a part of their bytes; the digest is that of the
    bytes left. ``with_row`` adds the whole row of ``docs`` as a struct. With ``words``, repeated
    windows of so many words go too, however few bytes they have. See the module for nulls, empty texts and ties.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    scratch = Scratch(spark, "suffix")
    texts = with_keys(docs, id_col, text_col)
    spans = repeated_spans(texts.drop("row"), scratch, min_bytes, shard_bytes, words)
    extra = ["row"] * with_row
    found = join_spread(texts, spans, "key", "doc_id").select("doc_id", "text", "spans", *extra)
    types = dict(found.dtypes)
    schema = f"doc_id {types['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    if with_row:
        schema += f", row {types['row']}"
    return map_arrow(found, _apply, schema)
