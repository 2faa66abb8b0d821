"""Shared pieces of the training-data operators: shared-folder tables, Arrow text access, hashing, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch sent to a Python worker; bounds a worker's memory whatever the text lengths.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
#: Rows of an Arrow batch sent back; the JVM holds one outside its heap, for each task.
OUT_ROWS = 1 << 16


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, local mode gets one of our own, a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="chronolith-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of an executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/chronolith-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            self._remove(self.path(name))

    def _remove(self, where: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; leftovers are only unused files
            pass


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as a zip archive that Spark distributes."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="chronolith-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def arrow_limits(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that long texts don't fill a worker; ship the package's code."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """``fn`` over each batch; whole rows in, any number of rows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                for a in range(0, out.num_rows, OUT_ROWS):
                    yield out.slice(a, OUT_ROWS)

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its n+1 offsets; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# ---------------------------------------------------------------- hot keys

#: A key is hot if it has more rows than the larger of HOT_ROWS and a HOT_SHARE-th of all: HOT_SHARE keys at most.
HOT_ROWS, HOT_SHARE = 512, 4096
#: Tasks that rows without a key are dealt to.
NULL_SALTS = 64


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that goes through a shuffle, whatever the size of its files: compressed tables of ids are many
    times larger as a broadcast, which the driver builds in its memory.
    """
    return df.hint("merge")


def join_spread(rows: DataFrame, few: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` left-joined with ``few``, which has one row a key at most; a hot key's rows are dealt to several tasks.

    ``spread`` is a column of ``rows`` that tells rows of one key apart. Only hot keys are broadcast, ``HOT_SHARE`` at most
    whatever the input; their rows of ``few`` are copied once for each salt.
    """
    limit = max(HOT_ROWS, rows.count() // HOT_SHARE)
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).count().where(F.col("count") > limit)
    hot = F.broadcast(counts.select("__key", F.ceil(F.col("count") / limit).cast("int").alias("__salts")))
    salts = F.when(F.col(key).isNull(), NULL_SALTS).otherwise(F.coalesce("__salts", F.lit(1)))
    dealt = F.pmod(F.xxhash64(spread, F.spark_partition_id()), salts).cast("int")  # the same in every attempt of a task
    left = rows.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", dealt).drop("__key", "__salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    right = few.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", copies).drop("__key", "__salts")
    return left.join(unsent(right), [key, "__salt"], "left").drop("__salt")


# ---------------------------------------------------------------- hashing

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, invertible)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: A random 64-bit word for each byte value.
BYTE_WORDS = mix(np.arange(1, 257, dtype=U64) * BASE)

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(size, U64)
        m = 1
        while m < size:
            have[m : 2 * m] = have[:m] * (have[m - 1 : m] * base)
            m *= 2
        _powers[int(base)] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of BYTE_WORDS[data[t]] * BASE**t for i <= t < j."""
    s = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_WORDS[data] * powers(BASE, len(data)), out=s[1:])
    return s


def span_hash(s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of data[lo:hi), the same wherever those bytes stand."""
    return mix((s[hi] - s[lo]) * powers(BASE_INV, len(s))[lo] + (hi - lo).astype(U64) * U64(0xD6E8FEB86659FD93))


def sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over each window of w values, by doubling."""
    m, s = x, 1
    while 2 * s <= w:
        m = f(m[:-s], m[s:])
        s *= 2
    return f(m[: len(m) - (w - s)], m[w - s :]) if s < w else m


# ---------------------------------------------------------------- components


def union_find(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of each of n nodes under the links (a, b); vectorised hooking and pointer jumping."""
    p = np.arange(n) if parent is None else parent.copy()
    while len(a):
        ra, rb = p[a], p[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            q = p[p]
            if np.array_equal(q, p):
                break
            p = q
    return p


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition, a bounded run of rows at a time, to stars at the smallest reachable node."""

    def flush(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
        p = union_find(len(nodes), ids[: len(a)], ids[len(a) :])
        own = p != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[p[own]])], names=["a", "b"])

    parts, rows = [], 0
    for batch in batches:
        parts.append(tuple(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)))
        rows += batch.num_rows
        if rows >= 1 << 20:
            yield flush(parts)
            parts, rows = [], 0
    if rows:
        yield flush(parts)


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, label)`` for every node of ``links(a long, b long)``: the smallest node reachable.

    Each partition first contracts its own links, then rounds of contraction follow: every node takes its smallest
    neighbour, links are rewritten to those and the rest dropped. Stars end in one round, chains in O(log n); each
    round is a written table, so nothing is recomputed when an executor is lost. A hub's links are never gathered: the
    smallest neighbour is a partial aggregate, and the joins are plain ones that AQE may split.
    """
    links = scratch.save(links.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long"), f"{name}-0")
    labels, step = None, 0
    while not links.isEmpty():
        step += 1
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = scratch.save(least.select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-m{step}")
        for jump in range(3 if step > 1 else 0):  # chains in ascending order: pointers jump over eight at a time
            ahead = least.toDF("label", "next")
            least = least.join(unsent(ahead), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
            least = scratch.save(least, f"{name}-m{step}-{jump}")
        left, right = least.toDF("a", "ra"), least.toDF("b", "rb")
        links = links.join(unsent(left), "a").join(unsent(right), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        links = scratch.save(links.mapInArrow(_contract, "a long, b long"), f"{name}-{step}")
        if labels is None:
            labels = least
        else:
            labels = labels.join(unsent(least.toDF("label", "next")), "label", "left")
            labels = labels.select("node", F.coalesce("next", "label").alias("label"))
            labels = scratch.save(labels, f"{name}-l{step}")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
