"""What the operators of this subpackage share: tables, written intermediates, words as numpy arrays."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; longer single texts make larger steps.
STEP_BYTES = 1 << 20

_MULT = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers(dict):
    """Powers by base. They stay where they were made: functions that go to executors take none along."""

    def __reduce__(self):
        return _Powers, ()


_powers = _Powers()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # this write's shuffles go when it is done
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name.rsplit("/", 1)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more, and let Spark drop the shuffles of finished steps. Not for
    each round of a loop: a driver that collects its garbage that often is given more heap by its JVM."""
    delete(spark, *tables)
    gc.collect()
    spark._jvm.System.gc()


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty ones: other columns and their names don't matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def versions(docs: DataFrame) -> DataFrame:
    """documents() with a hash of the text, `version`, which tells rows of one doc_id, or of none, apart."""
    return documents(docs).withColumn("version", F.xxhash64("text"))


def join_versions(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (doc_id, version), columns of `left` coming first; a null doc_id equals a null doc_id."""
    right = right.withColumnsRenamed({"doc_id": "same_id", "version": "same_version"})  # a broadcast hint stays
    both = left.join(right, left["doc_id"].eqNullSafe(F.col("same_id")) & (left["version"] == F.col("same_version")), how)
    return both.drop("same_id", "same_version")


def rows_of(docs: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """Rows of docs, with all their columns, that have ("left_semi") or don't have ("left_anti") a (doc_id, version) among
    the wanted. A row travels as one struct, so its columns may have any names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.struct("*").alias("row"))
    return join_versions(rows, wanted.select("doc_id", "version"), how)


def numbered(df: DataFrame, order: list[Column], name: str, at: str = "position") -> DataFrame:
    """df with each row's position (from 1) in the given order over all rows, and without a task that sees them all.

    Ranges of the order are dealt to tasks and written; a row's position is its place within its range after the rows of
    the ranges before it, and only the ranges' counts, one number a task, meet in one place. Equal rows may change places.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumn("_spread", F.monotonically_increasing_id())  # many equal keys don't make one range
    ranges = spread.repartitionByRange(n, *order, F.col("_spread")).sortWithinPartitions(*order, "_spread").drop("_spread")
    dealt = materialize(ranges.withColumn("_at", F.monotonically_increasing_id()), name)
    range_no = F.shiftright("_at", 33)
    counts = dealt.groupBy(range_no.alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_range", before.alias("_before"))  # a row for each of the n ranges
    placed = dealt.join(F.broadcast(counts), range_no == F.col("_range"))
    return placed.withColumn(at, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_before", "_at")


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, STEP_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


#: What an operator's tasks leave in a worker for its next tasks, as functions that drop it.
left_behind: list[Callable[[], None]] = []


def trim() -> None:
    """Return to the system the memory that Arrow and the C library keep for later."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def give_back() -> None:
    """Drop what tasks of other operators left in this worker, and return memory that isn't used to the system."""
    for drop in left_behind:
        drop()
    trim()


def giving_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; memory is given back before the first is read, and after each."""
    give_back()
    for batch in batches:
        yield batch
        del batch
        give_back()


class Bytes:
    """The texts of some rows as one byte buffer; row i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.data, self.offsets = ids, data, offsets

    def prefix_hash(self) -> np.ndarray:
        """H with H[e] - H[s] == hash(data[s:e]) * base**s, modulo 2**64."""
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(len(self.data)), out=out[1:])
        return out


def byte_steps(batches: Iterator[pa.RecordBatch], column: str = "text", lower: bool = False) -> Iterator[Bytes]:
    """Arrow batches of (doc_id, text) as Bytes of about STEP_BYTES each; null texts are empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        if not len(texts):
            continue
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1)
            part = data[offsets[at] : offsets[to]]
            yield Bytes(ids.slice(at, to - at), _LOWER[part] if lower else part, offsets[at : to + 1] - offsets[at])
            at = to


def words(b: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row index of each word: a longest run of bytes other than space and 0x09 to 0x0D."""
    solid = ~_SPACE[b.data]
    full = b.offsets[:-1][b.offsets[:-1] < b.offsets[1:]]
    before = np.concatenate(([False], solid[:-1]))[: len(solid)]
    before[full] = False
    after = np.concatenate((solid[1:], [False]))[: len(solid)]
    after[b.offsets[1:][b.offsets[:-1] < b.offsets[1:]] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(b.offsets, starts, side="right") - 1


def word_hashes(b: Bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    h = b.prefix_hash()
    inverse = powers(len(b.data) + 1, _INVERSE)
    return mix((h[ends] - h[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MULT[0])


def shingles(b: Bytes, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in order, and row offsets; fewer words make one shingle of them all."""
    starts, ends, row = words(b)
    w = word_hashes(b, starts, ends)
    counts = np.bincount(row, minlength=len(b.ids))
    first = np.concatenate(([0], np.cumsum(counts)))
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    to = np.concatenate(([0], np.cumsum(made)))
    owner = np.repeat(np.arange(len(b.ids)), made)
    at = first[:-1][owner] + np.arange(to[-1]) - to[:-1][owner]
    total = np.zeros(len(at), dtype=np.uint64)
    length = np.minimum(counts, k)[owner]
    for j in range(k):
        inside = length > j
        total[inside] += mix(w[at[inside] + j] + _MULT[j]) * _MULT[(j + 1) % 5]
    return mix(total + length.astype(np.uint64)), to
