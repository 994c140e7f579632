"""Places and small helpers that the corpus operators have in common."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
#: Tables of bucketed(), by the last part of their folder.
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or what setCheckpointDir() was given.

    Only where both are unset and the master is local (tests) a temporary folder of this machine stands in.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir() or ""
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = context.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_dir[app]


#: Folders that fresh_path() named since each temporary() that is still open.
_open: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """At the end, or on an error, delete all tables made within, but those that spare() takes off the list."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for path in made:
            _delete(spark, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, dealt: bool = False) -> DataFrame:
    """As stored(), bucketed by a key, so that joins and groups by it don't shuffle the table. dealt: df already is by the same buckets."""
    spark = df.sparkSession
    name, n = f"tidemark_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "buckets")
    (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    _tables[path.rpartition("/")[2]] = name
    return spark.table(name)


def folders_of(df: DataFrame) -> set[str]:
    """The folders of stored() and bucketed() tables that df reads."""
    return {name for f in df.inputFiles() if "/tidemark-" in (name := f.rpartition("/")[0])}


def spare(made: list[str], df: DataFrame) -> None:
    """Of the folders of temporary() keep those that df reads."""
    names = {f.rpartition("/")[2] for f in folders_of(df)}
    made[:] = [f for f in made if f.rpartition("/")[2] not in names]


def discard(*frames: DataFrame) -> None:
    """Delete the files of stored() and bucketed() frames once nothing reads them any more."""
    for df in frames:
        for name in folders_of(df):
            _delete(df.sparkSession, name)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if table := _tables.pop(folder.rpartition("/")[2], None):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


#: A sieve has 2^SIEVE_BITS bits in rows of 32 words of 64.
SIEVE_BITS = 27


def _sieve_place(key: Column) -> tuple[Column, Column, Column]:
    """Of a key the sieve's row, word and bit."""
    h = F.xxhash64(key, F.lit(SIEVE_BITS))
    return h.bitwiseAND((1 << (SIEVE_BITS - 11)) - 1), F.shiftrightunsigned(h, 40).bitwiseAND(31).cast("int"), F.shiftrightunsigned(h, 48).bitwiseAND(63).cast("int")


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A bit for each key, by its hash: 16 MiB at most, whatever the number of keys, so it may be broadcast. Built and read in the JVM."""
    block, word, bit = _sieve_place(F.col(key))
    placed = keys.select(block.alias("_block"), word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    words = [F.coalesce(F.bit_or(F.when(F.col("word") == k, F.col("bit"))), F.lit(0).cast("long")) for k in range(32)]
    return stored(placed.groupBy("_block").agg(F.array(*words).alias("_bits")), "sieve")


def sifted(rows: DataFrame, key: Column, sieve: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(some, rest) of rows: some holds all whose key is one of the sieve's, and few others while the sieve is not full; rest has none.

    So only `some` needs to be shuffled to meet the keys.
    """
    block, word, bit = _sieve_place(F.col("_sift"))
    there = F.coalesce(F.call_function("shiftrightunsigned", F.get("_bits", word), bit).bitwiseAND(1) == 1, F.lit(False))
    # in a struct, rows may have columns of any name
    told = rows.select(F.struct("*").alias("_all"), key.alias("_sift")).join(F.broadcast(sieve), block == F.col("_block"), "left").withColumn("_there", there)
    return told.where("_there").select("_all.*"), told.where("not _there").select("_all.*")


_kept: dict[str, Callable[[], None]] = {}


def begin_task(name: str = "", clear: Callable[[], None] | None = None) -> None:
    """At the start of a task's Python code: workers live on, so drop the tables that other operators keep in them.

    Operator `name` keeps its own until another begins; clear() then drops them.
    """
    goes_on = name in _kept
    for other in [x for x in _kept if x != name]:
        _kept.pop(other)()
    if clear:
        _kept[name] = clear
    pa.default_memory_pool().release_unused()
    if not goes_on and sys.platform == "linux":
        with suppress(OSError, AttributeError):  # where the C library is another one, it keeps what was freed for itself
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of 4 MB, unless the session says otherwise: each task holds several copies of one."""
    if not spark._jsparkSession.sessionState().conf().contains("spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text as string, null text as empty; other columns only by name."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, end to end, and each row's offsets in them."""
    if pa.types.is_string(column.type):
        kind, width = pa.binary(), np.int32
    elif pa.types.is_large_string(column.type):
        kind, width = pa.large_binary(), np.int64
    else:
        raise TypeError(str(column.type))
    column = column.cast(kind)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of `column`, or one row if that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        _, offsets = text_bytes(batch.column(at))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit numbers, modulo 2^64."""

    def __init__(self, codes: np.ndarray, base: int) -> None:
        powers = np.full(len(codes) + 1, base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers[:-1], out=self.sums[1:])
        self.inverse = np.full(len(codes) + 1, pow(base, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def of(self, first: np.ndarray | slice, last: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[last] - self.sums[first]) * self.inverse[first])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each run, all runs end to end."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)
