"""Token ids of a corpus in ORC files, in ascending order of documents.

ORC keeps the ids as run-length encoded integers, with row indexes and a Bloom filter on doc_id for each group
of rows, so that readers take stripes in parallel and skip those that can't hold a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import slices, texts_of
from tidemark.llm.tokens import encoder

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
SLICE = 1 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2) -> None:
    """Write the ids of every document, each closed by `end`, to ORC files under `path`.

    Documents are dealt to files by ranges of doc_id (nulls first) and sorted in them; documents of one id
    follow each other by text. An empty or null text has just the end id. An empty table gives files without rows. Other columns are
    not written. Rows carry part (the file's place) and start_in_part (ids before the document in its file).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer).encode
        for batch in slices(batches, "text", SLICE):
            ids, lengths = encode(batch.column(1).to_pylist(), end)
            ends = np.cumsum(lengths)
            columns = [batch.column(0), pa.array(np.full(len(ends), part, np.int32)), pa.array(before + ends - lengths), pa.array(lengths.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))], schema=_ARROW)
            before += int(ends[-1])

    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").option("orc.stripe.size", 32 << 20)
    writer.option("orc.create.index", "true").option("orc.row.index.stride", 1000).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read_tokens(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The rows of write_tokens; Spark reads stripes in parallel and pushes filters on doc_id to indexes and Bloom filters."""
    stored = spark.read.schema(SCHEMA).orc(path)
    return stored.select(*columns) if columns else stored


def part_offsets(spark: SparkSession, path: str) -> DataFrame:
    """part, before: the ids in all earlier files. One row for each file."""
    last = read_tokens(spark, path, "part", "start_in_part", "n_tokens").groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("n"))
    rows, before = [], 0
    for part, n in sorted(map(tuple, last.collect())):  # as many rows as files
        rows.append((part, before))
        before += n
    return spark.createDataFrame(rows, "part int, before long")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            at, data = ids.offsets.to_numpy(), ids.values.to_numpy()
            raw = memoryview(np.ascontiguousarray(data, "<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(3).cast(pa.int64()), pa.array(sums, pa.int64())], schema=_DIGEST)

    found = read_tokens(spark, path).mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    # the broadcast side has one row for each file
    placed = found.join(F.broadcast(part_offsets(spark, path)), "part")
    return placed.select("doc_id", (F.col("start_in_part") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
