"""Counts and rates by fixed buckets, and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidBucketWidth
from tidemark.operators.scan import scan_range
from tidemark.schema import BUCKET, MAX_TS, NANOS, record_size


def bucket_aggregate(records: DataFrame, start: int, end: int, width: int, source: bytes | None = None) -> DataFrame:
    """bucket_start, bucket_end, count, rate of every bucket of `width` from start on, empty ones with 0.

    Buckets are anchored at start. The last may end after `end`, but counts only what is before it; its rate
    still is by the whole width. The rate is per second. No buckets if end <= start.
    """
    if width <= 0:
        raise InvalidBucketWidth(f"bucket width {width}")
    spark = records.sparkSession
    if end <= start:
        return spark.createDataFrame([], BUCKET)
    n = -(-(end - start) // width)
    if start + n * width > MAX_TS:
        raise ValueError("the last bucket ends after the largest timestamp")
    # only ts is read; counts are summed up in each task before the shuffle
    bucket = F.expr(f"(ts - {start}L) div {width}L")
    counts = scan_range(records, start, end, source).groupBy(bucket.alias("i")).agg(F.count(F.lit(1)).alias("c"))
    first = F.lit(start) + F.col("id") * F.lit(width)
    count = F.coalesce("c", F.lit(0)).cast("long")
    dense = spark.range(n).join(counts, F.col("id") == F.col("i"), "left")
    return dense.select(first.alias("bucket_start"), (first + F.lit(width)).alias("bucket_end"), count.alias("count"), (count.cast("double") / F.lit(width / NANOS)).alias("rate"))


def source_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source_id").agg(F.count(F.lit(1)).alias("records"))


def total_bytes(records: DataFrame) -> DataFrame:
    """records and bytes of all; 0 and 0 if there are none."""
    return records.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(record_size()), F.lit(0)).alias("bytes"))


def file_stats(records: DataFrame, *by: str) -> DataFrame:
    """min_ts, max_ts, record_count for each file (or whatever `by` tells apart)."""
    return records.groupBy(*by).agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("record_count"))
