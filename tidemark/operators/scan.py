"""Range scans and ordered merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_range(records: DataFrame, start: int, end: int, source: bytes | None = None) -> DataFrame:
    """Records with start <= ts < end; of one source, if given (b"" is the empty source). Empty if start >= end.

    The predicates are plain comparisons, which Parquet scans take on (row groups and pages by statistics,
    sources by dictionary or Bloom filter). Rows come in no order; see ordered().
    """
    found = records.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    if source is not None:
        found = found.where(F.col("source_id") == F.lit(bytearray(source)))
    return found


def ordered(records: DataFrame, ties: bool = True) -> DataFrame:
    """By ts and source (unsigned bytes). With ties, equal keys by payload, so that the order is one; without, payloads are never compared."""
    return records.orderBy("ts", "source_id", *(["payload"] if ties else []))


def merged(*parts: DataFrame) -> DataFrame:
    """All records of all parts in order; equal ones are all kept."""
    if not parts:
        raise ValueError("nothing to merge")
    return ordered(reduce(DataFrame.unionByName, parts))
