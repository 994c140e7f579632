"""Tumbling windows, aligned with the epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import window_start


def routed(records: DataFrame, duration: int) -> DataFrame:
    """records with part_start, the start of the window that holds them: part_start <= ts < part_start + duration."""
    return records.withColumn("part_start", window_start(F.col("ts"), duration))
