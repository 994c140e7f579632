"""The states of windows, from file entries (see schema.FILE_ENTRY)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_state(end: Column, files: Column, now: int, late_window: int) -> Column:
    """deleted: nothing is left of the window; sealed: now is past its end and the late window; else open."""
    return F.when(files == 0, "deleted").when(F.lit(now) > end + F.lit(late_window), "sealed").otherwise("open")


def partition_listing(files: DataFrame, known: DataFrame, now: int, late_window: int) -> DataFrame:
    """start, end, state, files, size_bytes of each known window (partition_start, partition_end), by start."""
    live = files.groupBy("partition_start").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))
    found = known.join(live, "partition_start", "left").select(
        F.col("partition_start").alias("start"), F.col("partition_end").alias("end"), F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes")
    )
    return found.withColumn("state", partition_state(F.col("end"), F.col("files"), now, late_window)).select("start", "end", "state", "files", "size_bytes").orderBy("start")
