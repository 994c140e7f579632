"""Which records are let in. The clock is always given: nothing here reads one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.options import STRICT, Options
from tidemark.schema import MIN_TS, window_start


def late(now: int, window: int) -> Column:
    """A record is late if it is older than now - window; one exactly as old is not. Any future time is fine."""
    return F.col("ts") < F.lit(max(MIN_TS, now - window))


def sealed(now: int, options: Options) -> Column:
    """A record's window is sealed once its end is more than the late window before now."""
    end = window_start(F.col("ts"), options.partition_duration) + F.lit(options.partition_duration)
    return end < F.lit(max(MIN_TS, now - options.late_window))


def refused(now: int, options: Options) -> Column:
    """Strict: late records. Tolerant: none, or with reject_sealed those of sealed windows; late ones go to the window they belong to."""
    if options.late_mode == STRICT:
        return late(now, options.late_window)
    return sealed(now, options) if options.reject_sealed else F.lit(False)


def admitted(records: DataFrame, now: int, options: Options) -> DataFrame:
    return records.where(~refused(now, options))


def rejected(records: DataFrame, now: int, options: Options) -> DataFrame:
    return records.where(refused(now, options))


def require_records(df: DataFrame) -> DataFrame:
    """df as records; a null in any field raises when the rows are read. Empty sources and payloads are kept as they are."""
    checked = []
    for name, kind in (("ts", "long"), ("source_id", "binary"), ("payload", "binary")):
        column = F.col(name).cast(kind)
        checked.append(F.coalesce(column, F.raise_error(F.lit(f"record without {name}")).cast(kind)).alias(name))
    return df.select(*checked)
