"""The fixed schemas, and integer arithmetic on nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NANOS = 1_000_000_000
HOUR = 3600 * NANOS
MIN_TS, MAX_TS = -(1 << 63), (1 << 63) - 1

#: A record: Unix nanoseconds, who sent it, and bytes that nothing here interprets.
RECORD = T.StructType([T.StructField("ts", T.LongType(), False), T.StructField("source_id", T.BinaryType(), False), T.StructField("payload", T.BinaryType(), False)])

#: A data file of a store as its log knows it; path is relative to the store.
FILE_ENTRY = T.StructType(
    [
        T.StructField("path", T.StringType(), False), T.StructField("partition_start", T.LongType(), False), T.StructField("partition_end", T.LongType(), False),
        T.StructField("min_ts", T.LongType(), False), T.StructField("max_ts", T.LongType(), False), T.StructField("record_count", T.LongType(), False), T.StructField("size_bytes", T.LongType(), False),
    ]
)

BUCKET = "bucket_start long, bucket_end long, count long, rate double"
PARTITION = "start long, end long, state string, files long, size_bytes long"


def window_start(ts: Column, duration: int) -> Column:
    """Start of the epoch-aligned window that holds ts, for negative ts, too. Integers all the way: `/` would go through doubles."""
    return ts - F.pmod(ts, F.lit(duration).cast("long"))


def window_start_of(ts: int, duration: int) -> int:
    return ts - ts % duration


def record_size(source: Column | str = "source_id", payload: Column | str = "payload") -> Column:
    """Bytes of a record: eight for its time, and its source and payload."""
    return (F.lit(8) + F.octet_length(source) + F.octet_length(payload)).cast("long")


def nanos(timestamp: Column, zone: str = "UTC") -> Column:
    """Unix nanoseconds of a timestamp; one without zone is taken as UTC in a session whose zone is given.

    In a session in UTC that is a cast; else the parts are put together, as the session's zone may leave out or repeat hours.
    """
    if zone in ("UTC", "Etc/UTC", "Z"):
        return F.unix_micros(timestamp.cast("timestamp")) * F.lit(1000).cast("long")
    micros = F.unix_date(timestamp.cast("date")).cast("long") * 86_400_000_000 + F.hour(timestamp).cast("long") * 3_600_000_000 + F.minute(timestamp).cast("long") * 60_000_000
    second = (F.extract(F.lit("SECOND"), timestamp) * 1_000_000).cast("long")
    return (micros + second) * F.lit(1000).cast("long")


def records_of(df: DataFrame, ts: Column, source: Column, payload: Column) -> DataFrame:
    """df as records; source and payload are cast to bytes."""
    return df.select(ts.cast("long").alias("ts"), source.cast("binary").alias("source_id"), payload.cast("binary").alias("payload"))
