"""Ordinary tables as streams of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tidemark.schema import RECORD, nanos, records_of


def _nanos(df: DataFrame, name: str) -> Column:
    """Of a column without zone, or of one with; times without are UTC whatever the session's zone."""
    free = isinstance(df.schema[name].dataType, TimestampNTZType)
    return nanos(F.col(name), df.sparkSession.conf.get("spark.sql.session.timeZone") if free else "UTC")


def event_records(events: DataFrame) -> DataFrame:
    return records_of(events, _nanos(events, "ts"), F.col("event_type"), F.coalesce("props", F.lit("")))


def lineitem_records(lineitem: DataFrame) -> DataFrame:
    """Day-granular times with many ties; the payload is order and line number."""
    return records_of(lineitem, _nanos(lineitem, "l_shipdate"), F.col("l_returnflag"), F.concat_ws("/", "l_orderkey", "l_linenumber"))


def order_records(orders: DataFrame) -> DataFrame:
    return records_of(orders, _nanos(orders, "o_orderdate"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string"))


def single_record(spark: SparkSession, ts: int, source: bytes, payload: bytes) -> DataFrame:
    return spark.createDataFrame([(ts, bytearray(source), bytearray(payload))], RECORD)
