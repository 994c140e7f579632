"""Records as lines of JSON: timestamp (RFC 3339), source and payload (base64)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import InvalidInput
from tidemark.functions.text import format_rfc3339, parse_rfc3339, strict_base64

_LINE = "timestamp string, source string, payload string"


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines (value) as value, ts, source_id, payload, good. Blank lines are left out; a missing source or payload is empty."""
    told = F.struct("value", F.from_json("value", _LINE).alias("x"), F.get_json_object("value", "$").isNotNull().alias("json"))
    # through a generator of one row, so that each line is parsed once: projections would be merged, and from_json copied to every use
    rows = lines.where(F.trim("value") != "").select(F.inline(F.array(told)))
    parts = F.struct("value", "json", parse_rfc3339(F.col("x.timestamp")).alias("ts"), strict_base64(F.coalesce("x.source", F.lit(""))).alias("source_id"), strict_base64(F.coalesce("x.payload", F.lit(""))).alias("payload"))
    rows = rows.select(F.inline(F.array(parts)))
    good = F.col("json") & F.col("ts").isNotNull() & F.col("source_id").isNotNull() & F.col("payload").isNotNull()
    return rows.select("value", "ts", "source_id", "payload", F.coalesce(good, F.lit(False)).alias("good"))


def import_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """The records of files of lines. All lines are checked first; one that isn't well formed fails the whole import."""
    rows = parse_lines(spark.read.text(list(paths)))
    bad = rows.where(~F.col("good")).limit(1).collect()
    if bad:
        raise InvalidInput(f"not a record: {bad[0]['value'][:200]}")
    return rows.select("ts", "source_id", "payload")


def export_lines(records: DataFrame) -> DataFrame:
    """A line (value) for each record, in the order of the records."""
    # base64() cuts lines in some versions; none are wanted here
    plain = lambda c: F.regexp_replace(F.base64(c), r"\s", "")
    return records.select(F.to_json(F.struct(format_rfc3339(F.col("ts")).alias("timestamp"), plain("source_id").alias("source"), plain("payload").alias("payload"))).alias("value"))


def write_ndjson(records: DataFrame, path: str) -> None:
    export_lines(records).write.text(path)
