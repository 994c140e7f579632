"""Time-partitioned records and training corpora on Spark."""

from tidemark.errors import Closed, Conflict, CorruptLog, InvalidBucketWidth, InvalidInput, InvalidRecord, LateArrival, OptionMismatch, OrderViolation, SealedWindow, StreamMismatch, TidemarkError
from tidemark.maintenance import Fifo, compact, expire, vacuum
from tidemark.metrics import Metrics
from tidemark.options import CODECS, STRICT, TOLERANT, Options
from tidemark.schema import HOUR, MAX_TS, MIN_TS, NANOS, RECORD
from tidemark.sources import export_lines, import_lines, parse_lines, single_record, write_ndjson
from tidemark.store import Store
from tidemark.streaming import write_stream

__all__ = [
    "CODECS", "HOUR", "MAX_TS", "MIN_TS", "NANOS", "RECORD", "STRICT", "TOLERANT", "Closed", "Conflict", "CorruptLog", "Fifo", "InvalidBucketWidth", "InvalidInput", "InvalidRecord", "LateArrival", "Metrics",
    "OptionMismatch", "Options", "OrderViolation", "SealedWindow", "Store", "StreamMismatch", "TidemarkError", "compact", "expire", "export_lines", "import_lines", "parse_lines", "single_record", "vacuum",
    "write_ndjson", "write_stream",
]
