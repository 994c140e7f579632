"""Operators on records: DataFrame in, DataFrame out; nothing is run here."""

from tidemark.operators.admission import admitted, late, refused, rejected, require_records, sealed
from tidemark.operators.aggregate import bucket_aggregate, file_stats, source_counts, total_bytes
from tidemark.operators.lifecycle import partition_listing, partition_state
from tidemark.operators.route import routed
from tidemark.operators.scan import merged, ordered, scan_range

__all__ = [
    "admitted", "bucket_aggregate", "file_stats", "late", "merged", "ordered", "partition_listing", "partition_state", "refused", "rejected", "require_records", "routed", "scan_range", "sealed",
    "source_counts", "total_bytes",
]
