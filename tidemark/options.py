"""Options of a store."""

from __future__ import annotations

from dataclasses import dataclass

from tidemark.schema import HOUR, NANOS

STRICT, TOLERANT = "strict", "tolerant"
CODECS = ("none", "zstd", "snappy")


@dataclass(frozen=True)
class Options:
    """Durations are nanoseconds. partition_duration is kept in the store; the others may differ at each opening.

    The defaults of durations, modes and numbers of files up to retention are fixed values.
    """

    partition_duration: int = HOUR
    late_window: int = 300 * NANOS
    late_mode: str = STRICT
    #: In tolerant mode: refuse records of windows that are sealed.
    reject_sealed: bool = False
    #: A window with more files than this is compacted.
    max_files_per_partition: int = 10
    #: Files whose newest record is older than this are expired; 0: never.
    retention: int = 0
    compression: str = "none"
    #: Bloom filters on source_id in data files.
    index_sources: bool = False
    row_group_bytes: int = 128 << 20
    page_bytes: int = 1 << 20
    #: Files are cut at about this size when they are compacted.
    target_file_bytes: int = 1 << 30
    #: Read each new file once more and refuse the commit if its rows are out of order.
    check_order: bool = False

    def __post_init__(self) -> None:
        for name in ("partition_duration", "row_group_bytes", "page_bytes", "target_file_bytes"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in ("late_window", "max_files_per_partition", "retention"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.late_mode not in (STRICT, TOLERANT):
            raise ValueError(f"late_mode is {STRICT} or {TOLERANT}, not {self.late_mode!r}")
        if self.compression not in CODECS:
            raise ValueError(f"compression is one of {', '.join(CODECS)}, not {self.compression!r}")

    def writer_options(self) -> dict[str, str]:
        found = {"compression": self.compression, "parquet.block.size": str(self.row_group_bytes), "parquet.page.size": str(self.page_bytes), "parquet.page.write-checksum.enabled": "true"}
        if self.index_sources:
            found["parquet.bloom.filter.enabled#source_id"] = "true"
        return found
