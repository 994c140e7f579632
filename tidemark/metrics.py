"""Counters, gauges and histograms of one store; nothing is shared between stores."""

from __future__ import annotations

import math
import threading
from bisect import bisect_left
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from http.server import ThreadingHTTPServer

#: The names of counters, gauges and histograms, and the bounds that Prometheus clients use by default.
COUNTERS = ("appends", "append_bytes", "late_arrivals", "wal_writes", "memtable_flushes", "scans", "scan_records", "sstable_reads", "sstable_skips", "compactions", "files_expired", "bytes_reclaimed", "bytes_flushed", "bytes_compacted")
GAUGES = ("active_partitions", "sstable_files", "sstable_bytes", "retention_horizon")
HISTOGRAMS = ("scan_duration", "compaction_duration")
#: Upper bounds in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, math.inf)


@dataclass
class Histogram:
    counts: list[int] = field(default_factory=lambda: [0] * len(BOUNDS))
    total: float = 0.0

    def observe(self, seconds: float) -> None:
        self.counts[bisect_left(BOUNDS, seconds)] += 1
        self.total += seconds


class Metrics:
    """A data file stands for a table, a batch's commit for a flush; wal_writes stays 0, as there is no such log."""

    def __init__(self) -> None:
        self.counters = dict.fromkeys(COUNTERS, 0)
        self.gauges = dict.fromkeys(GAUGES, 0)
        self.histograms = {name: Histogram() for name in HISTOGRAMS}
        self._running: list[Observation] = []

    def add(self, name: str, n: int = 1) -> None:
        self.counters[name] += n

    def metered(self, scan: DataFrame) -> DataFrame:
        """scan, the records of whose first action are counted."""
        seen = Observation()
        self._running.append(seen)
        return scan.observe(seen, F.count(F.lit(1)).alias("records"))

    def settle(self) -> None:
        """Take in the metered scans whose first action has ended."""
        for seen in [o for o in self._running if o._jo.future().isCompleted()]:
            self._running.remove(seen)
            self.add("scan_records", seen.get["records"])

    def skip_ratio(self) -> float:
        """The share of files in overlapping windows that scans didn't have to read."""
        seen = self.counters["sstable_reads"] + self.counters["sstable_skips"]
        return self.counters["sstable_skips"] / seen if seen else 0.0

    def text(self, prefix: str = "tidemark") -> str:
        """The Prometheus text format."""
        lines = []
        for name, value in self.counters.items():
            lines += [f"# TYPE {prefix}_{name}_total counter", f"{prefix}_{name}_total {value}"]
        for name, value in self.gauges.items():
            lines += [f"# TYPE {prefix}_{name} gauge", f"{prefix}_{name} {value}"]
        for name, h in self.histograms.items():
            lines.append(f"# TYPE {prefix}_{name}_seconds histogram")
            done = 0
            for bound, n in zip(BOUNDS, h.counts, strict=True):
                done += n
                lines.append(f'{prefix}_{name}_seconds_bucket{{le="{"+Inf" if bound == math.inf else bound}"}} {done}')
            lines += [f"{prefix}_{name}_seconds_sum {h.total}", f"{prefix}_{name}_seconds_count {done}"]
        return "\n".join(lines) + "\n"

    def serve(self, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
        """Answer GET /metrics with text() from a thread of its own; shutdown() of what is returned ends it. Port 0: any that is free."""
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer  # not needed by every worker that imports this

        metrics = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                known = self.path == "/metrics"
                body = metrics.text().encode() if known else b"not found"
                self.send_response(200 if known else 404)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_: object) -> None:
                pass

        server = ThreadingHTTPServer((host, port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
