"""A store of records: Parquet files by time window behind a commit log."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import Closed, LateArrival, OptionMismatch, OrderViolation, SealedWindow
from tidemark.metrics import Metrics
from tidemark.operators import admission, aggregate, lifecycle, route, scan
from tidemark.options import STRICT, Options
from tidemark.plans.commitlog import CommitLog, FileEntry, Snapshot
from tidemark.plans.files import Files
from tidemark.schema import FILE_ENTRY, MAX_TS, MIN_TS, RECORD, record_size, window_start, window_start_of

#: An ordered scan's parts: bytes on disk of each, and how many before a sort by ranges is the better plan.
PART_BYTES, PARTS = 256 << 20, 200
#: Records that a file should have at least where an append doesn't shuffle.
CLUSTERED_ROWS = 20_000
#: What one task sorts of a file that has more: records, and bytes on disk.
SORT_ROWS, SORT_BYTES = 1 << 20, 128 << 20


class Store:
    """Use Store.open(). Every method that depends on the time takes now (nanoseconds)."""

    def __init__(self, spark: SparkSession, files: Files, options: Options) -> None:
        self.spark, self.files, self.options = spark, files, options
        self.log = CommitLog(files)
        self.metrics = Metrics()
        self.closed = False
        self._gauge(self.log.snapshot())

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        """Open or make a store. Without options the partition duration is the store's own."""
        files = Files(spark, path)
        if not files.exists("_meta.json"):
            files.make_folder("_log")
            files.create("_meta.json", json.dumps({"format": 1, "partition_duration_ns": (options or Options()).partition_duration}).encode())
        duration = json.loads(files.read("_meta.json"))["partition_duration_ns"]
        if options and options.partition_duration != duration:
            raise OptionMismatch(f"the store's windows have {duration} ns, not {options.partition_duration}")
        return cls(spark, files, options or replace(Options(), partition_duration=duration))

    def close(self) -> None:
        """Later appends, scans and aggregates raise; closing again does nothing."""
        self.closed = True

    def _open(self) -> None:
        if self.closed:
            raise Closed(self.files.root)

    def _gauge(self, snapshot: Snapshot) -> None:
        live = snapshot.live.values()
        self.metrics.gauges |= {"active_partitions": len({e.partition_start for e in live}), "sstable_files": len(live), "sstable_bytes": sum(e.size_bytes for e in live)}

    # writing

    def append(self, records: DataFrame, now: int, batch_id: str | None = None, on_late: str = "drop", layout: str = "auto", stream: tuple[str, int] | None = None) -> int:
        """Write records in one commit; how many were let in.

        Refused records (late ones in strict mode, those of sealed windows with reject_sealed) are left out and
        counted, or, with on_late "raise", LateArrival or SealedWindow is raised and nothing kept. A batch_id that was
        committed before makes this do nothing and return 0, as does a stream's batch (its id and number) that isn't
        after the last one committed. A null in a record raises, and nothing is written.
        Refused records are counted by the job that writes the others. layout: see write().
        """
        self._open()
        if on_late not in ("drop", "raise"):
            raise ValueError("on_late is drop or raise")
        if self.log.snapshot().knows(batch_id, stream):
            return 0
        added, seen = self.write(admission.require_records(records), refuse=admission.refused(now, self.options), layout=layout)
        if seen["refused"] and on_late == "raise":
            self.discard([e.path for e in added])
            self.metrics.add("late_arrivals", seen["refused"])
            if self.options.late_mode == STRICT:
                raise LateArrival(f"{seen['refused']} records are late")
            raise SealedWindow(f"{seen['refused']} records are of sealed windows")
        if added or batch_id is not None or stream is not None:
            after = self.log.commit("append", added, [], batch_id, stream=stream)
            if after is None:  # another writer was first with this batch
                self.discard([e.path for e in added])
                return 0
            self._gauge(after)
        kept = sum(e.record_count for e in added)
        self.metrics.add("appends", kept)
        self.metrics.add("append_bytes", seen["bytes"])
        self.metrics.add("late_arrivals", seen["refused"])
        self.metrics.add("memtable_flushes", 1 if added else 0)
        self.metrics.add("bytes_flushed", sum(e.size_bytes for e in added))
        return kept

    def _clustered(self, records: DataFrame) -> bool:
        """Whether each task's records already are of a small part of the whole time, and enough for the files they would make. Reads no column but ts."""
        duration = self.options.partition_duration
        each = records.select("ts").groupBy(F.spark_partition_id().alias("task")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
        a, b = F.col("a"), F.col("b")
        windows = window_start(b, duration) / duration - window_start(a, duration) / duration + 1
        tasks, rows, files, spans, whole = each.agg(F.count(F.lit(1)), F.sum("n"), F.sum(windows), F.sum(b.cast("double") - a), F.max("b").cast("double") - F.min("a")).first()
        return tasks <= 1 or (files * CLUSTERED_ROWS <= rows and spans <= 2 * whole)

    def _by_windows(self, records: DataFrame) -> tuple[dict[int, int], int]:
        """One file for each window of these records, and the number of pieces to sort, for write()."""
        each = route.routed(records, self.options.partition_duration).groupBy("part_start").agg(F.count(F.lit(1)).alias("n"), F.sum(record_size()).alias("size")).collect()
        large = any(r["n"] > SORT_ROWS or r["size"] > SORT_BYTES for r in each)
        pieces = max(2, -(-sum(r["n"] for r in each) // SORT_ROWS), -(-sum(r["size"] for r in each) // SORT_BYTES)) if large else 1
        return {r["part_start"]: 1 for r in each}, pieces

    def write(self, records: DataFrame, split: dict[int, int] | None = None, refuse: Column | None = None, layout: str = "auto", pieces: int = 1) -> tuple[list[FileEntry], dict[str, int]]:
        """Data files with these records, not yet committed; and how many bytes they have and how many records were refused.

        layout "range": rows are dealt by ranges of (window, ts), so a window with most of the rows is written by
        many tasks, and each file covers a narrow range of time. "clustered": each task sorts and writes what it
        has, without a shuffle. "auto": clustered, if the tasks' times hardly overlap as they are. "windows": each
        window makes one file, which takes a pass that counts the records of each. With split, each
        window makes that many files instead, of equal stretches of time. A task sorts whole files then; with
        pieces over 1, as many tasks sort equal parts of all the records (with a column `row`, equal records are
        parted by it), and files of several parts are put together from them without a sort.
        """
        if layout not in ("auto", "range", "clustered", "windows"):
            raise ValueError("layout is auto, range, clustered or windows")
        if layout == "windows":
            split, pieces = self._by_windows(records)
        folder = f"data/{uuid.uuid4().hex}"
        dealt = route.routed(records, self.options.partition_duration)
        folders = ["part_start"]
        if split:
            duration = self.options.partition_duration
            several = [F.lit(x).cast("long") for start, n in split.items() if n > 1 for x in (start, n)]
            # a stretch's number goes by hundredths of a millionth of the window, so that the product stays within 64 bits
            place = F.call_function("div", F.col("ts") - F.col("part_start"), F.lit(max(1, duration // 100_000_000)).cast("long"))
            stretch = F.call_function("div", place * F.coalesce(F.create_map(*several)[F.col("part_start")], F.lit(1)), F.lit(duration // max(1, duration // 100_000_000) + 1).cast("long")) if several else F.lit(0)
            dealt = dealt.withColumn("stretch", stretch)
            folders.append("stretch")
            if pieces > 1:
                # behind time and source, so that records of one time and source are parted as well
                tie = [F.col("row")] if "row" in records.columns else []
                dealt = dealt.repartitionByRange(pieces, *folders, "ts", "source_id", F.xxhash64("payload"), *tie).drop("row")
            else:
                dealt = dealt.drop("row").repartition(sum(split.values()), *folders)
        elif layout == "range" or (layout == "auto" and not self._clustered(records)):
            dealt = dealt.repartitionByRange("part_start", "ts")
        # behind the shuffle, as the choice of ranges reads what is before it once more
        seen, refuse = Observation(), F.lit(False) if refuse is None else refuse
        told = dealt.observe(seen, F.sum(F.when(~refuse, record_size())).alias("bytes"), F.count(F.when(refuse, 1)).alias("refused")).where(~refuse)
        writer = told.sortWithinPartitions(*folders, "ts", "source_id").write.partitionBy(*folders)
        writer.options(**self.options.writer_options()).parquet(f"{self.files.root}/{folder}")
        counts = {name: n or 0 for name, n in seen.get.items()}
        if not any(n.endswith(".parquet") for n, _, _ in self.files.walk(folder)):
            return [], counts
        if pieces > 1:
            self._put_together(folder)
        written = self.spark.read.schema("ts long").option("recursiveFileLookup", "true").parquet(f"{self.files.root}/{folder}")
        stats = aggregate.file_stats(written.select("ts", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")), "path", "size")
        found = []
        for r in stats.collect():  # a row for each new file
            name = folder + r["path"].rpartition(folder)[2]
            start = window_start_of(r["min_ts"], self.options.partition_duration)
            found.append(FileEntry(name, start, start + self.options.partition_duration, r["min_ts"], r["max_ts"], r["record_count"], r["size"]))
        if self.options.check_order and (bad := self.unordered(found)):
            self.discard([e.path for e in found])
            raise OrderViolation(f"rows out of order in {', '.join(bad[:3])}")
        return sorted(found, key=lambda e: (e.partition_start, e.path)), counts

    def _put_together(self, folder: str) -> None:
        """Of a folder of sorted pieces, numbered in order, replace those of one window and stretch by one file, which a task writes as it reads them."""
        found: dict[str, list[str]] = {}
        for name, _, _ in self.files.walk(folder):
            if name.endswith(".parquet"):
                found.setdefault(name.rpartition("/")[0], []).append(name)
        several = [sorted(names, key=lambda n: (len(n), n)) for names in found.values() if len(names) > 1]
        while several:
            some = [several.pop()]
            while several and sum(map(len, some)) + len(several[-1]) <= PARTS:  # pieces in one plan
                some.append(several.pop())
            read = lambda name: self.spark.read.schema(RECORD).parquet(f"{self.files.root}/{name}").coalesce(1)
            files = [reduce(DataFrame.unionAll, map(read, names)).coalesce(1) for names in some]
            self._side_by_side(files, some[0][0]).write.options(**self.options.writer_options()).parquet(f"{self.files.root}/{folder}/whole-{uuid.uuid4().hex}")
            self.discard([name for names in some for name in names])

    def _side_by_side(self, parts: list[DataFrame], path: str) -> DataFrame:
        """The union of frames of one partition each, in tasks of their own, one after the other. path: any data file.

        Spark 4.1 puts frames that all have one partition into one task; beside a read, which could have more, it doesn't. That read has no rows.
        """
        none = self.spark.read.schema(RECORD).parquet(f"{self.files.root}/{path}").where("ts is null")
        return reduce(DataFrame.unionAll, [*parts, none]) if len(parts) > 1 else parts[0]

    def unordered(self, entries: list[FileEntry] | None = None) -> list[str]:
        """Of live files (or these) those in which a row comes before one with an earlier time, or an earlier source at the same time."""
        entries = self.log.snapshot().files() if entries is None else entries
        if not entries:
            return []
        rows = self.read_files(entries).select("ts", "source_id", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("k"))
        before = F.lag(F.struct("ts", "source_id")).over(Window.partitionBy("path").orderBy("k"))
        bad = rows.select("path", (before > F.struct("ts", "source_id")).alias("bad")).where("bad").select("path").distinct()
        return sorted("data/" + r["path"].rpartition("/data/")[2] for r in bad.collect())

    def discard(self, paths: list[str]) -> None:
        for p in paths:
            self.files.delete(p)

    # reading

    def read_files(self, entries: list[FileEntry]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(*[f"{self.files.root}/{e.path}" for e in entries])

    def pick(self, start: int, end: int) -> tuple[list[FileEntry], list[FileEntry]]:
        """Live files of windows that overlap [start, end), and those of them whose own times do, by time."""
        duration = self.options.partition_duration
        windows = [e for e in self.log.snapshot().live.values() if e.partition_start < end and e.partition_start + duration > start] if start < end else []
        picked = [e for e in windows if e.max_ts >= start and e.min_ts < end]
        return windows, sorted(picked, key=lambda e: (e.min_ts, e.max_ts, e.path))

    def scan(self, start: int = MIN_TS, end: int = MAX_TS, source: bytes | None = None, ordered: bool = True, metered: bool = False) -> DataFrame:
        """Records of [start, end) of the state at this call, by (ts, source_id) unless ordered is False; equal keys in any order.

        Files outside the range are dropped by the log; Parquet statistics drop row groups and pages of the others.
        With metered, the records of the result's first action are added to the metrics by the next metrics.settle().
        """
        self._open()
        windows, picked = self.pick(start, end)
        self.metrics.add("sstable_reads", len(picked))
        self.metrics.add("sstable_skips", len(windows) - len(picked))
        self.metrics.add("scans")
        found = self._in_order(picked, start, end, source) if ordered else scan.scan_range(self.read_files(picked), start, end, source)
        return self.metrics.metered(found) if metered else found

    def _in_order(self, files: list[FileEntry], start: int, end: int, source: bytes | None) -> DataFrame:
        """Files that overlap in time are one group; the groups come one after the other in tasks of their own, so nothing is shuffled.

        A file's rows are in order as they were written, so a group of one file is only read; others are sorted. If
        there are many groups, as each costs some planning, those that follow each other are sorted in one task
        together. With too many tasks for that, or a group too large for one, all is sorted by ranges.
        """
        groups: list[list[FileEntry]] = []
        reach = MIN_TS
        for e in files:  # by min_ts
            if groups and e.min_ts <= reach:
                groups[-1].append(e)
            else:
                groups.append([e])
            reach = max(reach, e.max_ts) if len(groups[-1]) > 1 else e.max_ts
        bytes_of = lambda g: sum(e.size_bytes for e in g)
        cores = max(1, self.spark.sparkContext.defaultParallelism)
        if len(groups) > 4 * cores:
            each = min(PART_BYTES, -(-bytes_of(files) // cores))
            parts: list[list[FileEntry]] = [[]]
            for group in groups:
                if parts[-1] and bytes_of(parts[-1]) + bytes_of(group) // 2 > each:
                    parts.append([])
                parts[-1] += group
            groups = parts
        if not groups or len(groups) > max(PARTS, 4 * cores) or any(len(g) > 1 and bytes_of(g) > 2 * PART_BYTES for g in groups):
            return scan.ordered(scan.scan_range(self.read_files(files), start, end, source), ties=False)
        found = [scan.scan_range(self.read_files(g), start, end, source).coalesce(1) for g in groups]
        return self._side_by_side([p if len(g) == 1 else p.sortWithinPartitions("ts", "source_id") for p, g in zip(found, groups, strict=True)], files[0].path)

    def rows(self, start: int = MIN_TS, end: int = MAX_TS, source: bytes | None = None) -> Iterator[Row]:
        """A scan's records one by one, in order, a part at a time; their number and the seconds until the last go to the metrics."""
        began, n = time.monotonic(), 0
        try:
            for row in self.scan(start, end, source).toLocalIterator(prefetchPartitions=True):
                n += 1
                yield row
        finally:
            self.metrics.add("scan_records", n)
            self.metrics.histograms["scan_duration"].observe(time.monotonic() - began)

    def count_scan(self, *args, **more) -> int:
        """The number of records of a scan, added to the metric scan_records."""
        began = time.monotonic()
        n = self.scan(*args, **more, ordered=False).count()
        self.metrics.add("scan_records", n)
        self.metrics.histograms["scan_duration"].observe(time.monotonic() - began)
        return n

    def aggregate(self, start: int, end: int, width: int, source: bytes | None = None) -> DataFrame:
        """See operators.bucket_aggregate. Reads no column but ts (and source_id, if given)."""
        if width <= 0:
            return aggregate.bucket_aggregate(self.spark.createDataFrame([], RECORD), start, end, width)  # raises
        self._open()
        live = self.log.snapshot().files(start, end) if start < end else []
        return aggregate.bucket_aggregate(self.read_files(live), start, end, width, source)

    def file_frame(self) -> DataFrame:
        return self.log.snapshot().frame(self.spark)

    def partitions(self, now: int) -> DataFrame:
        """Every window that ever had records: start, end, state, files, size_bytes. Also of a closed store."""
        snapshot = self.log.snapshot()
        known = self.spark.createDataFrame(sorted(snapshot.windows.items()), "partition_start long, partition_end long")
        return lifecycle.partition_listing(snapshot.frame(self.spark), known, now, self.options.late_window)

    def history(self) -> DataFrame:
        """seq, kind, batch_id, path, added of every change of a file, in order."""
        rows = [(e.seq, e.kind, e.batch_id, p, a) for e in self.log.edits() for p, a in [*((x.path, True) for x in e.added), *((x, False) for x in e.deleted)]]
        return self.spark.createDataFrame(rows, "seq long, kind string, batch_id string, path string, added boolean").orderBy("seq", "added", "path")

    def inspect_file(self, path: str) -> DataFrame:
        entry = self.log.snapshot().live.get(path)
        return self.file_frame().where(F.col("path") == path) if entry else self.spark.createDataFrame([], FILE_ENTRY)
