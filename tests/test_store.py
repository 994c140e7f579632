"""Stores on disk: commits, snapshots, maintenance, restarts."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import tidemark
from tidemark import maintenance
from tidemark.errors import Closed, Conflict, CorruptLog, InvalidBucketWidth, LateArrival, OptionMismatch, OrderViolation, SealedWindow
from tidemark import store as store_module
from tidemark.options import TOLERANT, Options
from tidemark.plans import catalogue
from tidemark.plans.commitlog import Edit, FileEntry, Snapshot
from tidemark.schema import HOUR, NANOS, RECORD
from tidemark.store import Store

DAY = 24 * HOUR
BASE = 1000 * DAY


def frame(spark, rows):
    return spark.createDataFrame([(t, bytearray(s), bytearray(p)) for t, s, p in rows], RECORD)


def rows(df):
    return [(r.ts, bytes(r.source_id), bytes(r.payload)) for r in df.collect()]


def hours(n, each=5, offset=0):
    return [(BASE + h * HOUR + (k + offset) * NANOS, b"src-%d" % (k % 3), b"p%d" % k) for h in range(n) for k in range(each)]


@pytest.fixture
def store(spark, tmp_path):
    return Store.open(spark, str(tmp_path / "s"), Options(late_mode=TOLERANT, max_files_per_partition=3, retention=HOUR))


def test_round_trip_over_windows_and_a_new_opening(spark, store):
    given = hours(3)
    assert store.append(frame(spark, given), now=BASE) == 15
    assert rows(store.scan()) == sorted(given)
    again = Store.open(spark, store.files.root)
    assert rows(again.scan(BASE + HOUR, BASE + 2 * HOUR, b"src-1")) == sorted(r for r in given if BASE + HOUR <= r[0] < BASE + 2 * HOUR and r[1] == b"src-1")
    assert again.metrics.gauges["active_partitions"] == 3
    assert [b["count"] for b in again.aggregate(BASE, BASE + 4 * HOUR, HOUR).orderBy("bucket_start").collect()] == [5, 5, 5, 0]
    assert again.scan(BASE + HOUR, BASE).count() == 0


def test_a_batch_id_is_committed_once(spark, store):
    df = frame(spark, hours(1))
    assert [store.append(df, BASE, "b1"), store.append(df, BASE, "b1"), store.append(df.limit(0), BASE, "b2"), store.append(df, BASE, "b2")] == [5, 0, 0, 0]
    assert store.scan().count() == 5


def test_of_a_stream_the_last_batch_is_kept(spark, store):
    df = frame(spark, hours(1))
    assert [store.append(df, BASE, stream=("s:1", k)) for k in (0, 1, 1, 0)] == [5, 5, 0, 0]
    assert store.append(df.limit(0), BASE, stream=("s:1", 2)) == 0 and store.log.snapshot().streams == {"s:1": 2}
    store.log.checkpoint()
    again = Store.open(spark, store.files.root)
    assert [again.append(df, BASE, stream=x) for x in (("s:1", 2), ("t:1", 0), ("s:1", 3))] == [0, 5, 5]
    assert again.log.snapshot().streams == {"s:1": 3, "t:1": 0} and not again.log.snapshot().batches


def test_strict_mode_leaves_late_records_out_or_raises(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), Options(late_window=0))
    df = frame(spark, [(BASE, b"a", b""), (BASE - 1, b"b", b"")])
    with pytest.raises(LateArrival):
        store.append(df, BASE, on_late="raise")
    assert store.scan().count() == 0 and not store.files.walk("data") or all(not n.endswith(".parquet") for n, _, _ in store.files.walk("data"))
    assert store.append(df, BASE) == 1
    assert rows(store.scan()) == [(BASE, b"a", b"")]
    assert store.metrics.counters["late_arrivals"] == 2 and store.metrics.counters["append_bytes"] == 9


def test_nothing_is_seen_before_the_commit(spark, store, monkeypatch):
    store.append(frame(spark, hours(1)), BASE)

    def broken(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(store.log, "commit", broken)
    with pytest.raises(RuntimeError):
        store.append(frame(spark, hours(1, offset=50)), BASE)
    again = Store.open(spark, store.files.root)
    assert again.scan().count() == 5
    gone = maintenance.vacuum(again, now=(1 << 62), grace=0)
    assert gone and again.scan().count() == 5 and not maintenance.missing(again)


def test_files_outside_the_range_are_skipped(spark, store):
    for k in range(3):
        store.append(frame(spark, [(BASE + k, b"s", b"")]), BASE)
    assert store.scan(BASE + 59 * 60 * NANOS, BASE + 60 * 60 * NANOS).count() == 0
    assert store.metrics.counters["sstable_skips"] == 3 and store.metrics.counters["sstable_reads"] == 0
    assert store.metrics.skip_ratio() == 1.0
    assert "tidemark_sstable_skips_total 3" in store.metrics.text()


def test_compaction_fires_over_the_limit_and_keeps_every_row(spark, store):
    given = []
    for k in range(3):
        part = [*hours(1, offset=k), (BASE, b"same", b"same")]
        given += part
        store.append(frame(spark, part), BASE)
    assert maintenance.compact(store) == 0
    store.append(frame(spark, hours(1, offset=9)), BASE)
    given += hours(1, offset=9)
    before = store.scan()
    assert maintenance.compact(store) == 1
    assert rows(store.scan()) == sorted(given) and len(store.log.snapshot().live) == 1
    assert rows(before) == sorted(given)  # a scan from before still finds its files
    maintenance.vacuum(store, now=(1 << 62), grace=0)
    assert rows(Store.open(spark, store.files.root).scan()) == sorted(given)
    assert store.metrics.counters["compactions"] == 1
    assert maintenance.compact(store) == 0


def test_large_windows_compact_to_several_files(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), Options(late_mode=TOLERANT, max_files_per_partition=1, target_file_bytes=900))
    for k in range(2):
        store.append(frame(spark, [(BASE + m * 60 * NANOS + k, b"s", b"x" * 40) for m in range(60)]), BASE)
    maintenance.compact(store)
    files = sorted(store.log.snapshot().files(), key=lambda e: e.min_ts)
    assert len(files) > 1 and all(a.max_ts < b.min_ts for a, b in zip(files, files[1:], strict=False))
    assert store.scan().count() == 120


@pytest.mark.parametrize("target", [1 << 30, 4000])
def test_no_task_sorts_much_more_than_a_piece_of_a_large_window(spark, tmp_path, monkeypatch, target):
    monkeypatch.setattr(maintenance, "SORT_ROWS", 500)
    monkeypatch.setattr(maintenance, "SORT_BYTES", 1 << 30)
    sorted_rows, write = [], store_module.Store._put_together
    store = Store.open(spark, str(tmp_path / "s"), Options(late_mode=TOLERANT, max_files_per_partition=1, target_file_bytes=target))

    def seen(self, folder):
        pieces = self.spark.read.schema("ts long").option("recursiveFileLookup", "true").parquet(f"{self.files.root}/{folder}")
        sorted_rows.extend(r["n"] for r in pieces.groupBy(F.col("_metadata.file_path")).agg(F.count(F.lit(1)).alias("n")).collect())
        write(self, folder)

    monkeypatch.setattr(store_module.Store, "_put_together", seen)
    given = []
    for k in range(2):  # one time has most records of a window, all of them equal; another window has few
        part = [(BASE + m * 60 * NANOS + k, f"s{m % 7}".encode(), b"x%d" % m) for m in range(60)] + [(BASE + 7, b"s", b"same")] * 2000 + [(BASE + 2 * HOUR, b"s", b"y")]
        given += part
        store.append(frame(spark, part), BASE)
    assert maintenance.compact(store) == 2
    assert sum(sorted_rows) == len(given) and 1 < len(sorted_rows) and max(sorted_rows) < 1000
    files = sorted(store.log.snapshot().files(), key=lambda e: e.min_ts)
    assert sum(e.partition_start == BASE for e in files) == (1 if target > 4000 else len(files) - 1) and all(a.max_ts < b.min_ts for a, b in zip(files, files[1:], strict=False))
    assert rows(store.scan()) == sorted(given) and store.unordered() == []


@pytest.mark.parametrize("most", [1 << 20, 100])
def test_an_append_by_windows_makes_one_file_of_each_in_tasks_of_their_own(spark, store, monkeypatch, most):
    monkeypatch.setattr(store_module, "SORT_ROWS", most)
    given = hours(4, each=150) + [(BASE, b"src-0", b"late")] * 9
    assert store.append(frame(spark, given).repartition(3), BASE, layout="windows") == len(given)
    live = store.log.snapshot().files()
    assert len(live) == len({e.partition_start for e in live}) == 4 and sum(e.record_count for e in live) == len(given)
    assert sorted(rows(store.scan())) == sorted(given) and store.unordered() == []
    assert store.append(frame(spark, []), BASE, layout="windows") == 0 and len(store.log.snapshot().live) == 4


def test_no_task_has_all_events_of_a_store_of_batches(spark, tmp_path, monkeypatch):
    events = spark.range(3000).selectExpr(f"timestamp_micros({catalogue.JAN // 1000} + id % 30 * {DAY // 1000} + id) as ts", "element_at(array('click', 'error', 'purchase', 'signup', 'view'), cast(id % 5 + 1 as int)) as event_type", "'p' as props")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    tasks, sort = [], DataFrame.sortWithinPartitions

    def seen(self, *columns, **more):
        tasks.append(self.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return sort(self, *columns, **more)

    monkeypatch.setattr(type(events), "sortWithinPartitions", seen)
    monkeypatch.setattr(store_module, "SORT_ROWS", 99)  # of the 100 in a window
    store = catalogue.batches_store(spark, str(tmp_path), 30)
    assert len(store.log.snapshot().live) == 30 and max(tasks) < 300


def test_parts_of_an_ordered_scan_are_tasks_of_their_own(spark, store):
    given = hours(6, each=7)
    store.append(frame(spark, given).coalesce(1), BASE)
    store.append(frame(spark, given[:9]).coalesce(1), BASE)
    sizes = store.scan().rdd.glom().map(len).collect()
    assert len([n for n in sizes if n]) == 6 and max(sizes) < len(given) and [tuple(map(bytes, r[1:])) for r in store.scan().collect()][-1] == given[-1][1:]


def test_retention_goes_by_the_newest_record_of_a_file(spark, store):
    now = BASE + 10 * HOUR
    store.append(frame(spark, [(now - 2 * HOUR, b"old", b"")]), BASE)
    store.append(frame(spark, [(now - HOUR, b"edge", b"")]), BASE)
    store.append(frame(spark, [(now - HOUR - 5, b"mixed", b"")] + [(now - HOUR + 1, b"mixed", b"")]), BASE)
    gone = maintenance.expire(store, now)
    assert {e.max_ts for e in gone} <= {now - 2 * HOUR, now - HOUR - 5}
    assert (now - 2 * HOUR) in {e.max_ts for e in gone}
    assert store.scan(now - 3 * HOUR, now - HOUR - HOUR // 2).count() == 0
    assert {r[1] for r in rows(store.scan())} >= {b"edge", b"mixed"}
    states = {r.start: r.state for r in store.partitions(now).collect()}
    assert states[now - 2 * HOUR] == "deleted"
    assert maintenance.expire(Store.open(spark, store.files.root, Options(late_mode=TOLERANT)), now) == []


def test_two_writers_never_take_one_number(spark, store):
    other = Store.open(spark, store.files.root, store.options)
    store.append(frame(spark, hours(1)), BASE)
    other.append(frame(spark, hours(1, offset=9)), BASE)
    assert [e.seq for e in store.log.edits()] == [1, 2] and store.scan().count() == 10
    assert not store.files.create("_log/%020d.json" % 2, b"{}")
    entry = store.log.snapshot().files()[0]
    other.log.commit("expire", [], [entry.path])
    with pytest.raises(Conflict):
        store.log.commit("compact", [], [entry.path])


def test_checkpoints_stand_for_the_edits_before(spark, store):
    for k in range(3):
        store.append(frame(spark, hours(1, offset=k)), BASE, f"b{k}")
    store.log.checkpoint()
    store.append(frame(spark, hours(1, offset=9)), BASE)
    for k in (1, 2, 3):
        store.files.delete("_log/%020d.json" % k)
    again = Store.open(spark, store.files.root, store.options)
    assert again.scan().count() == 20 and again.append(frame(spark, hours(1)), BASE, "b1") == 0


def test_broken_logs_are_errors(spark, store):
    store.append(frame(spark, hours(1)), BASE)
    store.files.create("_log/%020d.json" % 3, json.dumps({"seq": 3, "kind": "append", "batch_id": None, "added": [], "deleted": []}).encode())
    with pytest.raises(CorruptLog, match="missing"):
        Store.open(spark, store.files.root)
    store.files.create("_log/%020d.json" % 2, b'{"seq": 2')
    with pytest.raises(CorruptLog):
        Store.open(spark, store.files.root)


def test_closing_and_options(spark, store):
    store.append(frame(spark, hours(1)), BASE)
    store.close()
    store.close()
    for call in (lambda: store.scan(), lambda: store.append(frame(spark, []), 0), lambda: store.aggregate(0, 1, 1)):
        with pytest.raises(Closed):
            call()
    with pytest.raises(InvalidBucketWidth):
        store.aggregate(0, 1, 0)
    assert store.partitions(BASE).count() == 1
    with pytest.raises(OptionMismatch):
        Store.open(spark, store.files.root, Options(partition_duration=5))
    for bad in ({"compression": "gzip"}, {"late_mode": "x"}, {"partition_duration": 0}, {"retention": -1}):
        with pytest.raises(ValueError):
            Options(**bad)


@pytest.mark.parametrize("codec", ["none", "zstd", "snappy"])
def test_codecs(spark, tmp_path, codec):
    store = Store.open(spark, str(tmp_path / "s"), Options(late_mode=TOLERANT, compression=codec, index_sources=True))
    given = [(1_000_000 + 1000 * k, b"sensor", bytes(256)) for k in range(50)] + [(0, b"", b"")]
    store.append(frame(spark, given), BASE)
    assert rows(store.scan()) == sorted(given)


def test_history_and_inspection(spark, store):
    store.append(frame(spark, hours(1)), BASE, "first")
    path = store.log.snapshot().files()[0].path
    assert [(r.seq, r.kind, r.batch_id, r.added) for r in store.history().collect()] == [(1, "append", "first", True)]
    assert store.inspect_file(path).first().record_count == 5 and store.inspect_file("no").count() == 0
    assert store.append(frame(spark, []), BASE) == 0 and len(store.log.edits()) == 1


def test_store_paths_move_with_the_store(spark, store, tmp_path):
    store.append(frame(spark, hours(2)), BASE)
    (tmp_path / "s").rename(tmp_path / "moved")
    assert Store.open(spark, str(tmp_path / "moved")).scan().count() == 10


def entry(path, start, lo, hi, n=1):
    return FileEntry(path, start, start + HOUR, lo, hi, n, 10)


def test_choices_of_files():
    files = [entry(k, 0, 0, t) for k, t in (("a", 100), ("b", 500), ("c", 1000))]
    fifo = maintenance.Fifo(3)
    assert [e.path for e in fifo.pick_expired(files, 501)] == ["a", "b"] and fifo.pick_expired(files, 100) == []
    assert fifo.pick_merge(files) == [] and len(fifo.pick_merge([*files, entry("d", 0, 0, 1)])) == 4


def test_edits_fold_to_what_is_live():
    s = Snapshot()
    s.apply(Edit(1, "append", (entry("a", 0, 1, 2), entry("b", 0, 1, 2))))
    s.apply(Edit(2, "compact", (entry("c", HOUR, 1, 2),), ("a",)))
    assert sorted(s.live) == ["b", "c"] and s.windows == {0: HOUR, HOUR: 2 * HOUR} and s.seq == 2


def test_windows_and_files_of_a_range(spark, store):
    store.append(frame(spark, hours(4, each=1)), BASE)
    for start, end, n in ((30, 90, 2), (0, 120, 2), (-60, 0, 0), (60, 60, 0), (61, 62, 1), (240, 300, 0), (239, 300, 1)):
        windows, files = store.pick(BASE + start * 60 * NANOS, BASE + end * 60 * NANOS)
        assert len({e.partition_start for e in windows}) == n, (start, end)
        assert set(files) <= set(windows) and all(e.max_ts >= BASE + start * 60 * NANOS and e.min_ts < BASE + end * 60 * NANOS for e in files)


@pytest.mark.parametrize("layout", ["auto", "range", "clustered"])
def test_layouts_write_the_same_records(spark, tmp_path, layout):
    store = Store.open(spark, str(tmp_path / "s"), Options(late_mode=TOLERANT, check_order=True))
    given = hours(3, each=40)
    assert store.append(frame(spark, given).repartition(5), BASE, layout=layout) == 120
    assert rows(store.scan()) == sorted(given) and store.unordered() == []
    assert store.append(frame(spark, given).repartition(1).sortWithinPartitions("ts"), BASE, layout=layout) == 120
    assert rows(store.scan()) == sorted(given * 2)
    with pytest.raises(ValueError):
        store.append(frame(spark, given), BASE, layout="no")


def test_auto_shuffles_only_what_is_mixed_or_little(spark, store, monkeypatch):
    df = frame(spark, hours(8, each=50))
    assert not store._clustered(df.repartitionByRange(4, "ts")) and store._clustered(df.coalesce(1)) and store._clustered(df.limit(0))
    monkeypatch.setattr(store_module, "CLUSTERED_ROWS", 5)
    assert store._clustered(df.repartitionByRange(4, "ts")) and not store._clustered(df.repartition(4))


def test_ordered_scans_shuffle_nothing_where_files_do_not_overlap(spark, store, monkeypatch):
    given = hours(6, each=7)
    store.append(frame(spark, given).coalesce(1), BASE)
    store.append(frame(spark, given[:9]).coalesce(1), BASE)  # overlaps the first two hours
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(store.scan()) and rows(store.scan()) == sorted(given + given[:9])
    expect = sorted(r for r in given + given[:9] if BASE + 5 <= r[0] < BASE + 3 * HOUR and r[1] == b"src-0")
    assert rows(store.scan(BASE + 5, BASE + 3 * HOUR, b"src-0")) == expect
    monkeypatch.setattr(store_module, "PART_BYTES", 10)  # groups too large for a task
    assert "Exchange" in plan(store.scan()) and rows(store.scan()) == sorted(given + given[:9])


def test_ordered_scans_of_many_files_sort_some_together(spark, store):
    given = hours(40, each=2)
    store.append(frame(spark, given).coalesce(1), BASE)
    plan = store.scan()._jdf.queryExecution().executedPlan().toString()
    assert len(store.log.snapshot().live) == 40 and "Exchange" not in plan and 1 < plan.count("FileScan") < 40
    assert rows(store.scan()) == sorted(given)


def test_a_file_in_several_splits_is_read_in_order(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), Options(late_mode=TOLERANT, partition_duration=DAY, row_group_bytes=20_000))
    records = spark.range(30_000).selectExpr("id as ts", "cast('s' as binary) as source_id", "cast(sha2(cast(id as string), 512) as binary) as payload")
    store.append(records.coalesce(1), BASE)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        assert store.scan(ordered=False).rdd.getNumPartitions() > 10
        plan = store.scan()._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and [r.ts for r in store.scan().collect()] == list(range(30_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sealed_windows_refuse_records(spark, tmp_path):
    options = Options(late_mode=TOLERANT, late_window=60 * NANOS, reject_sealed=True)
    store = Store.open(spark, str(tmp_path / "s"), options)
    now = BASE + HOUR + 60 * NANOS + 1  # just past the end of the first window and the late window
    df = frame(spark, [(BASE, b"sealed", b""), (BASE + HOUR, b"late but open", b"")])
    with pytest.raises(SealedWindow):
        store.append(df, now, on_late="raise")
    assert store.append(df, now) == 1 and store.metrics.counters["late_arrivals"] == 2
    assert store.append(df, now - 1) == 2


def test_files_out_of_order_are_refused(spark, tmp_path, monkeypatch):
    store = Store.open(spark, str(tmp_path / "s"), Options(late_mode=TOLERANT, check_order=True))
    store.append(frame(spark, [(1, b"a", b""), (1, b"b", b""), (2, b"\x80", b"")]).coalesce(1), BASE)
    assert store.unordered() == []
    for bad in ([(2, b"a", b""), (1, b"a", b"")], [(1, b"b", b""), (1, b"a", b"")]):
        frame(spark, bad).coalesce(1).write.parquet(f"{store.files.root}/data/x{bad[0][0]}")
        path = next(n for n, _, _ in store.files.walk(f"data/x{bad[0][0]}") if n.endswith(".parquet"))
        assert store.unordered([FileEntry(path, 0, HOUR, 1, 2, 2, 1)]) == [path]
    monkeypatch.setattr(store, "unordered", lambda entries: [entries[0].path])
    with pytest.raises(OrderViolation):
        store.append(frame(spark, hours(1)), BASE)
    assert store.scan().count() == 3


def test_scans_are_counted(spark, store):
    store.append(frame(spark, hours(2)), BASE)
    assert len(list(store.rows(BASE, BASE + HOUR))) == 5 and store.metrics.counters["scan_records"] == 5
    metered = store.scan(metered=True)
    store.metrics.settle()
    assert store.metrics.counters["scan_records"] == 5
    assert len(metered.collect()) == 10
    store.metrics.settle()
    store.metrics.settle()
    assert store.metrics.counters["scan_records"] == 15 and store.count_scan() == 10
    assert sum(store.metrics.histograms["scan_duration"].counts) == 2


def test_metrics_are_served(spark, store):
    store.append(frame(spark, hours(1)), BASE)
    server = store.metrics.serve()
    at = f"http://127.0.0.1:{server.server_port}"
    assert "tidemark_appends_total 5" in urllib.request.urlopen(f"{at}/metrics").read().decode()
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{at}/other")
    server.shutdown()


def test_appends_beside_scans_and_compaction(spark, store):
    """One writer appends batches while another compacts and a reader scans: every state seen is a whole number of batches, and none is lost."""
    seen, failed = [], []

    def write():
        try:
            for k in range(6):
                store.append(frame(spark, hours(1, offset=k * 10)).coalesce(1), BASE, f"b{k}")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    other = Store.open(spark, store.files.root, store.options)
    writer = threading.Thread(target=write)
    writer.start()
    while writer.is_alive():
        seen.append(other.scan().count())
        try:
            maintenance.compact(other)
        except Conflict:
            pass
    writer.join()
    assert not failed and all(n % 5 == 0 for n in seen) and seen == sorted(seen)
    assert store.scan().count() == 30 and len(store.log.snapshot().batches) == 6


def test_a_writer_that_is_lost_after_its_data_leaves_nothing_to_see(spark, store, monkeypatch):
    for k in range(2):
        store.append(frame(spark, hours(1, offset=k)), BASE, f"b{k}")
    create = store.files.create
    monkeypatch.setattr(store.files, "create", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    for attempt in (lambda: store.append(frame(spark, hours(1, offset=5)), BASE, "b2"), lambda: maintenance.compact(store, maintenance.Fifo(1))):
        with pytest.raises(RuntimeError):
            attempt()
    again = Store.open(spark, store.files.root, store.options)
    assert again.scan().count() == 10 and not maintenance.missing(again)
    monkeypatch.setattr(store.files, "create", create)
    assert again.append(frame(spark, hours(1, offset=5)), BASE, "b2") == 5  # the batch comes again
    assert again.append(frame(spark, hours(1, offset=5)), BASE, "b2") == 0
    assert maintenance.vacuum(again, now=(1 << 62), grace=0) and rows(again.scan()) == sorted([*hours(1), *hours(1, offset=1), *hours(1, offset=5)])


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    found = {}
    for indexed in (False, True):
        store = Store.open(spark, str(tmp_path / f"s{indexed}"), Options(late_mode=TOLERANT, index_sources=indexed, partition_duration=DAY))
        # so many sources that no dictionary holds them all; one that is absent lies between the least and the greatest
        many = spark.range(60_000).selectExpr("id as ts", "cast(concat('source-', sha2(cast(id as string), 256)) as binary) as source_id", "cast('' as binary) as payload")
        store.append(many.coalesce(1), BASE)
        absent = store.scan(source=b"source-8", ordered=False)
        assert absent.collect() == []
        plan = absent._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        found[indexed] = leaf.metrics().get("numOutputRows").get().value()
    assert found[True] == 0 < found[False]


def test_the_package_has_the_public_names():
    assert tidemark.Store is Store and all(hasattr(tidemark, name) for name in tidemark.__all__)


def test_negative_times(spark, store):
    given = [(t, b"s", b"") for t in (-1, -HOUR, -HOUR - 1, 0)]
    store.append(frame(spark, given), BASE)
    assert rows(store.scan(-2 * HOUR, 1)) == sorted(given)
    assert [r.start for r in store.partitions(0).collect()] == [-2 * HOUR, -HOUR, 0]


def test_bad_records_write_nothing(spark, store):
    df = frame(spark, hours(1)).withColumn("payload", F.when(F.col("ts") % (2 * NANOS) == 0, F.col("payload")))
    with pytest.raises(Exception, match="record without payload"):
        store.append(df, BASE)
    assert store.scan().count() == 0
