"""Operators on small record fixtures, and properties on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.errors import InvalidBucketWidth
from tidemark.operators import (
    admitted, bucket_aggregate, merged, ordered, partition_listing, rejected, require_records, routed, scan_range, source_counts, total_bytes,
)
from tidemark.options import TOLERANT, Options
from tidemark.schema import FILE_ENTRY, HOUR, NANOS, RECORD
from tidemark.sources import event_records

MINUTE = 60 * NANOS


def frame(spark, rows):
    return spark.createDataFrame([(t, bytearray(s), bytearray(p)) for t, s, p in rows], RECORD)


def rows(df):
    return [(r.ts, bytes(r.source_id), bytes(r.payload)) for r in df.collect()]


def test_half_open_ranges(spark):
    hundred = frame(spark, [(t, b"s", b"") for t in range(0, 1000, 10)])
    for start, end, n in ((0, 1000, 100), (100, 500, 40), (0, 10, 1), (500, 500, 0), (1000, 2000, 0), (600, 500, 0)):
        assert scan_range(hundred, start, end).count() == n


def test_source_filter_tells_empty_from_none(spark):
    df = frame(spark, [(t, s, b"") for t in range(20) for s in (b"alpha", b"beta")] + [(5, b"", b"x")])
    for source, n in ((b"alpha", 20), (b"beta", 20), (None, 41), (b"gamma", 0), (b"", 1)):
        assert scan_range(df, 0, 100, source).count() == n


def test_order_is_by_time_then_unsigned_bytes_and_keeps_repeats(spark):
    given = [(2, b"\x80", b""), (2, b"\x7f\x00", b""), (2, b"", b""), (2, b"\x7f", b""), (1, b"z", b"b"), (1, b"z", b"a"), (1, b"z", b"a")]
    assert rows(ordered(frame(spark, given))) == sorted(given)


def test_merge_keeps_all_rows_of_all_parts(spark):
    a, b = [(1, b"a", b"p1"), (3, b"a", b"p3")], [(2, b"b", b"p2"), (4, b"b", b"p4"), (1, b"a", b"p1")]
    assert rows(merged(frame(spark, a), frame(spark, b), frame(spark, []))) == sorted(a + b)


def test_scan_pushes_predicates_and_prunes_columns(spark, tmp_path, capsys):
    path = str(tmp_path / "r")
    frame(spark, [(1, b"a", b"p")]).write.parquet(path)
    scan_range(spark.read.schema(RECORD).parquet(path), 0, 5, b"a").select("ts").explain("formatted")
    told = capsys.readouterr().out
    assert "GreaterThanOrEqual(ts,0)" in told and "LessThan(ts,5)" in told and "EqualTo(source_id" in told
    assert "ReadSchema: struct<ts:bigint,source_id:binary>" in told


def buckets(df):
    return [(r.bucket_start, r.bucket_end, r["count"], r.rate) for r in df.orderBy("bucket_start").collect()]


def test_counts_and_rates(spark):
    df = frame(spark, [(k * NANOS, b"src-a" if k < 60 else b"src-b", b"") for k in range(120)])
    assert buckets(bucket_aggregate(df, 0, 2 * MINUTE, MINUTE)) == [(0, MINUTE, 60, 1.0), (MINUTE, 2 * MINUTE, 60, 1.0)]
    assert [b[2] for b in buckets(bucket_aggregate(df, 0, 2 * MINUTE, MINUTE, b"src-a"))] == [60, 0]


def test_empty_buckets_partial_last_and_bad_width(spark):
    df = frame(spark, [(90, b"s", b""), (105, b"s", b"")])
    assert buckets(bucket_aggregate(frame(spark, []), 0, MINUTE, MINUTE)) == [(0, MINUTE, 0, 0.0)]
    assert [b[:3] for b in buckets(bucket_aggregate(df, 0, 100, 40))] == [(0, 40, 0), (40, 80, 0), (80, 120, 1)]
    assert bucket_aggregate(df, 10, 10, 5).count() == 0
    assert bucket_aggregate(df, 10, 0, 5).count() == 0
    for width in (0, -1):
        with pytest.raises(InvalidBucketWidth):
            bucket_aggregate(df, 10, 0, width)


def test_buckets_sum_to_the_scan_and_scan_is_the_filter(spark):
    rng = random.Random(42)
    given = [(rng.randrange(-HOUR, HOUR), bytes(rng.choice([b"", b"a", b"\xff"])), bytes(rng.randbytes(3))) for _ in range(800)]
    df = frame(spark, given).cache()
    for _ in range(4):
        start, end = sorted(rng.randrange(-HOUR, HOUR) for _ in range(2))
        expect = sorted(r for r in given if start <= r[0] < end)
        assert rows(ordered(scan_range(df, start, end))) == expect
        found = buckets(bucket_aggregate(df, start, end, rng.randrange(1, HOUR)))
        assert sum(b[2] for b in found) == len(expect)
        assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))


def test_windows_of_negative_times(spark):
    times = [-1, -HOUR, -HOUR - 1, -3661 * NANOS, 0, HOUR - 1, HOUR]
    found = routed(frame(spark, [(t, b"", b"") for t in times]), HOUR).collect()
    assert all(r.part_start <= r.ts < r.part_start + HOUR and r.part_start % HOUR == 0 for r in found) and len(found) == 7


def test_late_is_strictly_older_than_the_window(spark):
    now, options = 100 * HOUR, Options(late_window=300 * NANOS)
    horizon = now - options.late_window
    df = frame(spark, [(horizon, b"", b""), (horizon - 1, b"", b""), (now - 360 * NANOS, b"", b""), (now + HOUR, b"", b"")])
    assert [r[0] for r in rows(ordered(admitted(df, now, options)))] == [horizon, now + HOUR]
    assert rejected(df, now, options).count() == 2
    tolerant = Options(late_mode=TOLERANT)
    assert admitted(df, now, tolerant).count() == 4 and rejected(df, now, tolerant).count() == 0


@pytest.mark.parametrize("bad", [(None, b"", b""), (1, None, b""), (1, b"", None)])
def test_nulls_are_refused(spark, bad):
    df = spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in bad)], "ts long, source_id binary, payload binary")
    with pytest.raises(Exception, match="record without"):
        require_records(df).collect()


def test_empty_fields_and_extra_columns(spark):
    df = frame(spark, [(1, b"", b"")]).withColumn("part_start", F.lit(5))
    assert rows(require_records(df)) == [(1, b"", b"")]
    assert routed(df, 10).first().part_start == 0


def test_sizes_and_counts(spark):
    assert tuple(total_bytes(frame(spark, [(1, b"abc", b"x" * 10)])).first()) == (1, 21)
    assert tuple(total_bytes(frame(spark, [(1, b"s", b"pp"), (2, b"ss", b"p")])).first()) == (2, 22)
    assert tuple(total_bytes(frame(spark, [])).first()) == (0, 0)
    assert {(bytes(r.source_id), r.records) for r in source_counts(frame(spark, [(1, b"a", b""), (1, b"a", b""), (2, b"", b"")])).collect()} == {(b"a", 2), (b"", 1)}


def entries(spark, *rows_):
    return spark.createDataFrame([(p, s, s + 100, lo, hi, 1, 10) for p, s, lo, hi in rows_], FILE_ENTRY)


def test_times_without_zone_are_utc_in_any_session(spark):
    expect = 1_710_037_800_123_456_000  # 2024-03-10T02:30:00.123456Z; New York has no such hour that day
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.123456' as ts, 'a' as event_type, cast(null as string) as props union all select timestamp_ntz'1969-12-31 23:59:59.999999', 'b', ''")
            assert {bytes(r.source_id): r.ts for r in event_records(df).collect()} == {b"a": expect, b"b": -1000}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_states(spark):
    files = entries(spark, ("a", 0, 1, 2), ("b", 100, 101, 102))
    known = spark.createDataFrame([(0, 100), (100, 200), (200, 300)], "partition_start long, partition_end long")
    found = {(r.start, r.state, r.files, r.size_bytes) for r in partition_listing(files, known, 151, 50).collect()}
    assert found == {(0, "sealed", 1, 10), (100, "open", 1, 10), (200, "deleted", 0, 0)}
    assert partition_listing(files, known, 150, 50).first().state == "open"  # not yet past, but at the end
