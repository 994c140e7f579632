import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.options import TOLERANT, Options
from tidemark.schema import HOUR, RECORD
from tidemark.sources import single_record
from tidemark.store import Store
from tidemark.streaming import write_stream


def write_all(spark, store, source, checkpoint, name="s", merge=False):
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(source)
    write_stream(stream, store, checkpoint, lambda: 0, name, merge).trigger(availableNow=True).start().awaitTermination()


def times(store):
    return sorted(r.ts for r in store.scan().collect())


def test_batches_are_committed_once(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    store = Store.open(spark, str(tmp_path / "s"), Options(late_mode=TOLERANT, max_files_per_partition=1))
    for k in range(3):
        single_record(spark, k, b"a", b"p%d" % k).write.mode("append").parquet(source)
    write_all(spark, store, source, check)
    write_all(spark, store, source, check)  # nothing new
    assert times(store) == [0, 1, 2]
    single_record(spark, 9, b"a", b"p9").write.mode("append").parquet(source)
    write_all(spark, store, source, check, merge=True)
    assert times(store) == [0, 1, 2, 9] and len(store.log.snapshot().live) == 1


def test_a_lost_checkpoint_is_an_error_and_no_loss(spark, tmp_path):
    source = str(tmp_path / "in")
    store = Store.open(spark, str(tmp_path / "s"), Options(late_mode=TOLERANT))
    single_record(spark, 0, b"a", b"").write.parquet(source)
    write_all(spark, store, source, str(tmp_path / "check"))
    single_record(spark, 1, b"a", b"").write.mode("append").parquet(source)
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        write_all(spark, store, source, str(tmp_path / "new"))
    assert times(store) == [0]
    write_all(spark, store, source, str(tmp_path / "check"))
    assert times(store) == [0, 1]


def test_two_streams_into_one_store(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), Options(late_mode=TOLERANT))
    for k, name in enumerate(("one", "two")):
        single_record(spark, k, b"a", b"").write.parquet(str(tmp_path / name))
        write_all(spark, store, str(tmp_path / name), str(tmp_path / f"check-{name}"), name)
    assert times(store) == [0, 1]
    for bad in ("", "a:b"):
        with pytest.raises(ValueError):
            write_stream(store.scan(), store, "x", lambda: 0, bad)


@pytest.mark.parametrize("committed", [False, True])
def test_a_stream_that_is_lost_around_its_commit(spark, tmp_path, committed):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    store = Store.open(spark, str(tmp_path / "s"), Options(late_mode=TOLERANT))
    for k in range(2):
        single_record(spark, k, b"a", b"").coalesce(1).write.mode("append").parquet(source)
    commit = store.log.commit

    def lost(*args, **more):
        if committed:
            commit(*args, **more)
        raise RuntimeError("killed")

    store.log.commit = lost
    with pytest.raises(StreamingQueryException):
        write_all(spark, store, source, check)
    assert len(times(store)) == int(committed)
    again = Store.open(spark, store.files.root, store.options)
    write_all(spark, again, source, check)
    assert times(again) == [0, 1]


def test_late_records_are_judged_by_the_clock(spark, tmp_path):
    source = str(tmp_path / "in")
    store = Store.open(spark, str(tmp_path / "s"), Options(late_window=HOUR))
    single_record(spark, 0, b"late", b"").union(single_record(spark, 5 * HOUR, b"new", b"")).write.parquet(source)
    stream = spark.readStream.schema(RECORD).parquet(source)
    write_stream(stream, store, str(tmp_path / "check"), lambda: 3 * HOUR, "s").trigger(availableNow=True).start().awaitTermination()
    assert [bytes(r.source_id) for r in store.scan().select(F.col("source_id")).collect()] == [b"new"]
