"""The queries that the driver runs over the test tables, and SQL for each, written independently of them.

Record streams: events (source event_type, payload props), lineitem (source l_returnflag) and orders (source
o_orderpriority). Binary columns come out as text, so that other engines compare equal.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import maintenance
from tidemark.functions import format_rfc3339, parse_rfc3339
from tidemark.operators import (
    admitted, bucket_aggregate, file_stats, merged, rejected, routed, scan_range, source_counts, total_bytes,
)
from tidemark.options import STRICT, TOLERANT, Options
from tidemark.schema import FILE_ENTRY, HOUR, NANOS
from tidemark.sources import event_records, export_lines, lineitem_records, order_records, parse_lines
from tidemark.store import Store
from tidemark.streaming import write_stream

DAY = 24 * HOUR
JAN = 1_704_067_200 * NANOS  # 2024-01-01T00:00:00Z
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def take(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return take


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_records(spark.read.parquet(f"{sf_dir}/events.parquet"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_records(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_records(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def shown(records: DataFrame) -> DataFrame:
    """source_id and payload as text."""
    return records.withColumns({c: F.col(c).cast("string") for c in ("source_id", "payload") if c in records.columns})


def scratch(spark: SparkSession) -> str:
    """A folder for a store: in the folder that the cluster shares; on this machine only where none is set and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tidemark-")


EVENTS = "(select epoch_ns(ts) as ts, event_type as source_id, coalesce(props, '') as payload from events)"
LINES = "(select epoch_ns(l_shipdate) as ts, l_returnflag as source_id, l_orderkey || '/' || l_linenumber as payload from lineitem)"
ORDERS = "(select epoch_ns(o_orderdate) as ts, o_orderpriority as source_id, cast(o_orderkey as varchar) as payload from orders)"

# scans


@query(f"select ts, source_id, payload from {EVENTS} as r where ts >= {JAN + 3 * DAY} and ts < {JAN + 10 * DAY}")
def scan_range_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scan_range(events(spark, sf_dir), JAN + 3 * DAY, JAN + 10 * DAY))


@query(f"select ts, source_id, payload from {EVENTS} as r where source_id = 'purchase' and ts >= {JAN} and ts < {JAN + 20 * DAY}")
def scan_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scan_range(events(spark, sf_dir), JAN, JAN + 20 * DAY, b"purchase"))


@query(f"select ts, source_id, payload from {EVENTS} as r where source_id = 'no such source'")
def scan_unknown_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scan_range(events(spark, sf_dir), JAN, JAN + 60 * DAY, b"no such source"))


@query(f"select ts, source_id, payload from {EVENTS} as r where false")
def scan_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scan_range(events(spark, sf_dir), JAN + DAY, JAN + DAY))


@query(f"select ts, source_id, payload from {LINES} as r where ts >= {25 * 365 * DAY} and ts < {29 * 365 * DAY} and source_id = 'R'")
def scan_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scan_range(lineitem(spark, sf_dir), 25 * 365 * DAY, 29 * 365 * DAY, b"R"))


@query(f"select ts, source_id, payload from {EVENTS} as r where ts >= {JAN + DAY // 2} and ts < {JAN + 9 * DAY + 1}")
def scan_cross_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a store of daily windows."""
    store = Store.open(spark, scratch(spark), Options(partition_duration=DAY, late_mode=TOLERANT))
    store.append(events(spark, sf_dir), now=JAN)
    return shown(store.scan(JAN + DAY // 2, JAN + 9 * DAY + 1))


@query(f"select ts from {EVENTS} as r where ts >= {JAN + DAY}")
def scan_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_range(events(spark, sf_dir), JAN + DAY, (1 << 63) - 1).select("ts")


@query(f"select ts, source_id, payload from {EVENTS} as r union all select ts, source_id, payload from {ORDERS} as r union all select ts, source_id, payload from {EVENTS} as r")
def merge_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = events(spark, sf_dir)
    return shown(merged(one, orders(spark, sf_dir), one))


# aggregates


def _buckets_sql(rows: str, start: int, end: int, width: int, where: str = "true") -> str:
    n = -(-(end - start) // width)
    return f"""
with c as (select (ts - {start}) // {width} as i, count(*) as c from {rows} as r where ts >= {start} and ts < {end} and {where} group by 1)
select {start} + g.i * {width} as bucket_start, {start} + (g.i + 1) * {width} as bucket_end, coalesce(c.c, 0) as "count",
       cast(coalesce(c.c, 0) as double) / ({width} / 1e9) as rate
from range({n}) as g(i) left join c on c.i = g.i"""


@query(_buckets_sql(EVENTS, JAN, JAN + 30 * DAY, HOUR))
def agg_count_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_aggregate(events(spark, sf_dir), JAN, JAN + 30 * DAY, HOUR)


@query(_buckets_sql(EVENTS, JAN, JAN + 30 * DAY, 6 * HOUR, "source_id = 'error'"))
def agg_count_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_aggregate(events(spark, sf_dir), JAN, JAN + 30 * DAY, 6 * HOUR, b"error")


@query(_buckets_sql(LINES, 25 * 365 * DAY, 32 * 365 * DAY, 7 * DAY))
def agg_rate_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_aggregate(lineitem(spark, sf_dir), 25 * 365 * DAY, 32 * 365 * DAY, 7 * DAY)


@query(_buckets_sql(EVENTS, JAN + 1234567891, JAN + 5 * DAY, 37 * 60 * NANOS + 11))
def agg_unaligned_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_aggregate(events(spark, sf_dir), JAN + 1234567891, JAN + 5 * DAY, 37 * 60 * NANOS + 11)


@query(_buckets_sql(EVENTS, JAN, JAN + 10 * DAY, 3 * DAY))
def agg_partial_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_aggregate(events(spark, sf_dir), JAN, JAN + 10 * DAY, 3 * DAY)


@query(_buckets_sql(EVENTS, JAN - 10 * DAY, JAN - 9 * DAY, HOUR))
def agg_empty_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_aggregate(events(spark, sf_dir), JAN - 10 * DAY, JAN - 9 * DAY, HOUR)


@query(_buckets_sql(ORDERS, 25 * 365 * DAY, 32 * 365 * DAY, 30 * DAY, "source_id = '1-URGENT'"))
def agg_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a store of windows of 90 days."""
    store = Store.open(spark, scratch(spark), Options(partition_duration=90 * DAY, late_mode=TOLERANT, compression="zstd"))
    store.append(orders(spark, sf_dir), now=0)
    return store.aggregate(25 * 365 * DAY, 32 * 365 * DAY, 30 * DAY, b"1-URGENT")


@query(f"select source_id, count(*) as records from {EVENTS} as r group by source_id")
def source_counts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_counts(events(spark, sf_dir)).withColumn("source_id", F.col("source_id").cast("string"))


@query(f"select count(*) as records, cast(sum(8 + strlen(source_id) + strlen(payload)) as bigint) as bytes from {EVENTS} as r")
def append_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total_bytes(events(spark, sf_dir))


@query(f"select ts // {DAY} * {DAY} as part_start, min(ts) as min_ts, max(ts) as max_ts, count(*) as record_count from {EVENTS} as r group by 1")
def file_stats_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_stats(routed(events(spark, sf_dir), DAY), "part_start")


# windows and late records


@query(f"select ts, ts - ts % {HOUR} as part_start from {EVENTS} as r")
def route_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(events(spark, sf_dir), HOUR).select("ts", "part_start")


@query(f"select t as ts, t - (((t % {7 * HOUR}) + {7 * HOUR}) % {7 * HOUR}) as part_start from (select ts - {JAN + 15 * DAY} as t from {EVENTS} as r) as x")
def route_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = events(spark, sf_dir).withColumn("ts", F.col("ts") - F.lit(JAN + 15 * DAY))
    return routed(moved, 7 * HOUR).select("ts", "part_start")


def batches_store(spark: SparkSession, sf_dir: str, days: int, window: int = DAY, **options) -> Store:
    """Events in a store of daily windows (or others), by batches of so many days, each of which makes one file in a window."""
    store = Store.open(spark, scratch(spark), Options(partition_duration=window, late_mode=TOLERANT, **options))
    for first in range(0, 30, days):
        part = scan_range(events(spark, sf_dir), JAN + first * DAY, JAN + (first + days) * DAY)
        store.append(part, now=JAN, layout="windows")
    return store


def sources_store(spark: SparkSession, sf_dir: str, **options) -> Store:
    """Events in a store of daily windows, by one batch for each source, so that each source's records of a day are a file."""
    store = Store.open(spark, scratch(spark), Options(partition_duration=DAY, late_mode=TOLERANT, **options))
    for source in ("click", "error", "purchase", "signup", "view"):
        store.append(events(spark, sf_dir).where(F.col("source_id") == F.lit(source.encode())), now=JAN, layout="windows")
    return store


def entries(spark: SparkSession, found: list) -> DataFrame:
    return spark.createDataFrame([tuple(vars(e).values()) for e in found], FILE_ENTRY)


#: The files of sources_store(), those of batches_store() with windows of a day, and with windows of 60 days by batches of 3.
FILES = f"(select ts // {DAY} * {DAY} as partition_start, source_id, min(ts) as min_ts, max(ts) as max_ts, count(*) as record_count from {EVENTS} as r group by 1, 2)"
DAYS = f"(select ts // {DAY} * {DAY} as partition_start, min(ts) as min_ts, max(ts) as max_ts, count(*) as record_count from {EVENTS} as r group by 1)"
BATCHES = f"(select (ts - {JAN}) // {3 * DAY} as batch, ts // {60 * DAY} * {60 * DAY} as partition_start, min(ts) as min_ts, max(ts) as max_ts from {EVENTS} as r where ts < {JAN + 30 * DAY} group by 1, 2)"


@query(f"select partition_start, partition_start + {DAY} as partition_end from {DAYS} as d where partition_start < {JAN + 8 * DAY} and partition_start + {DAY} > {JAN + 5 * DAY}")
def partition_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that a store looks at for a range."""
    windows, _ = batches_store(spark, sf_dir, 30).pick(JAN + 5 * DAY, JAN + 8 * DAY)
    return entries(spark, windows).select("partition_start", "partition_end").distinct()


@query(f"select min_ts, max_ts from {BATCHES} as f where max_ts >= {JAN + 4 * DAY + HOUR} and min_ts < {JAN + 9 * DAY - HOUR}")
def file_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a store reads for a range, of one window with many."""
    _, files = batches_store(spark, sf_dir, 3, 60 * DAY).pick(JAN + 4 * DAY + HOUR, JAN + 9 * DAY - HOUR)
    return entries(spark, files).select("min_ts", "max_ts")


_RANGE = f"max_ts >= {JAN + 4 * DAY} and min_ts < {JAN + 4 * DAY + 2 * HOUR}"


@query(
    f"""with f as (select * from {BATCHES} as f where partition_start < {JAN + 4 * DAY + 2 * HOUR} and partition_start + {60 * DAY} > {JAN + 4 * DAY})
    select cast(count(*) filter (where {_RANGE}) as bigint) as files_read, cast(count(*) filter (where not ({_RANGE})) as bigint) as files_skipped from f"""
)
def file_skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the metrics of a store say after a scan of two hours."""
    store = batches_store(spark, sf_dir, 3, 60 * DAY)
    store.scan(JAN + 4 * DAY, JAN + 4 * DAY + 2 * HOUR)
    told = store.metrics.counters
    return spark.createDataFrame([(told["sstable_reads"], told["sstable_skips"])], "files_read long, files_skipped long")


NOW = JAN + 20 * DAY
LATE = Options(late_window=2 * DAY, late_mode=STRICT)


@query(f"select ts, source_id, payload from {EVENTS} as r where ts >= {NOW - 2 * DAY}")
def late_strict_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(admitted(events(spark, sf_dir), NOW, LATE))


@query(f"select ts, source_id, payload from {EVENTS} as r where ts < {NOW - 2 * DAY}")
def late_strict_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rejected(events(spark, sf_dir), NOW, LATE))


@query(f"select ts, source_id, payload, ts // {HOUR} * {HOUR} as part_start from {EVENTS} as r")
def late_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(routed(admitted(events(spark, sf_dir), NOW, Options(late_window=2 * DAY, late_mode=TOLERANT)), HOUR))


LISTING = f"""select partition_start as start, partition_start + {DAY} as "end", case when {NOW} > partition_start + {DAY} + {2 * DAY} then 'sealed' else 'open' end as state,
       count(*) as files from {FILES} as f group by 1"""


@query(LISTING)
def partitions_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of a store that has a file of each source and day."""
    return sources_store(spark, sf_dir, late_window=2 * DAY).partitions(NOW).drop("size_bytes")


@query(f"select partition_start as start, case when partition_start + {DAY} < {JAN + 12 * DAY} then 'deleted' when {NOW} > partition_start + {3 * DAY} then 'sealed' else 'open' end as state from {DAYS} as d")
def sealed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, sealed and deleted windows of a store after retention."""
    store = batches_store(spark, sf_dir, 30, late_window=2 * DAY, retention=NOW - JAN - 11 * DAY)
    maintenance.expire(store, NOW)
    return store.partitions(NOW).select("start", "state")


# retention, compaction, log

HORIZON = JAN + 12 * DAY + 7 * HOUR


@query(f"select partition_start, max_ts, record_count from {FILES} as f where max_ts < {HORIZON}")
def retention_expired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that retention takes off a store's log."""
    gone = maintenance.expire(sources_store(spark, sf_dir, retention=NOW - HORIZON), NOW)
    return entries(spark, gone).select("partition_start", "max_ts", "record_count")


@query(f"select r.ts, r.source_id, r.payload from {EVENTS} as r join (select ts // {DAY} as d, max(ts) as m from {EVENTS} as q group by 1) as w on r.ts // {DAY} = w.d where w.m >= {HORIZON}")
def retention_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of one file a day; files whose newest record is before the horizon go, others stay whole."""
    store = Store.open(spark, scratch(spark), Options(partition_duration=DAY, late_mode=TOLERANT, retention=NOW - HORIZON))
    store.append(events(spark, sf_dir), now=JAN)
    maintenance.compact(store, maintenance.Fifo(1))
    maintenance.expire(store, NOW)
    return shown(store.scan())


@query(f"select partition_start, count(*) as files, cast(sum(record_count) as bigint) as record_count from {FILES} as f group by 1 having count(*) > 4")
def compaction_pick_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of a store that compaction would merge."""
    picked = maintenance.picks(sources_store(spark, sf_dir), maintenance.Fifo(4))
    rows = [(start, len(files), sum(e.record_count for e in files)) for start, files in picked.items()]
    return spark.createDataFrame(rows, "partition_start long, files long, record_count long")


@query(f"select ts, source_id, payload from {LINES} as r union all select ts, source_id, payload from {ORDERS} as r")
def compaction_preserves_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.open(spark, scratch(spark), Options(partition_duration=365 * DAY, late_mode=TOLERANT, max_files_per_partition=1))
    store.append(lineitem(spark, sf_dir), now=0)
    store.append(orders(spark, sf_dir), now=0)
    maintenance.compact(store)
    return shown(store.scan())


@query(
    f"""with f as (select *, count(*) over (partition by partition_start) as n from {FILES} as f)
    select partition_start, max(max_ts) as max_ts, cast(sum(record_count) as bigint) as record_count from f group by partition_start, case when n > 4 then '' else source_id end having max(max_ts) >= {HORIZON}"""
)
def manifest_live_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log of a store says is live after five appends, a compaction and retention, read anew by another opening."""
    store = sources_store(spark, sf_dir, max_files_per_partition=4, retention=NOW - HORIZON)
    maintenance.compact(store)
    maintenance.expire(store, NOW)
    return Store.open(spark, store.files.root).file_frame().select("partition_start", "max_ts", "record_count")


# lines of JSON


@query(
    f"""select '{{"timestamp":"' || strftime(make_timestamp(ts // 1000), '%Y-%m-%dT%H:%M:%S') || regexp_replace('.' || lpad(cast(ts % 1000000000 as varchar), 9, '0'), '\\.?0+$', '') || 'Z","source":"'
    || to_base64(encode(source_id)) || '","payload":"' || to_base64(encode(payload)) || '"}}' as value from {EVENTS} as r"""
)
def ndjson_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_lines(events(spark, sf_dir))


@query(f"select ts, source_id, payload from {ORDERS} as r")
def ndjson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(parse_lines(export_lines(orders(spark, sf_dir))).where("good").select("ts", "source_id", "payload"))


@query(f"select ts, ts as parsed from {LINES} as r")
def time_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).select("ts", parse_rfc3339(format_rfc3339(F.col("ts"))).alias("parsed"))


# streaming


@query(f"select ts, source_id, payload from {EVENTS} as r")
def stream_append_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the events into a store, and starts once more from the same checkpoint: no record comes twice."""
    store = Store.open(spark, scratch(spark), Options(partition_duration=DAY, late_mode=TOLERANT))
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    checkpoint = scratch(spark)
    for _ in range(2):
        stream = event_records(spark.readStream.schema(raw.schema).parquet(f"{sf_dir}/events.parque[t]"))
        write_stream(stream, store, checkpoint, lambda: JAN, "events").trigger(availableNow=True).start().awaitTermination()
    return shown(store.scan())
