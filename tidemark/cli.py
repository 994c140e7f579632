"""python -m tidemark.cli STORE append|scan|inspect ...: records in and out of a store from a shell."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from tidemark.errors import TidemarkError
from tidemark.functions import format_bytes, rfc3339, to_rfc3339
from tidemark.options import TOLERANT, Options
from tidemark.sources import export_lines, import_lines, single_record
from tidemark.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    top.add_argument("store")
    top.add_argument("--tolerant", action="store_true", help="let late records in")
    commands = top.add_subparsers(dest="command", required=True)
    append = commands.add_parser("append", help="one record, or the lines of a file")
    append.add_argument("--file", help="lines of JSON; any that isn't well formed fails all")
    append.add_argument("--source", default="")
    append.add_argument("--payload", default="")
    append.add_argument("--timestamp", help="RFC 3339; else now")
    scan = commands.add_parser("scan", help="records as lines of JSON")
    scan.add_argument("--start", required=True)
    scan.add_argument("--end", help="else now")
    scan.add_argument("--source", default="", help="else all")
    inspect = commands.add_parser("inspect")
    inspect.add_argument("what", choices=("partitions", "file", "log"))
    inspect.add_argument("path", nargs="?")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    args, out = parser().parse_args(argv), out or sys.stdout
    now = time.time_ns()
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        store = Store.open(spark, args.store)
        if args.tolerant:
            store.options = Options(partition_duration=store.options.partition_duration, late_mode=TOLERANT)
        if args.command == "append":
            ts = rfc3339(args.timestamp) if args.timestamp else now
            records = import_lines(spark, args.file) if args.file else single_record(spark, ts, args.source.encode(), args.payload.encode())
            print(f"appended {store.append(records, now, on_late='raise')}", file=out)
        elif args.command == "scan":
            found = store.scan(rfc3339(args.start), rfc3339(args.end) if args.end else now, args.source.encode() or None)
            for row in export_lines(found).toLocalIterator():
                print(row.value, file=out)
        elif args.what == "partitions":
            for r in store.partitions(now).collect():
                print(f"{to_rfc3339(r.start)}  {to_rfc3339(r.end)}  {r.state:8}{r.files:6}  {format_bytes(r.size_bytes)}", file=out)
        elif args.what == "file":
            for r in store.inspect_file(args.path or "").collect():
                print("\n".join(f"{k}: {v}" for k, v in r.asDict().items()), file=out)
        else:
            for e in store.log.edits():
                print(f"{e.seq} {e.kind} +{len(e.added)} -{len(e.deleted)}" + (f" batch {e.batch_id}" if e.batch_id else ""), file=out)
            print(f"{len(store.log.snapshot().live)} live files", file=out)
    except (TidemarkError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
