"""A streaming sink: each micro-batch is one commit, and a batch that is run again changes nothing."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tidemark.errors import StreamMismatch
from tidemark.maintenance import compact as merge
from tidemark.plans.files import Files
from tidemark.store import Store


def write_stream(records: DataFrame, store: Store, checkpoint: str, clock: Callable[[], int], name: str, compact: bool = False) -> DataStreamWriter:
    """A writer of a stream of records; call start() on it.

    clock gives the time against which each batch's records are late. A batch is known by `name`, the id that
    Spark keeps in the checkpoint, and its number, so a restart from the checkpoint commits no batch
    twice; of each stream the log keeps the last number. Batches of another checkpoint never pass for known ones: a
    name belongs to the checkpoint that used it first, and any other raises StreamMismatch, as its rows may be there
    or not. Lateness is by the clock, not by event times, so there is no watermark. With compact, windows with too many
    files are merged after each batch.
    """
    if not name or ":" in name:
        raise ValueError("a stream needs a name without colons")

    def take(batch: DataFrame, number: int) -> None:
        query = json.loads(Files(batch.sparkSession, checkpoint).read("metadata"))["id"]
        own = f"{name}:{query}"
        if other := next((k for k in store.log.snapshot().streams if k.startswith(f"{name}:") and k != own), None):
            raise StreamMismatch(f"stream {other}, of another checkpoint, has the name {name!r}")
        store.append(batch, clock(), stream=(own, number))
        if compact:
            merge(store)

    return records.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(take)
