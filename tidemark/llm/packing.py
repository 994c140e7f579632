"""Harmonic packing of documents into token sequences.

Lengths are parted into reciprocal-capacity classes: class k holds pieces of more than C/(k+1) and at most C/k
tokens, and a bin of class k takes exactly k of them. As documents may be cut, a document's tokens are cut at
the upper ends of classes (C, C/2, C/3, ...), so that bins of the large classes come out full; only the short
last piece of a document goes to its class as it is. Each worker fills its bins by itself and nothing is
shuffled. What is left in a worker's open bins when its rows end (less than one sequence for each class) is
laid end to end and cut into full sequences; the last remainder is cut at powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.shared import slices, texts_of
from tidemark.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

#: Classes up to EXACT take pieces cut at their upper end. Shorter pieces are gathered in fewer, wider classes.
EXACT = 16
#: Bytes of text that are tokenised at once.
SLICE = 1 << 20


def wide_classes(capacity: int) -> list[int]:
    """Document counts of the classes beyond EXACT: from each to the next by about a quarter."""
    found = [EXACT]
    while found[-1] < capacity:
        found.append(min(capacity, found[-1] + max(1, found[-1] // 4)))
    return found


class Packer:
    """The open bins of one worker. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        self.capacity, self.sequence = capacity, first_sequence
        self.wide = np.array(wide_classes(capacity))
        self.bins: dict[int, list] = {}
        self.rows: list[tuple] = []

    def cut(self, n: int) -> Iterator[tuple[int, int]]:
        """(class, length) of the pieces of a document of n tokens."""
        while n > self.capacity // EXACT:
            k = -(-self.capacity // n)
            size = self.capacity // k
            yield k, size
            n -= size
        if n:
            yield int(self.wide[np.searchsorted(self.wide, self.capacity // n, "right") - 1]), n

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        start = 0
        for k, size in self.cut(len(ids)):
            bin_ = self.bins.setdefault(k, [])
            # a copy, so that an open bin doesn't keep the ids of a whole slice in memory
            bin_.append((doc, start, len(ids), ids[start : start + size].copy()))
            start += size
            if len(bin_) == k:
                self.close(self.bins.pop(k))

    def finish(self) -> None:
        pieces = [p for k in sorted(self.bins) for p in self.bins.pop(k)]
        left = sum(len(p[3]) for p in pieces)
        pieces.reverse()
        while left:
            room = size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            taken = []
            while room:
                doc, start, total, ids = pieces.pop()
                if len(ids) > room:
                    pieces.append((doc, start + room, total, ids[room:]))
                    ids = ids[:room]
                taken.append((doc, start, total, ids))
                room -= len(ids)
            self.close(taken)
            left -= size

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 2) -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` tokens (a power of two).

    A row for each piece: doc_id, start (ids of its document before it), length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset (in the sequence, gapless from 0). Every document ends with id
    `end`, so an empty or null text has one id. A null doc_id stays null; repeated rows and ids are packed
    each for itself; an empty table gives no rows; other columns are not looked at. A text of any length is
    taken whole. sequence_id is unique over all workers and the same when a lost task is run again.
    """
    if capacity < EXACT or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two and at least 16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)
        encode = encoder(tokenizer).encode
        for batch in slices(batches, "text", SLICE):
            ids, lengths = encode(batch.column(1).to_pylist(), end)
            ends = np.cumsum(lengths)
            for doc, last, n in zip(batch.column(0).to_pylist(), ends.tolist(), lengths.tolist(), strict=True):
                packer.add(doc, ids[last - n : last])
            yield packer.taken()
        packer.finish()
        yield packer.taken()

    return texts_of(docs).mapInArrow(run, SCHEMA)
