"""Substring dedup by sliding spans of consecutive sentences.

Every run of several consecutive sentences is hashed. Of the spans with one hash, over all documents, the first
(by doc_id, then place) stays; sentences covered by any other one are removed.

A sentence ends with a word that ends in . ! or ?, at a line's end or the text's. Sentences of more than LONG
words are cut further after words that a hash picks, so that text without stops has spans that line up, too. A
span starts at each sentence and takes as many as give at least SENTENCES and WORDS. Words are compared
without regard to white space and the case of A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Rolling, begin_task, mixed, sieve, sifted, slices, stored, text_bytes, texts_of

SENTENCES, WORDS = 3, 20
LONG, EVERY = 16, 3
SLICE = 2 << 20
_LAST = np.iinfo(np.int64).max

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])
_STOP = np.array([b in b".!?" for b in range(256)])
#: Odd multipliers of the rolling hashes, of bytes and of words, and a number for each byte.
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE[0]))


def spans(data: np.ndarray, offsets: np.ndarray, sentences: int, words: int) -> dict[str, np.ndarray]:
    """Spans of texts (UTF-8, end to end): hash, check, text (which), start and stop (code points; stop after the white space)."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.append(True, space[:-1]) if len(data) else space
    first = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.append(space[1:], True) if len(data) else space
    last = np.flatnonzero(~space & (after | edge[1:])) + 1
    none = np.zeros(0, np.int64)
    if not len(first):
        return {"hash": none, "check": none, "text": none, "start": none, "stop": none}
    word = Rolling(_CODE[_LOWER[data]], _BASE[0]).of(first, last) + (last - first).astype(np.uint64)
    text = np.searchsorted(offsets, first, "right") - 1
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    follow = np.append(first[1:], len(data))
    ends = _STOP[data[last - 1]] | (lines[follow] > lines[last]) | np.append(text[1:] != text[:-1], True)
    # sentences of many words are cut by a hash of their words
    at = np.flatnonzero(ends)
    sizes = np.diff(at, prepend=-1)
    ends |= np.repeat(sizes > LONG, sizes) & (mixed(word) % np.uint64(EVERY) == 0)
    unit_last = np.flatnonzero(ends) + 1  # in words
    unit_first = np.append(0, unit_last[:-1])
    unit_text = text[unit_first]
    reach = np.maximum(np.arange(len(unit_first)) + sentences - 1, np.searchsorted(unit_last, unit_first + words))
    fits = reach < len(unit_first)
    fits[fits] = unit_text[reach[fits]] == unit_text[fits]
    a, b, text = unit_first[fits], unit_last[reach[fits]], unit_text[fits]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    follow = np.append(first, len(data))[b]
    stop = np.minimum(follow, offsets[text + 1])
    return {
        "hash": Rolling(word, _BASE[1]).of(a, b).view(np.int64), "check": (Rolling(word, _BASE[2]).of(a, b) >> np.uint64(33)).astype(np.int64),
        "text": text, "start": points[first[a]] - points[offsets[text]], "stop": points[stop] - points[offsets[text]],
    }


#: mark: 31 bits of check, and in the lowest whether the span is not the first with its hash in its slice; at: start and stop, 32 bits each.
_FIELDS = "hash long, mark int, place long, row long, at long"
_OUT = "row long, start int, stop int"


def _spans_of(rows: DataFrame, sentences: int, words: int) -> DataFrame:
    """Spans of rows (doc_id, text, row). What is not the first in its slice is not the first of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in slices(batches, "text", SLICE):
            found = spans(*text_bytes(batch.column(1)), sentences, words)
            text = found["text"]
            place = batch.column(0).fill_null(_LAST).to_numpy()[text]
            row = batch.column(2).to_numpy()[text]
            at = found["start"] << 32 | found["stop"]
            later = np.zeros(len(text), np.int64)
            by = np.argsort(found["hash"], kind="stable")
            same = found["hash"][by][1:] == found["hash"][by][:-1]
            if same.any():  # of those that share a hash, in order of place
                twice = by[np.append(same, False) | np.append(False, same)]
                order = twice[np.lexsort((at[twice], row[twice], place[twice], found["check"][twice], found["hash"][twice]))]
                later[order] = _not_first(found["hash"][order], found["check"][order], place[order], row[order], at[order])
            mark = (found["check"] << 1 | later).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (found["hash"], mark, place, row, at))), names=["hash", "mark", "place", "row", "at"])

    return rows.mapInArrow(run, _FIELDS)


def _not_first(h: np.ndarray, check: np.ndarray, place: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of rows in order: those with the hash of an earlier row, unless at the same place as the first (repeated rows)."""
    new = np.append(True, (h[1:] != h[:-1]) | (check[1:] != check[:-1]))
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return (place != place[lead]) | (row != row[lead]) | (at != at[lead])


def _repeated(found: DataFrame) -> DataFrame:
    """row, start, stop of all spans but the first of each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            passed = (columns[1] & 1) == 1
            out = [[columns[3][passed], columns[4][passed]]]
            columns = [c[~passed] for c in columns]
            if len(columns[0]):
                n = 0 if lead is None else 1
                columns = [np.concatenate(p) for p in zip(lead, columns, strict=True)] if n else columns
                again = _not_first(*columns)
                again[:n] = False
                out.append([columns[3][again], columns[4][again]])
                # the first row of the last hash is what later batches compare with
                h, mark = columns[0], columns[1]
                other = np.flatnonzero((h != h[-1]) | (mark != mark[-1]))
                k = int(other[-1]) + 1 if len(other) else 0
                lead = [c[k : k + 1] for c in columns]
            row, at = (np.concatenate(p) for p in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array((at >> 32).astype(np.int32)), pa.array((at & 0xFFFFFFFF).astype(np.int32))], names=["row", "start", "stop"])

    # spans that aren't the first of their slice are dealt by their place, so that a frequent span sends one row of each slice to the task of its hash
    deal = F.when(F.col("mark").bitwiseAND(1) == 1, F.xxhash64("row", "at")).otherwise(F.col("hash"))
    return found.repartition(deal).sortWithinPartitions("hash", "mark", "place", "row", "at").mapInArrow(run, _OUT)


def _merged(repeated: DataFrame) -> DataFrame:
    """row, removed: the union of its spans, as an array of (start, stop) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            out = []
            for one in batch.column(1).to_pylist():
                joined: list[dict[str, int]] = []
                for span in sorted(one, key=lambda s: s["start"]):
                    if joined and span["start"] <= joined[-1]["stop"]:
                        joined[-1]["stop"] = max(joined[-1]["stop"], span["stop"])
                    else:
                        joined.append(span)
                out.append(joined)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["row", "removed"])

    # a text's own spans, no more than it has sentences
    own = repeated.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return own.mapInArrow(run, "row long, removed array<struct<start: int, stop: int>>")


def _cut(text: Column, removed: Column) -> Column:
    """text without the removed spans."""
    at = F.sequence(F.lit(0), F.size(removed))
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(removed, k - 1)["stop"])
    stop = lambda k: F.coalesce(F.get(removed, k)["start"], F.char_length(text))
    return F.array_join(F.transform(at, lambda k: F.substring(text, start(k) + 1, stop(k) - start(k))), "")


def dedup(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, column: str = "removed") -> DataFrame:
    """All rows and columns of docs, text without repeated spans, and removed: array of (start, stop), code points of the input.

    n_chars, if docs has it, follows a text that is cut. Null and empty texts and those with fewer sentences
    or words than a span have nothing removed. Rows with the same doc_id and text are one document, so they
    stay alike. A null doc_id comes after all others. A text of which all is repeated becomes empty. A column
    of docs named like that of the spans (`column`) is replaced; others may have any name. An empty table gives no rows.
    """
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.coalesce(F.col("text"), F.lit("")))
    found = _spans_of(texts_of(docs, row.alias("row")), sentences, words)
    spans_of = stored(_merged(_repeated(found)).withColumnsRenamed({"row": "_row", "removed": "_removed"}), "removed")
    # texts of which nothing goes aren't shuffled
    docs = docs.drop(column)
    some, rest = sifted(docs, row, sieve(spans_of, "_row"))
    met = some.select(F.struct("*").alias("_all"), row.alias("_own")).join(spans_of, F.col("_own") == F.col("_row"), "left")
    hit, text = F.col("_removed").isNotNull(), F.col("_all.text")
    now = {"text": F.when(hit, _cut(text, F.col("_removed"))).otherwise(text)}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(hit, F.char_length(now["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_all.n_chars"))
    none = F.array().cast(spans_of.schema["_removed"].dataType)
    cut = met.select(*[now.get(c, F.col(f"_all.`{c}`")).alias(c) for c in docs.columns], F.coalesce("_removed", none).alias(column))
    return cut.unionByName(rest.withColumn(column, none))
