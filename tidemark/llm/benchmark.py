"""Benchmark decontamination by an FM-index for each training shard.

A shard is a run of documents of one task, of bounded size. Its words become symbols of the benchmark's
vocabulary; each run of other words, as well as each document's end, becomes one separator, which no phrase
holds. The index over them answers all phrases at once by backward search; occurrences are located by sampled
suffix positions and merged to spans of words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.fm_index import FMIndex
from tidemark.llm.shared import begin_task, ragged, slices, small_batches, stored

#: Words: digits, letters a-z (A-Z lower-cased) and whatever isn't ASCII; all other bytes part them.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
WINDOW = 13
#: Bytes of text in a shard, and of benchmark texts searched for at once (and so broadcast).
SHARD, BLOCK = 8 << 20, 16 << 20
SEPARATOR = 1

SCHEMA = "row long, n_words long, spans array<struct<first: long, last: long>>, item_ids array<string>, _cut string"
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_ARROW = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("spans", _SPAN), ("item_ids", pa.list_(pa.string())), ("_cut", pa.string())])


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split()


def phrases(items: list[tuple[str, str]], window: int) -> tuple[dict[bytes, int], dict[int, np.ndarray], dict[int, list[list[str]]]]:
    """The vocabulary (symbols from SEPARATOR + 1), and by length the different windows (rows of symbols) and the items of each."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for item, text in items:
        ids = tuple(vocabulary.setdefault(w, len(vocabulary) + SEPARATOR + 1) for w in words(text))
        for k in range(max(1, len(ids) - window + 1) if ids else 0):
            owners[ids[k : k + window]].add(item)
    by_size: dict[int, list] = defaultdict(list)
    for ids in owners:
        by_size[len(ids)].append(ids)
    return vocabulary, {n: np.array(rows, np.int64) for n, rows in by_size.items()}, {n: [sorted(owners[r]) for r in rows] for n, rows in by_size.items()}


def _merged(first: np.ndarray, last: np.ndarray) -> list[dict[str, int]]:
    """Spans [first, last), sorted by first, joined where they touch."""
    reach = np.maximum.accumulate(last)
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return [{"first": a, "last": b} for a, b in zip(first[at].tolist(), reach[np.append(at[1:], len(first)) - 1].tolist(), strict=True)]


def search_shard(texts: list[str], vocabulary: dict[bytes, int], windows: dict[int, np.ndarray], owners: dict[int, list[list[str]]]) -> tuple[list[int], dict[int, tuple[list, list[str]]]]:
    """The words of each text; by text, the merged spans of words in occurrences and the items that occur."""
    flat: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        part = words(text)
        counts[k] = len(part)
        flat += part
    if not windows or not flat:
        return counts.tolist(), {}
    symbols = np.fromiter(map(vocabulary.get, flat, repeat(SEPARATOR)), np.int32, len(flat))
    del flat
    ends = np.cumsum(counts)
    # a separator before each document, then every run of separators becomes one
    starts = ends - counts
    symbols = np.insert(symbols, starts, SEPARATOR)
    places = np.insert(np.arange(len(symbols) - len(texts)), starts, -1)
    kept = np.ones(len(symbols), bool)
    kept[1:] = (symbols[1:] != SEPARATOR) | (symbols[:-1] != SEPARATOR)
    symbols, places = symbols[kept], places[kept]
    index = FMIndex(symbols, len(vocabulary) + SEPARATOR)
    first, last, items = [], [], []
    for size, rows in windows.items():
        which, low, high = index.search(rows)
        if len(which):
            at = places[index.locate(ragged(low, high - low))]
            first.append(at)
            last.append(at + size)
            items.append((np.repeat(which, high - low), at, size))
    if not first:
        return counts.tolist(), {}
    begin, end = np.concatenate(first), np.concatenate(last)
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], end[by]
    doc = np.searchsorted(ends, begin, "right")
    cuts = np.flatnonzero(np.diff(doc)) + 1
    found = {int(d[0]): (_merged(a - starts[d[0]], b - starts[d[0]]), set()) for d, a, b in zip(np.split(doc, cuts), np.split(begin, cuts), np.split(end, cuts), strict=True)}
    for which, at, size in items:
        pairs = np.unique(np.stack([np.searchsorted(ends, at, "right"), which]), axis=1)
        for d, w in pairs.T.tolist():
            found[d][1].update(owners[size][w])
    return counts.tolist(), {d: (spans, sorted(names)) for d, (spans, names) in found.items()}


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, columns: list[str] | None = None) -> DataFrame:
    """All rows of docs (all columns, or `columns`), with n_words, spans (merged, of words, [first, last)), item_ids (sorted strings), n_hit.

    An item is looked for by every `window` consecutive words of it, or whole if it has fewer. Null texts have
    no words. Items without id or words are ignored; rows of one item_id are one item. Repeated rows of docs
    are answered each. Without benchmark items nothing is hit. Columns of docs named like the results are
    replaced. Benchmarks over BLOCK bytes are searched for in blocks, in as many passes.
    """
    return _found(docs, benchmark, window, columns or docs.columns, False).drop("_cut")


def _found(docs: DataFrame, benchmark: DataFrame, window: int, columns: list[str], cut: bool) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK))
    small_batches(spark)
    names = [c for c in columns if c not in ("n_words", "spans", "item_ids", "n_hit", "_cut")]
    numbered = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.struct(*names).alias("_all"), F.monotonically_increasing_id().alias("row"))
    if blocks > 1:
        numbered = stored(numbered, "numbered")  # so that every pass sees the same number with a row
    passes = []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()  # about BLOCK bytes
        shared = spark.sparkContext.broadcast(phrases([tuple(r) for r in block], window))
        passes.append(_search(numbered, shared, cut and blocks == 1))
    found = passes[0]
    if blocks > 1:
        for more in passes[1:]:
            found = found.unionByName(more)
        spans = F.array_sort(F.flatten(F.collect_list("spans")))
        found = found.groupBy("row").agg(F.first("_all").alias("_all"), F.first("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
        found = found.withColumn("spans", F.aggregate("spans", F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)"), _joined))
        if cut:
            cutter = F.pandas_udf(lambda texts, spans: pd.Series([cut_words(t, s) if len(s) else None for t, s in zip(texts.fillna(""), spans, strict=True)], dtype=object), "string")
            found = found.withColumn("_cut", cutter(F.col("_all.text"), F.col("spans")))
        else:
            found = found.withColumn("_cut", F.lit(None).cast("string"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("_all.*", "n_words", "spans", "item_ids", hit.alias("n_hit"), "_cut")


def _joined(done, span):
    """Spans in order so far and the next one: lengthen the last or begin another."""
    end = F.element_at(done, -1)
    longer = F.struct(end["first"].alias("first"), F.greatest(end["last"], span["last"]).alias("last"))
    return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= span["first"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(span)))


def _search(numbered: DataFrame, shared: Broadcast, cut: bool) -> DataFrame:
    kind = numbered.schema["_all"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        vocabulary, windows, owners = shared.value
        for batch in slices(batches, "_text", SHARD):
            texts = batch.column(0).to_pylist()
            counts, found = search_shard(texts, vocabulary, windows, owners)
            none: tuple[list, list] = ([], [])
            hits = [found.get(k, none) for k in range(len(counts))]
            cuts = [cut_words(t, h[0]) if cut and h[0] else None for t, h in zip(texts, hits, strict=True)]
            columns = [batch.column(2), pa.array(counts, pa.int64()), pa.array([h[0] for h in hits], _SPAN), pa.array([h[1] for h in hits], pa.list_(pa.string())), pa.array(cuts, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=[*_ARROW.names, "_all"])

    return numbered.mapInArrow(run, StructType.fromDDL(SCHEMA).add("_all", kind))


def cut_words(text: str, spans: list[dict[str, int]]) -> str:
    """text without the spans of words, and without what parts the words of a span."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_TO_WORDS))]
    kept, done = [], 0
    for span in spans:
        kept.append(raw[done : at[span["first"]][0]])
        done = at[span["last"] - 1][1]
    return b"".join([*kept, raw[done:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """docs without those of which a `share`-th or more of the words is hit; from the others the hit words are cut.

    The columns are those of docs; n_chars, if it is one, follows a text that is cut. Documents without a hit
    stay as they are.
    """
    found = _found(docs.select(F.struct("*").alias("_row"), "text"), benchmark, window, ["_row", "text"], True)
    found = found.where((F.col("n_hit") == 0) | (F.col("n_hit") * share < F.col("n_words")))
    now = {"text": F.coalesce("_cut", "_row.text")}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(F.col("_cut").isNull(), F.col("_row.n_chars")).otherwise(F.length("_cut")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[now.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
