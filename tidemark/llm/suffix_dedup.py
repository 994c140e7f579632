"""Removal of long repeated byte strings, by suffix order and earlier matches.

A string of `length` bytes is repeated if it starts anywhere else, in any document. To find all of them without
one suffix array over the corpus, each start belongs to an anchor, the least hash of GRAM bytes in its string
(equal strings have equal anchors at equal offsets). Consecutive starts with one anchor are a run; its context
are the bytes of its strings. Runs meet by anchor. Equal contexts need no more than a count. Of the different
contexts of one anchor the texts are brought together in shards of bounded size, and each shard's suffixes are
put in order by prefix doubling to the depth of `length`. The previous and the next smaller position of each
suffix in that order give its longest previous factor; where that reaches `length`, the string is a later copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Rolling, begin_task, mixed, ragged, sieve, sifted, slices, stored, text_bytes, texts_of

GRAM = 40
SLICE = 2 << 20
#: Bytes of a shard; ranks and positions in it fit 21 bits.
SHARD = 1_900_000
#: Different contexts of one anchor beyond which they are dealt to several shards.
HOT = 4_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LAST = np.iinfo(np.int64).max


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of starts with one anchor: text (which), first, last (starts, in the text), key (of the anchor's bytes), context (hash)."""
    sizes = np.diff(offsets)
    fits = np.flatnonzero(sizes >= length)
    none = np.zeros(0, np.int64)
    if not len(fits):
        return dict.fromkeys(("text", "first", "last", "key", "context"), none)
    n, gram = len(data), min(GRAM, length)
    width = length - gram + 1
    grams = Rolling(_CODE[data], _BASES[0]).of(slice(0, n - gram + 1), slice(gram, n + 1))
    bits = np.uint64(max(24, int(n).bit_length()))
    # the least of each `width` neighbours, leftmost of equal ones: minima from the left and right ends of blocks
    blocks = -(-len(grams) // width) + 1
    right = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    packed = right[: len(grams)]
    packed[:] = grams
    packed >>= bits
    packed <<= bits
    packed |= np.arange(len(grams), dtype=np.uint32)
    table = right.reshape(blocks, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    np.minimum.accumulate(table[:, ::-1], axis=1, out=table[:, ::-1])
    starts = ragged(offsets[fits], sizes[fits] - length + 1)
    anchor = right[starts]
    np.minimum(anchor, left[starts + (width - 1)], out=anchor)
    anchor &= (np.uint64(1) << bits) - np.uint64(1)
    anchor = anchor.view(np.int64)
    del right, packed, table, left
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
    text = np.searchsorted(offsets, first, "right") - 1
    context = Rolling(_CODE[data], _BASES[1]).of(first, last + length)
    return {"text": text, "first": first - offsets[text], "last": last - offsets[text], "key": mixed(grams[anchor[new]] + np.uint64(1)).view(np.int64), "context": context.view(np.int64)}


_RUN = "key long, context long, place long, row long, first int, last int, several boolean"


def _runs_of(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Runs of rows (doc_id, text, row). Of equal contexts in a slice one goes on (the first), with several set; the others are settled there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in slices(batches, "text", SLICE):
            found = runs(*text_bytes(batch.column(1)), length)
            text = found.pop("text")
            place = batch.column(0).fill_null(_LAST).to_numpy()[text]
            row = batch.column(2).to_numpy()[text]
            several, settled = np.zeros(len(text), bool), np.zeros(len(text), bool)
            by = np.argsort(found["context"], kind="stable")
            same = found["context"][by][1:] == found["context"][by][:-1]
            if same.any():
                twice = by[np.append(same, False) | np.append(False, same)]
                order = twice[np.lexsort((found["first"][twice], row[twice], place[twice], found["context"][twice], found["key"][twice]))]
                k, c = found["key"][order], found["context"][order]
                new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
                settled[order] = ~new
                several[order] = np.append(~new[1:], False) & new
            columns = [found["key"], found["context"], place, row, found["first"].astype(np.int32), found["last"].astype(np.int32), several, settled]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "context", "place", "row", "first", "last", "several", "settled"])

    return rows.mapInArrow(run, _RUN + ", settled boolean")


class _Meeting:
    """Runs in order of key, context, place: tells which are repeated as a whole, and which contexts must be compared.

    Between batches it holds just the first run of the last context.
    """

    def __init__(self, keep_first: bool) -> None:
        self.keep_first = keep_first
        self.held: pd.DataFrame | None = None
        self.known = False  # the held run's key has an earlier context

    def rows(self, df: pd.DataFrame, end: bool = False) -> pd.DataFrame:
        held = self.held is not None
        df = pd.concat([self.held, df], ignore_index=True) if held else df.reset_index(drop=True)
        if not len(df):
            return df.assign(settled=False, compare=False)
        key, context = df["key"].to_numpy(), df["context"].to_numpy()
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, context[1:] != context[:-1])
        start = np.flatnonzero(new)
        sizes = np.diff(np.append(start, len(df)))
        several = np.logical_or.reduceat(df["several"].to_numpy(bool), start) | (sizes > 1)
        # contexts of each key among these rows
        key_of = np.cumsum(new_key[start]) - 1
        contexts = np.bincount(key_of)[key_of]
        if held and self.known:
            contexts[key_of == 0] += 1
        first_rows = np.zeros(len(df), bool)
        first_rows[start] = True
        # later runs of a context are repeated as a whole; so is the first, unless firsts stay
        settled = ~first_rows
        if not self.keep_first:
            settled[start] = several
        compare = np.zeros(len(df), bool)
        compare[start] = contexts > 1
        df["several"] = np.repeat(several, sizes)
        df["settled"], df["compare"] = settled, compare
        out = settled | compare
        if not end:
            k = int(start[-1])
            self.known = bool(contexts[-1] > 1)
            self.held = df.iloc[k : k + 1].drop(columns=["settled", "compare"])
            out[k] = False
        return df[out]


def _met(found: DataFrame, keep_first: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin_task()
        meeting = _Meeting(keep_first)
        for df in batches:
            done = df[df["settled"]].assign(compare=False)
            if len(done):
                yield done
            open_ = df[~df["settled"]].drop(columns="settled")
            if len(open_):
                yield meeting.rows(open_)
        if meeting.held is not None:
            yield meeting.rows(meeting.held.iloc[:0], end=True)

    # what is settled is dealt by its place, so that a frequent context sends one row of each slice to the task of its key
    dealt = found.withColumn("deal", F.when(F.col("settled"), F.xxhash64("row", "first")).otherwise(F.col("key")))
    ordered = dealt.repartition("deal").drop("deal").sortWithinPartitions("key", "context", "place", "row", "first")
    return ordered.mapInPandas(run, _RUN + ", settled boolean, compare boolean")


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """`starts` in the order of their suffixes to `depth` bytes, equal ones in order of position; and the ranks of all suffixes by 1, 2, 4, ... bytes.

    data goes on for at least `depth` bytes after each start; it has fewer than 2^21 bytes.
    """
    n = len(data)
    bits = np.uint64(21)
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(n, dtype=np.uint32)
    rank, reach = data.astype(np.uint32), 1
    ranks = []
    while True:
        ranks.append(rank)
        # by 2 * reach bytes, or, the last time, by `depth`, whose end the second half overlaps
        last = 2 * reach >= depth
        step = depth - reach if last else reach
        # in place: a worker holds one such array for each of these lines else
        key = rank.astype(np.uint64)
        key <<= bits
        key[: n - step] |= rank[step:]
        key <<= bits
        key |= place
        if last:
            key = key[starts]
        key.sort()
        at = (key & low).view(np.int64)
        if last:
            return at, ranks
        key >>= bits
        rank = np.empty(n, np.uint32)
        rank[at] = np.cumsum(np.append(False, key[1:] != key[:-1]), dtype=np.uint32)
        reach *= 2


def common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common at their front, `depth` at most, by ranks of halving lengths."""
    found = np.zeros(len(a), np.int32)
    for k in [*range(len(ranks) - 1, -1, -1), 0]:  # once more by a byte, as `depth` may be a power of two
        found += (ranks[k][a + found] == ranks[k][b + found]).astype(np.int32) << k
    return np.minimum(found, depth)


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Of each value the place of the nearest earlier smaller one, or -1: up a tree of minima to the first subtree on the left that has one, and down in it."""
    levels = [values]
    while len(levels[-1]) > 1:
        x = levels[-1]
        x = np.append(x, np.array(np.iinfo(x.dtype).max, x.dtype)) if len(x) & 1 else x
        levels.append(np.minimum(x[::2], x[1::2]))
    found = np.full(len(values), -1, np.int32)
    left, node = np.arange(len(values), dtype=np.int32), np.arange(len(values), dtype=np.int32)
    turns = []
    for minima in levels[:-1]:
        beside = node - 1
        hit = (node & 1 == 1) & (minima[beside] < values[left])
        turns.append((left[hit], beside[hit]))
        left, node = left[~hit], node[~hit] >> 1
    who, node = np.zeros(0, np.int32), np.zeros(0, np.int32)
    for k in range(len(turns) - 1, -1, -1):
        if len(who):
            right = np.minimum(2 * node + 1, len(levels[k]) - 1)
            node = np.where(levels[k][right] < values[who], right, 2 * node)
        who, node = np.concatenate([who, turns[k][0]]), np.concatenate([node, turns[k][1]])
    found[who] = node
    return found


def longest_previous(order: np.ndarray, ranks: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix of an order the longest previous factor, `depth` at most, and the place in the order of an earlier suffix that has it (-1 where none has a byte).

    Of all earlier positions those next to a suffix in suffix order, the previous and the next smaller position, have most in common with it.
    """
    order = order.astype(np.int32)
    length, source = np.zeros(len(order), np.int32), np.full(len(order), -1, np.int32)
    for behind in (False, True):
        other = previous_smaller(order[::-1])[::-1] if behind else previous_smaller(order)
        some = np.flatnonzero(other >= 0)
        if behind:
            other = len(order) - 1 - other
        shared = common(ranks, order[some], order[other[some]], depth)
        longer = shared > length[some]
        length[some[longer]], source[some[longer]] = shared[longer], other[some[longer]]
    return length, source


def _shard(group: dict[str, np.ndarray], data: np.ndarray, sizes: np.ndarray, length: int, keep_first: bool, hashed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple | None]:
    """Repeated stretches in a shard's contexts: context (which), first and last start; if hashed, also a hash pair of each different string and its first place."""
    data = np.concatenate([data, np.zeros(length, np.uint8)])
    begins = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    starts = ragged(begins, windows)
    at, ranks = suffix_order(data, starts, length)
    factor, source = longest_previous(at, ranks, length)
    del ranks
    again = factor >= length
    of = np.searchsorted(begins, at, "right") - 1
    repeated = again.copy()
    if not keep_first:
        # the earlier ones, too; of a string's second place the first is the previous or next smaller position
        repeated[source[again]] = True
        repeated |= group["several"][of]
    flags = np.zeros(len(data), bool)
    flags[at[repeated]] = True
    flat = flags[starts]
    context = np.repeat(np.arange(len(sizes)), windows)
    edge = flat & np.append(True, ~flat[:-1] | (context[1:] != context[:-1])) if len(flat) else flat
    stop = flat & np.append(~flat[1:] | (context[1:] != context[:-1]), True) if len(flat) else flat
    which = context[edge]
    out = (which, starts[edge] - begins[which], starts[stop] - begins[which])
    if not hashed:
        return *out, None
    new = np.flatnonzero(~again)
    a, b = (Rolling(_CODE[data], base).of(at[new], at[new] + length).view(np.int64) for base in _BASES)
    return *out, (a, b, of[new], at[new] - begins[of[new]])


_TEXTS = "key long, salt int, place long, row long, first int, several boolean, bytes binary"
_PLACE = ("key", "salt", "place", "row", "first")
_FOUND = "row long, start int, stop int, a long, b long, place long"


def _contexts(rows: DataFrame, compare: DataFrame, length: int) -> DataFrame:
    """The bytes of the contexts that must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in slices(batches, "text", SLICE):
            data, offsets = text_bytes(batch.column(0))
            lists = batch.column(1)
            counts = lists.value_lengths().to_numpy().astype(np.int64)
            own = lists.flatten()
            column = {name: own.field(name) for name in ("key", "salt", "place", "row", "first", "last", "several")}
            first, last = (column[c].to_numpy().astype(np.int64) for c in ("first", "last"))
            begin = np.repeat(offsets[:-1], counts) + first
            sizes = last - first + length
            for part in np.array_split(np.arange(len(sizes)), max(1, int(sizes.sum()) // (8 << 20))):
                taken = data[ragged(begin[part], sizes[part])]
                bounds = np.concatenate([[0], np.cumsum(sizes[part])]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(bounds), pa.py_buffer(taken)])
                chosen = pa.array(part)
                yield pa.RecordBatch.from_arrays([*(column[c].take(chosen) for c in ("key", "salt", "place", "row", "first", "several")), raw], names=["key", "salt", "place", "row", "first", "several", "bytes"])

    per = compare.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("key", "salt", "place", "row", "first", "last", "several")).alias("runs"))
    per = stored(per, "wanted")
    some, _ = sifted(rows, F.col("row"), sieve(per, "r"))
    return some.join(per, F.col("row") == F.col("r")).select("text", "runs").mapInArrow(run, _TEXTS)


def _compared(texts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Repeated stretches in bytes of the texts (row, start, stop); for salted keys also, with a and b, each shard's different strings (start: where)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin_task()
        held: list[pd.DataFrame] = []
        size, before = 0, None
        for df in batches:
            if not len(df):
                continue
            # rows with the same doc_id and text have the same contexts, which follow each other: one is enough
            again = np.logical_and.reduce([df[c].to_numpy()[1:] == df[c].to_numpy()[:-1] for c in _PLACE])
            again = np.append(before == tuple(df[c].iat[0] for c in _PLACE), again)
            before = tuple(df[c].iat[-1] for c in _PLACE)
            df = df[~again]
            while len(df):
                same = held and (df["key"].iat[0], df["salt"].iat[0]) == (held[-1]["key"].iat[-1], held[-1]["salt"].iat[-1])
                grown = size + np.cumsum(df["bytes"].str.len().to_numpy())
                new = np.append(not same, (df["key"].to_numpy()[1:] != df["key"].to_numpy()[:-1]) | (df["salt"].to_numpy()[1:] != df["salt"].to_numpy()[:-1]))
                over = np.flatnonzero(grown > SHARD)
                if not len(over):
                    held.append(df)
                    size = int(grown[-1])
                    break
                cut = np.flatnonzero(new[: over[0] + 1])
                if size and not (len(cut) and cut[-1]):
                    # the shard ends with the last whole group before these rows
                    whole = pd.concat(held, ignore_index=True)
                    if len(cut):
                        yield solved(whole)
                        held, size = [], 0
                        continue
                    mark = (whole["key"].to_numpy() != whole["key"].iat[-1]) | (whole["salt"].to_numpy() != whole["salt"].iat[-1])
                    k = int(np.flatnonzero(mark)[-1]) + 1 if mark.any() else 0
                    if k:
                        yield solved(whole.iloc[:k])
                    else:  # one group that is larger than a shard: see _deal, which bounds what a group has
                        raise ValueError("a group of contexts exceeds a shard")
                    held = [whole.iloc[k:]]
                    size = int(held[0]["bytes"].str.len().sum())
                    continue
                k = int(cut[-1]) if len(cut) and cut[-1] else 0
                if not k:
                    raise ValueError("a group of contexts exceeds a shard")
                held.append(df.iloc[:k])
                yield solved(pd.concat(held, ignore_index=True))
                held, size, df = [], 0, df.iloc[k:]
        if held:
            yield solved(pd.concat(held, ignore_index=True))

    def solved(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["place", "row", "first"], kind="stable")
        sizes = df["bytes"].str.len().to_numpy()
        data = np.frombuffer(b"".join(df["bytes"]), np.uint8)
        hashed = df["salt"].to_numpy() > 0
        which, first, last, strings = _shard({"several": df["several"].to_numpy(bool)}, data, sizes, length, keep_first, hashed.any())
        row, begin, place = df["row"].to_numpy(), df["first"].to_numpy(np.int64), df["place"].to_numpy()
        out = pd.DataFrame({"row": row[which], "start": begin[which] + first, "stop": begin[which] + last + length, "a": 0, "b": 0, "place": 0})
        if strings is not None:
            a, b, of, at = strings
            some = hashed[of]
            a, b, of, at = a[some], b[some], of[some], at[some]
            out = pd.concat([out, pd.DataFrame({"row": row[of], "start": begin[of] + at, "stop": -1, "a": a, "b": b, "place": place[of]})], ignore_index=True)
        return out

    ordered = texts.repartition("key", "salt").sortWithinPartitions("key", "salt", "place", "row", "first")
    return ordered.mapInPandas(run, _FOUND)


def _deal(compare: DataFrame, length: int) -> DataFrame:
    """compare with salt: 0, or for keys with many contexts the shard, 1 and up, that a context is dealt to."""
    most = min(HOT, SHARD // (4 * length))
    hot = compare.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = stored(hot, "hot")  # on its own, so that the join below is of two shuffles at most, which Spark splits where one key has most rows
    spread = F.when(F.col("n").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("row", "first"), F.ceil(F.col("n") / most)))
    return compare.join(hot, compare["key"] == hot["k"], "left").withColumn("salt", spread.cast("int")).drop("k", "n")


def repeated_spans(docs: DataFrame, length: int = 200, keep: str = "first") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows of docs as doc_id, text, row, and for those with any the bytes to remove: row, spans of (start, stop)."""
    if keep not in ("first", "none") or not 2 <= length <= 100_000:
        raise ValueError("keep is 'first' or 'none', length 2 to 100,000")
    keep_first = keep == "first"
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.coalesce(F.col("text"), F.lit("")))
    rows = texts_of(docs, row.alias("row"))
    met = stored(_met(_runs_of(rows, length, keep_first), keep_first), "runs")
    compare = _deal(met.where("compare"), length)
    found = stored(_compared(_contexts(rows, compare, length), length, keep_first), "found")
    whole = met.where("settled").select("row", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    spans = whole.unionAll(found.where("stop >= 0").select("row", "start", "stop"))
    strings = found.where("stop < 0")
    if strings.head(1):
        # one string of each shard for each different one: those of several shards are repeated
        first = strings.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("place", "row", "start")).alias("lead")).where("n > 1").select(F.col("a").alias("a2"), F.col("b").alias("b2"), "lead")
        again = strings.join(first, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")))
        if keep_first:
            again = again.where(F.struct("place", "row", "start") != F.col("lead"))
        spans = spans.unionAll(again.select("row", "start", (F.col("start") + length).alias("stop")))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(1).value_lengths().to_numpy().astype(np.int64)
            own = batch.column(1).flatten()
            start, stop = own.field("start").to_numpy().astype(np.int64), own.field("stop").to_numpy().astype(np.int64)
            of = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((start, of))
            start, stop = start[order], stop[order]
            lift = of * (1 << 40)  # texts end to end, far apart
            reach = np.maximum.accumulate(stop + lift)
            new = np.append(True, (start + lift)[1:] > reach[:-1])
            at = np.flatnonzero(new)
            ends = reach[np.append(at[1:], len(start)) - 1] - lift[at]
            sizes = np.bincount(of[at], minlength=len(counts))
            values = pa.StructArray.from_arrays([pa.array(start[at]), pa.array(ends)], ["start", "stop"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)], names=["row", "spans"])

    # a text's own spans, of which there are no more than it has anchors
    per = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return rows, per.mapInArrow(joined, "row long, spans array<struct<start: long, stop: long>>")


def dedup(docs: DataFrame, length: int = 200, keep: str = "first") -> DataFrame:
    """doc_id, n_bytes, kept (binary: the UTF-8 bytes that stay), n_removed and spans (removed, merged, in bytes) for every row of docs.

    n_bytes is the length of the input's UTF-8 bytes: those of kept and n_removed together.

    keep "first": a string of `length` bytes stays where it starts first (in order of doc_id, null last, then
    place); bytes of later ones go. keep "none": all of them go. Strings never cross documents and are judged on
    the input; overlapping ones count. Null texts count as empty; shorter texts than `length` stay. Repeated
    rows are documents of their own; with keep "first", rows of one doc_id and text stay alike. Other columns
    are not looked at; an empty table gives no rows.
    """
    rows, spans = repeated_spans(docs, length, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            sizes, kept, removed = [], [], []
            for text, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sizes.append(len(text))
                parts, done, gone = [], 0, 0
                for s in own or ():
                    parts.append(text[done : s["start"]])
                    done = s["stop"]
                    gone += s["stop"] - s["start"]
                kept.append(b"".join([*parts, text[done:]]) if own else text)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), batch.column(2)], names=["doc_id", "n_bytes", "kept", "n_removed", "spans"])

    # texts of which nothing goes aren't shuffled
    spans = stored(spans.withColumnRenamed("row", "r"), "spans")
    some, rest = sifted(rows, F.col("row"), sieve(spans, "r"))
    joined = some.join(spans, F.col("row") == F.col("r"), "left").select("doc_id", "text", "spans")
    joined = joined.unionByName(rest.select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, kept binary, n_removed long, spans array<struct<start: long, stop: long>>")
