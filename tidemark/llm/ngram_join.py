"""Similarity join of documents on sets of word n-grams, by prefix filtering.

Documents with the same set are one class. A set's n-grams are ordered rare first, by counts of all documents
in a sketch of fixed size, then by hash. Two sets with the wanted Jaccard similarity share one of the first
few n-grams of both (prefix filter), have similar sizes (length filter), enough left after the shared one
(positional filter), and similar counts in ranges of hashes (suffix filter). What passes is verified, each
pair of classes once, on the whole texts.

For groups of near copies not all pairs are made: the members of a prefix n-gram first meet one of them, and
then only members that are not yet in one component meet. Every pair of classes that shares a prefix n-gram
is either verified or already in one component, so components are exact.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import begin_task, bucketed, discard, mixed, sieve, sifted, slices, spare, stored, temporary, texts_of

#: Cells of the frequency sketch, by the upper bits of a hash, and the parts it is added up in; ranges of hashes that the suffix filter counts.
SKETCH_BITS, PARTS, RANGES = 24, 64, 32
#: N-grams in more documents than this (by the sketch) are dealt out by salt as well.
HOT = 5_000
#: Rounds in which classes of one n-gram meet singly, before all that are left do.
ROUNDS = 3
#: Pairs of one class beyond which they are dealt to several tasks, each of which gets its text.
MANY = 1_000
#: Bytes of text whose words are told apart at once.
SLICE = 1 << 20
#: Entries in a worker's table of hashed words; beyond it starts anew.
MOST_WORDS = 250_000


class _Words(dict):
    """Numbers words as they come; hashes[number] is a word's hash."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        if k == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[k] = xxhash.xxh64_intdigest(word)
        return k


_words = _Words()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    global _words
    if len(_words) > MOST_WORDS:
        _words = _Words()
    which = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    return _words.hashes[which]


def _forget() -> None:
    global _words
    _words = _Words()


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Of each text, the sorted hashes of its distinct n-grams of `size` words; with fewer words, of the whole sequence."""
    flat: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        part = text.encode().lower().split()  # bytes: only A-Z are lower-cased, and words end at 20 and 09-0D
        counts[k] = len(part)
        flat += part
    if not flat:
        return [np.zeros(0, np.uint64)] * len(texts)
    hashes = _word_hashes(flat)
    del flat
    ends = np.cumsum(counts)
    last = max(0, len(hashes) - size + 1)
    grams = np.zeros(last, np.uint64)
    for k in range(size):
        grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + last])
    found = []
    for start, end, n in zip((ends - counts).tolist(), ends.tolist(), counts.tolist(), strict=True):
        if n >= size:
            own = np.sort(grams[start : end - size + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif n:
            whole = np.full(1, n, np.uint64)
            for h in hashes[start:end]:
                whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + h)
            own = whole
        else:
            own = np.zeros(0, np.uint64)
        found.append(own)
    return found


def class_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte, in order: as they are below 128, then by eighths of octaves."""
    high = 128 + np.floor(8 * np.log2(np.maximum(counts, 128) / 128))
    return np.minimum(255, np.where(counts < 128, counts, high)).astype(np.uint8)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key: doc_id, or for a null one a hash of the text, and row: a hash of both."""
    return texts_of(docs, _row().alias("row")).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))


def _row() -> Column:
    """A hash of doc_id and text; ids of null and 0 differ."""
    return F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.coalesce("text", F.lit("")))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Of each document doc_id, key, row, n, class and ranges; besides, as part and cells, the sketch of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("words", _forget)
        sketch = np.zeros(1 << SKETCH_BITS, np.uint16)
        names = ["doc_id", "key", "row", "n", "class", "ranges", "part", "cells"]
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            ranges = np.zeros((len(sets), RANGES), np.int32)
            for k, own in enumerate(sets):
                ranges[k] = np.bincount((own >> np.uint64(59)).astype(np.int64), minlength=RANGES)
            cells, counts = np.unique(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
            sketch[cells] = np.minimum(65_535, sketch[cells].astype(np.int64) + counts)
            rows = [batch.column(0), batch.column(3), batch.column(2), pa.array([len(x) for x in sets], pa.int32()), pa.array(map(class_of, sets), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(ranges.ravel()), RANGES).cast(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)
        if sketch.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(sketch, PARTS)]
            none = [pa.nulls(PARTS, kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return _keyed(docs).mapInArrow(run, "doc_id long, key long, row long, n int, class long, ranges array<int>, part int, cells binary")


def _sketch(sets: DataFrame) -> np.ndarray:
    """The level of the number of documents with an n-gram of each cell: 2^SKETCH_BITS bytes, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        begin_task("words", _forget)
        rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True))
        for part, own in groupby(rows, lambda row: row[0]):  # rows come by part, so that only one is in memory
            total = np.zeros((1 << SKETCH_BITS) // PARTS, np.int64)
            for _, cells in own:
                total += np.frombuffer(zlib.decompress(cells), np.int64 if last else np.uint16)
            raw = _level(total).tobytes() if last else zlib.compress(total.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw], pa.binary())], names=["part", "cells"])

    cells = sets.where("part is not null").select("part", "cells", F.spark_partition_id().alias("task"))
    # added up in two steps, the first in about as many groups of tasks as each group has tasks
    several = max(1, math.isqrt(sets.rdd.getNumPartitions()))
    some = cells.repartition(F.col("part"), F.pmod("task", F.lit(several))).sortWithinPartitions("part").mapInArrow(lambda b: run(b, False), "part int, cells binary")
    found = some.repartition("part").sortWithinPartitions("part").mapInArrow(lambda b: run(b, True), "part int, cells binary").collect()
    sketch = np.zeros((PARTS, (1 << SKETCH_BITS) // PARTS), np.uint8)
    for part, cells in found:
        sketch[part] = np.frombuffer(cells, np.uint8)
    return sketch.ravel()


def _least(percent: int, n):
    """The least whole number that is at least percent / 100 * n."""
    return -(-percent * n // 100)


def _prefixes(docs: DataFrame, size: int, percent: int, sketch: Broadcast) -> DataFrame:
    """gram, salt (0 unless hot), class, n, place: the prefix n-grams of every document, rare first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("words", _forget)
        levels, hot = sketch.value, int(_level(np.array([HOT]))[0])
        for batch in slices(batches, "text", SLICE):
            seen: dict[int, np.ndarray] = {}
            for own in shingle_sets(batch.column(1).to_pylist(), size):
                if len(own):
                    seen[class_of(own)] = own  # copies of one slice give their entries once
            grams, salts, classes, sizes, places = [], [], [], [], []
            for c, own in seen.items():
                n = len(own)
                first = n - int(_least(percent, n)) + 1
                level = levels[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[:first]  # ties by hash, as own is sorted
                grams.append(own[order])
                level = level[order].astype(np.int64)
                salts.append(np.where(level >= hot, 1 + c % (1 << np.maximum(0, (level - hot) // 8 + 1)), 0))
                classes.append(np.full(first, c, np.int64))
                sizes.append(np.full(first, n, np.int32))
                places.append(np.arange(first, dtype=np.int32))
            if grams:
                columns = [np.concatenate(grams).view(np.int64), np.concatenate(salts).astype(np.int32), np.concatenate(classes), np.concatenate(sizes), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["gram", "salt", "class", "n", "place"])

    return texts_of(docs).mapInArrow(run, "gram long, salt int, class long, n int, place int")


class _Met:
    """Rows in order of gram, salt, n, class: drops repeated rows and those that no other row of their n-gram can link with."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.last: pd.DataFrame | None = None  # the last row so far
        self.held = False  # it has not gone out, as its n-gram has no other row yet

    def rows(self, df: pd.DataFrame) -> pd.DataFrame:
        if self.last is not None:
            df = pd.concat([self.last, df], ignore_index=True)
        same = ((df["gram"] == df["gram"].shift()) & (df["salt"] == df["salt"].shift())).to_numpy()
        repeated = same & (df["class"] == df["class"].shift()).to_numpy()
        df, same = df[~repeated].reset_index(drop=True), same[~repeated]
        known = self.last is not None and not self.held  # the first n-gram's earlier rows have gone out
        start = np.flatnonzero(~same)
        lengths = np.diff(np.append(start, len(df)))
        run = np.repeat(np.arange(len(start)), lengths)
        # n-grams with rows in other batches, or salted, are judged by having several rows only
        open_ = (run == len(start) - 1) | (df["salt"].to_numpy() > 0)
        if known:
            open_ |= run == 0
        n, place = df["n"].to_numpy(np.int64), df["place"].to_numpy(np.int64)
        # sizes ascend, so a neighbour is the likeliest partner by length
        near = np.append(False, same[1:] & (n[:-1] >= _least(self.percent, n[1:])))
        partner = near | np.append(near[1:], False)
        # of a pair that is alone with its n-gram, positions tell whether enough can follow
        x = start[lengths == 2]
        both = 100 + self.percent
        enough = -(-self.percent * (n[x] + n[x + 1]) // both)
        fits = (place[x] <= n[x] + 2 * self.percent * -n[x] // both) & (np.minimum(n[x] - place[x], n[x + 1] - place[x + 1]) >= enough)
        partner[x[~fits]] = partner[x[~fits] + 1] = False
        several = (lengths > 1)[run] | (df["salt"].to_numpy() > 0)
        if known:
            several[run == 0] = True
        out = several & (partner | open_)
        if known:
            out[0] = False  # it went out before
        self.held = not several[-1]
        self.last = df.iloc[-1:]
        return df[out]


def _shared_grams(prefixes: DataFrame, percent: int) -> DataFrame:
    """Of prefixes the rows whose n-gram other classes have that they may link with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = _Met(percent)
        for df in batches:
            if len(df):
                yield met.rows(df).drop(columns="salt")

    ordered = prefixes.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "n", "class")
    return ordered.mapInPandas(run, "gram long, class long, n int, place int")


def _cross(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of classes with different labels that share a prefix n-gram and pass the length and positional filters."""
    x = entries.select("gram", *[F.col(c).alias(f"x_{c}") for c in ("class", "n", "place", "label")])
    y = entries.select("gram", *[F.col(c).alias(f"y_{c}") for c in ("class", "n", "place", "label")])
    least = lambda n, of: F.expr(f"(({n}) * {percent} + {of - 1}) div {of}")
    n, both = F.col("x_n"), 100 + percent
    enough = least("x_n + y_n", both)
    pairs = x.join(y, "gram").where(
        (F.col("x_label") != F.col("y_label"))
        & ((n < F.col("y_n")) | ((n == F.col("y_n")) & (F.col("x_class") < F.col("y_class"))))
        & (n >= least("y_n", 100))
        & (F.col("x_place") <= n - least("2 * x_n", both))
        & (F.least(n - F.col("x_place"), F.col("y_n") - F.col("y_place")) >= enough)
    )
    return pairs.select(F.col("x_class").alias("a"), F.col("y_class").alias("b")).distinct()


def _verify(pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs a, b (stored) whose sets have the wanted similarity.

    classes (class, n, ranges, text) is bucketed by class, so of each join only the pairs are shuffled; they
    are the side that is hashed. Classes in over MANY pairs, as that all members of a group meet, are copied to
    as many tasks as their pairs need.
    """
    hashed = lambda df: df.hint("shuffle_hash")
    each = pairs.select(F.lit("a").alias("side"), F.col("a").alias("of")).unionAll(pairs.select(F.lit("b"), "b"))
    many = each.groupBy("side", "of").agg(F.count("*").alias("k")).where(F.col("k") > MANY).select("side", "of", F.ceil(F.col("k") / MANY).cast("int").alias("tasks"))
    many = stored(many, "many")
    crowded = {r["side"] for r in many.select("side").distinct().collect()}

    def met(rows: DataFrame, side: str, *columns: str) -> DataFrame:
        """rows with the columns of their class of that side."""
        own = classes.select(F.col("class").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        if side not in crowded:
            return own.join(hashed(rows), side)
        few = many.where(F.col("side") == side).select(F.col("of").alias("_of"), "tasks")
        dealt = stored(rows.join(few, F.col(side) == F.col("_of"), "left"), "dealt")
        copies = own.join(few, F.col(side) == F.col("_of")).select("*", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("_task")).drop("_of", "tasks")
        salted = dealt.where("tasks is not null").withColumn("_task", F.pmod(F.xxhash64("a", "b"), "tasks").cast("int")).drop("_of", "tasks")
        plain = own.join(hashed(dealt.where("tasks is null").drop("_of", "tasks")), side)
        return plain.unionByName(salted.join(copies, [side, "_task"]).drop("_task"))

    apart = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, d: s + d)
    # |A xor B| is at least the sum of differences, and |A or B| = (n_a + n_b + |A xor B|) / 2
    near = (100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    likely = met(met(pairs, "a", "n", "ranges"), "b", "n", "ranges").where(near).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("words", _forget)
        for batch in slices(slices(batches, "text_a", SLICE // 2), "text_b", SLICE // 2):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # rows that meet the same text often follow each other: each text of a slice is taken apart once
            different = list(dict.fromkeys(batch.column(2).to_pylist() + batch.column(3).to_pylist()))
            sets = dict(zip(different, shingle_sets(different, size), strict=True))
            keep = []
            for p, q, s, t in zip(a, b, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = sets[s], sets[t]
                if class_of(s) != p or class_of(t) != q:  # another text of a repeated doc_id
                    continue
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= percent * (len(s) + len(t) - common):
                    keep.append((p, q))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in keep], pa.int64()), pa.array([x[1] for x in keep], pa.int64())], names=["a", "b"])

    rows = met(met(likely, "a", "text"), "b", "text")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


class _Prepared:
    """Classes, prefix entries and candidate texts of one join, as tables in the shared folder."""

    def __init__(self, docs: DataFrame, size: int, percent: int) -> None:
        if not 0 < percent <= 100 or size < 1:
            raise ValueError("percent must be 1 to 100, size at least 1")
        self.size, self.percent = size, percent
        sets = stored(_sets(docs, size), "sets")
        self.sets, self.members = sets, sets.where("part is null").select("doc_id", "row", "n", "class")
        sketch = docs.sparkSession.sparkContext.broadcast(_sketch(sets))
        self.entries = stored(_shared_grams(_prefixes(docs, size, percent, sketch), percent), "entries")
        candidates = self.entries.select("class").distinct()
        known = sets.where("part is null and n > 0").groupBy("class").agg(F.min("key").alias("id"), F.first("n").alias("n"), F.first("ranges").alias("ranges"))
        known = stored(known.join(candidates, "class", "left_semi"), "known")
        wanted = sieve(known, "id")
        some, _ = sifted(_keyed(docs), F.col("key"), wanted)  # texts of other documents stay where they are
        self.classes = bucketed(some.join(known, F.col("key") == F.col("id")).select("class", "n", "ranges", "text"), "class")
        discard(known, wanted)

    def verify(self, pairs: DataFrame) -> DataFrame:
        with temporary(pairs.sparkSession) as made:
            found = stored(_verify(pairs, self.classes, self.size, self.percent), "links")
            spare(made, found)
        return found


def links(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links a, b between different classes, and the members of classes: doc_id, n, class.

    Two documents link when 100 * |A and B| >= percent * |A or B| of their sets of n-grams of `size` words;
    those of one class always do, unless their set is empty (n = 0), which links with nothing.
    """
    p = _Prepared(docs, size, percent)
    return p.verify(stored(_cross(p.entries.withColumn("label", F.col("class")), percent), "pairs")), p.members.drop("row")


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for every row of docs.

    Words are what white space of ASCII parts, A-Z lower-cased. Null or empty texts have an empty set and stay
    alone, with their own doc_id. Repeated rows are documents of one class. A null doc_id counts as larger
    than all others. Other columns are not looked at; an empty table gives no rows.
    """
    return _grouped(docs, size, percent)


def _grouped(docs: DataFrame, size: int, percent: int, *columns: str) -> DataFrame:
    """groups(), and of row and label (of the group; null without words) those that are asked for. Its tables go, even if it fails."""
    with temporary(docs.sparkSession) as made:
        result = _components_of(docs, size, percent, *columns)
        spare(made, result)
    return result


def _components_of(docs: DataFrame, size: int, percent: int, *columns: str) -> DataFrame:
    p = _Prepared(docs, size, percent)
    done = [p.entries, p.classes]  # tables that aren't needed once the labels are known
    # the share of a class's prefix that others have: the original of a group of near copies has more than its copies
    prefix = F.col("n") + F.expr(f"({percent} * -n) div 100") + 1
    strength = p.entries.groupBy(F.col("class").alias("c"), "n").agg(F.count("*").alias("k")).select("c", (F.col("k") / prefix).alias("strength"))
    # by n-gram, so that the rounds shuffle none of it
    entries = bucketed(p.entries.join(strength, F.col("class") == F.col("c")).drop("c"), "gram")
    done.append(entries)
    open_ = entries.withColumn("label", F.col("class"))
    found = tested = docs.sparkSession.createDataFrame([], "a long, b long")
    label = None
    for turn in range(ROUNDS):
        # each class meets the strongest member of another component, which is the n-gram's strongest or, later, picked anew
        rank = F.struct(F.xxhash64("label", F.lit(turn)) if turn else F.lit(0), "strength", "class")
        centre = open_.groupBy(F.col("gram").alias("g")).agg(F.max_by(F.struct("n", "class", "label", "strength"), rank).alias("c"))
        ahead = open_.join(centre, F.col("gram") == F.col("g")).where((F.col("label") != F.col("c.label")) & (100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")))
        ahead = ahead.groupBy("class").agg(F.max_by("c.class", F.struct("c.strength", "c.class")).alias("other"))
        pairs = ahead.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti") if turn else pairs, "pairs")
        more = p.verify(pairs)
        done += [pairs, more, *([label] if label is not None else [])]
        tested, found = (tested.unionAll(pairs), found.unionAll(more)) if turn else (pairs, more)
        label = components(found)
        labelled = entries.join(label, entries["class"] == label["node"], "left").withColumn("label", F.coalesce("label", "class")).drop("node")
        split = labelled.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gram")
        # entries whose n-gram members of different components have; no others can add links
        open_ = bucketed(labelled.join(split.hint("shuffle_hash"), "gram", "left_semi"), "gram", dealt=True)
        done.append(open_)
        per = open_.groupBy("gram", "label").agg(F.count("*").alias("k")).groupBy("gram").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
        size_, left = per.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2), F.lit(0.0))).first()
        entries = open_.drop("label")
        if left <= 2 * size_:
            break
    # all that are left in different components
    pairs = stored(_cross(open_, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
    more = p.verify(pairs)
    done += [pairs, more]
    if more.head(1) or label is None:
        done += [label] if label is not None else []
        label = components(found.unionAll(more))
    discard(*done)
    named = p.members.join(label, (p.members["class"] == label["node"]) & (p.members["n"] > 0), "left").select("doc_id", "row", "n", F.when(F.col("n") > 0, F.coalesce("label", "class")).alias("label"))
    first = named.where("label is not null").groupBy(F.col("label").alias("l")).agg(F.min("doc_id").alias("first"))
    first = stored(first, "first")  # on its own, so that Spark may split the rows of a large group in the join
    found_in = named.join(first, named["label"] == first["l"], "left")
    result = found_in.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"), *columns)
    result = stored(result, "groups")
    discard(p.sets, label, first)
    return result


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group, that with the smallest doc_id (null last; of one id by a hash of the text); all columns.

    Rows without words stay. Rows of one doc_id, or of none, are documents of their own, so those with
    different texts stay unless they link.
    """
    found = _grouped(docs, size, percent, "row", "label")
    per = found.where("label is not null").groupBy("label", "row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    lead = per.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "rows")).alias("lead"), F.count("*").alias("members")).where("members > 1 or lead.rows > 1")
    lead = stored(lead, "lead")  # on its own, so that Spark may split the rows of a large group in the join
    # what goes, and what stays but comes several times; no other text needs to move
    told = per.join(lead.select(F.col("label").alias("l"), "lead"), F.col("label") == F.col("l")).select("row", (F.col("row") != F.col("lead.row")).alias("goes"), "rows")
    told = stored(told.where("goes or rows > 1").select(F.col("row").alias("_row_told"), F.col("goes").alias("_goes")), "told")
    discard(found, lead)
    some, rest = sifted(docs, _row(), sieve(told, "_row_told"))
    met = some.select(F.struct("*").alias("_all"), _row().alias("_id")).join(told, F.col("_id") == F.col("_row_told"), "left")
    kept = rest.unionByName(met.where("_goes is null").select("_all.*"))
    if not told.where("not _goes").head(1):
        return kept
    return kept.unionByName(met.where("not _goes").select("_all.*").dropDuplicates(["doc_id", "text"]))
