"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

All texts walk by the same random bits: at step j the walk writes the character it stands on, and goes to the
next one if the bit of (that character's class, j) is 1. Texts with few edits fall into step again soon after
each, so that what they write differs in few places. The fingerprint keeps one random bit of the character
written at chosen steps: up to SAMPLES in each octave of steps [2^k, 2^(k+1)), so texts of any length have
one, and fingerprints of different lengths compare where both have steps.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import mixed, ragged, slices, stored, texts_of

SAMPLES = 128
OCTAVES = 32
CLASSES, PERIOD = 64, 1 << 15
SLICE = 8 << 20
#: With fewer texts left, a walk goes on text by text.
FEW = 48

_rng = np.random.default_rng(20240229)
#: For each class and step (modulo PERIOD) the steps until the next bit that is 1.
_bits = _rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
_bits[:, -1] = 1
_WAIT = np.zeros((CLASSES, PERIOD), np.uint8)
_run = np.zeros(CLASSES, np.uint8)
for _j in range(PERIOD - 1, -1, -1):
    _run = np.where(_bits[:, _j] == 1, 0, _run + 1).astype(np.uint8)
    _WAIT[:, _j] = _run
_WAIT = _WAIT.ravel()
_WAITS = _WAIT.tobytes()
_CLASS = (mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) & np.uint64(CLASSES - 1)).astype(np.int64) * PERIOD
#: The steps that are kept, in order, and where each octave begins among them.
_STEPS = np.concatenate([[0], *[np.sort(_rng.choice(1 << k, min(SAMPLES, 1 << k), replace=False) + (1 << k)) if k < 20 else np.sort(_rng.integers(0, 1 << k, SAMPLES) + (1 << k)) for k in range(OCTAVES)]])
_OCTAVE = np.concatenate([[0], 1 + np.floor(np.log2(_STEPS[1:])).astype(np.int64)])
_COIN = _rng.integers(0, 2, (1 << 8, len(_STEPS)), dtype=np.uint8)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _rows(codes: np.ndarray) -> np.ndarray:
    """Where each character's row of _WAIT begins."""
    if len(codes) and codes.max() >= 1 << 16:
        return np.where(codes < 1 << 16, _CLASS[np.minimum(codes, (1 << 16) - 1)], (mixed(codes + 1) & np.uint64(CLASSES - 1)).astype(np.int64) * PERIOD)
    return _CLASS[codes]


def walk(codes: np.ndarray, sizes: np.ndarray, begin: np.ndarray, shift: int | np.ndarray = 0) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each character is first written, of texts end to end that begin at the given steps, and the step after each text.

    With another shift (of all texts, or of each) the walk goes by other bits.
    """
    rows = _rows(codes)
    steps = np.zeros(len(codes), np.int64)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    at, step, moved = starts[order].copy(), begin[order].astype(np.int64), np.broadcast_to(shift, len(sizes))[order]
    active = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), "right")  # texts with an i-th character
    done = 0
    for m in active.tolist():
        if m < FEW:
            break
        now, here = step[:m], at[:m]
        steps[here] = now
        now += _WAIT[rows[here] + (now + moved[:m] & (PERIOD - 1))]
        now += 1
        here += 1
        done += 1
    for k in range(int(active[done]) if done < len(active) else 0):
        first, last = int(at[k]), int(starts[order[k]] + sizes[order[k]])
        j, by, written = int(step[k]), int(moved[k]), []
        for row in rows[first:last].tolist():
            written.append(j)
            j += _WAITS[row + (j + by & 32767)] + 1
        steps[first:last] = written
        step[k] = j
    ends = np.zeros(len(sizes), np.int64)
    ends[order] = step
    return steps, ends


class Print:
    """The kept bits of one text, and the number of its steps."""

    __slots__ = ("bits", "end")

    def __init__(self, codes: np.ndarray, steps: np.ndarray, end: int) -> None:
        kept = int(np.searchsorted(_STEPS, end)) if len(codes) else 0
        written = codes[np.searchsorted(steps, _STEPS[:kept], "right") - 1]
        self.bits = _COIN[(written * 0x9E3779B1 >> 7) & 0xFF, np.arange(kept)]
        self.end = int(end) if len(codes) else 0

    def text(self) -> str:
        return f"{self.end:x}." + base64.b64encode(np.packbits(self.bits).tobytes()).decode()

    @classmethod
    def read(cls, text: str) -> Print:
        end, _, bits = text.partition(".")
        self = cls.__new__(cls)
        self.end = int(end, 16)
        kept = int(np.searchsorted(_STEPS, self.end))
        self.bits = np.unpackbits(np.frombuffer(base64.b64decode(bits), np.uint8))[:kept]
        return self


def likeness(a: Print, b: Print) -> float:
    """1 less the estimated share of steps that differ, 0 to 1: 1 for equal texts, about 0 for unrelated ones."""
    long = max(a.end, b.end)
    if not long:
        return 1.0
    both, all_ = min(len(a.bits), len(b.bits)), max(len(a.bits), len(b.bits))
    octave = _OCTAVE[:all_]
    kept = np.bincount(octave)
    # a bit that differs tells of two characters that differ, half of which agree by chance; steps of one text alone differ
    differ = 2 * np.bincount(octave[:both], a.bits[:both] != b.bits[:both], minlength=len(kept)) + np.bincount(octave[both:], minlength=len(kept))
    width = np.append(1, 1 << np.arange(len(kept) - 1))
    width[-1] = long - (width[:-1].sum() if len(width) > 1 else 0)
    return float(np.clip(1 - (width * np.minimum(1, differ / np.maximum(1, kept))).sum() / long, 0, 1))


def prints(texts: list[str], shift: int = 0) -> tuple[list[Print], list[tuple[np.ndarray, np.ndarray]]]:
    """The fingerprint of each text, and its characters with their steps (and the step after the last)."""
    codes = _codes(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    steps, ends = walk(codes, sizes, np.zeros(len(texts), np.int64), shift)
    cuts = np.cumsum(sizes)[:-1]
    walks = [(c, s) for c, s in zip(np.split(codes, cuts), np.split(steps, cuts), strict=True)]
    return [Print(c, s, e) for (c, s), e in zip(walks, ends.tolist(), strict=True)], [(c, np.append(s, e)) for (c, s), e in zip(walks, ends.tolist(), strict=True)]


def edited_prints(walks: list[tuple[np.ndarray, np.ndarray]], kept: list[int], tails: list[str]) -> list[Print]:
    """Fingerprints of texts of which the first `kept` characters stay and the rest becomes a tail; the walk goes on from there."""
    codes = _codes(tails)
    sizes = np.fromiter(map(len, tails), np.int64, len(tails))
    steps, ends = walk(codes, sizes, np.array([s[k] for (_, s), k in zip(walks, kept, strict=True)], np.int64))
    cuts = np.cumsum(sizes)[:-1]
    return [Print(np.concatenate([c[:k], d]), np.concatenate([s[:k], t]), e) for (c, s), k, d, t, e in zip(walks, kept, np.split(codes, cuts), np.split(steps, cuts), ends.tolist(), strict=True)]


def fingerprints(docs: DataFrame, shift: int = 0) -> DataFrame:
    """doc_id and fingerprint of each whole text; null counts as empty. Equal texts have equal fingerprints; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found, _ = prints(batch.column(1).to_pylist(), shift)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.text() for p in found], pa.string())], names=["doc_id", "fingerprint"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fingerprint string")


#: Texts of a slice for which several walks are made at once: each holds its characters and steps anew.
WALKED = 2 << 20


def walked(docs: DataFrame, walks: int) -> DataFrame:
    """doc_id, walk and fingerprint by so many walks of each whole text, all in one pass."""
    shifts = np.arange(walks) * 7919

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", WALKED):
            texts = batch.column(1).to_pylist()
            codes, sizes = np.tile(_codes(texts), walks), np.tile(np.fromiter(map(len, texts), np.int64, len(texts)), walks)
            steps, ends = walk(codes, sizes, np.zeros(len(sizes), np.int64), np.repeat(shifts, len(texts)))
            cuts = np.cumsum(sizes)[:-1]
            found = [Print(c, s, e).text() for c, s, e in zip(np.split(codes, cuts), np.split(steps, cuts), ends.tolist(), strict=True)]
            ids = pa.concat_arrays([batch.column(0)] * walks)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.repeat(np.arange(walks, dtype=np.int32), len(texts))), pa.array(found, pa.string())], names=["doc_id", "walk", "fingerprint"])

    return texts_of(docs).mapInArrow(run, "doc_id long, walk int, fingerprint string")


#: Bands of the near-copy search: the fewest bits of a band, and bands in each octave.
BAND_BITS, BANDS = 12, 10
#: Steps before which texts of as many steps meet, and a logarithm of how many such texts there are.
SHORT, SHORT_LOG = 256, 6


def near_copies(docs: DataFrame, similarity: float = 0.8, walks: int = 4) -> DataFrame:
    """doc_id, copy_of, near: documents held against earlier ones of each of their buckets, as far as they are alike.

    After an edit a walk falls into step again only with some chance, so several are made, by different bits;
    the best likeness of a pair counts.
    A bucket is a band of bits of one octave; bands have more bits the more fingerprints there are, so that few
    unrelated documents share one. Equal fingerprints are one class, held against others once; a member of a
    class is a copy of its first document. In a bucket each document meets the first one of every group of
    copies so far, and the other members of groups whose first one it isn't like: all pairs are either verified
    or of one group there. So groups of copies make as many pairs as rows, and unrelated ones hide nothing.
    Texts of under SHORT steps meet those of as many steps. Documents without text are not compared.
    """
    found = _near_by(docs, similarity, walks)
    return found.groupBy("doc_id", "copy_of").agg(F.max("near").alias("near"))


class _Bucket:
    """The documents of a bucket so far, in groups: `packed` has their bits, 16 bytes for each octave, `valid` which of them there are."""

    def __init__(self) -> None:
        self.docs: list[int] = []
        self.prints: list[Print] = []
        self.group: list[int] = []
        self.firsts: list[int] = []
        self.packed = self.valid = np.zeros((0, _SLOTS // 64), np.uint64)

    def add(self, doc: int, print_: Print, packed: np.ndarray, valid: np.ndarray, group: int) -> None:
        n = len(self.docs)
        if n == len(self.packed):
            more = np.zeros((max(4, n), _SLOTS // 64), np.uint64)
            self.packed, self.valid = np.concatenate([self.packed, more]), np.concatenate([self.valid, more])
        self.packed[n], self.valid[n] = packed, valid
        self.docs.append(doc)
        self.prints.append(print_)
        if group == len(self.firsts):
            self.firsts.append(n)
        self.group.append(group)

    def alike(self, print_: Print, packed: np.ndarray, valid: np.ndarray, some: np.ndarray, similarity: float) -> Iterator[tuple[int, float]]:
        """Those of `some` that are alike, with their likeness. Most are passed over by the bits of whole octaves."""
        both = self.valid[some] & valid
        differ = np.bitwise_count((self.packed[some] ^ packed) & both).reshape(len(some), OCTAVES + 1, 2).sum(axis=2, dtype=np.int64)
        kept = np.bitwise_count(both).reshape(len(some), OCTAVES + 1, 2).sum(axis=2, dtype=np.int64)
        # differences in whole octaves alone tell more likeness than there is
        whole = kept == _KEPT
        longest = np.maximum(print_.end, np.array([self.prints[k].end for k in some.tolist()]))
        width = np.clip(longest[:, None] - _BEGIN, 0, _WIDTH)
        least = (width * whole * np.minimum(1, 2 * differ / _KEPT)).sum(axis=1)
        for k in some[1 - least / longest >= similarity - 1e-6].tolist():
            near = likeness(self.prints[k], print_)
            if near >= similarity:
                yield k, near

    def meet(self, doc: int, text: str, similarity: float) -> Iterator[tuple[int, int, float]]:
        print_ = Print.read(text)
        kept = len(print_.bits)
        bits, there = np.zeros(_SLOTS, np.uint8), np.zeros(_SLOTS, np.uint8)
        bits[_SLOT[:kept]], there[_SLOT[:kept]] = print_.bits, 1
        packed, valid = (np.packbits(x).view(np.uint64) for x in (bits, there))
        joined: set[int] = set()
        if self.docs:
            for k, near in self.alike(print_, packed, valid, np.array(self.firsts), similarity):
                joined.add(self.group[k])
                yield doc, self.docs[k], near
            rest = np.array([k for k, g in enumerate(self.group) if g not in joined and self.firsts[g] != k], np.int64) if len(self.docs) > len(self.firsts) else []
            if len(rest):
                for k, near in self.alike(print_, packed, valid, rest, similarity):
                    if self.group[k] not in joined:
                        joined.add(self.group[k])
                        yield doc, self.docs[k], near
        into = min(joined, default=len(self.firsts))
        self.add(doc, print_, packed, valid, into)


#: Places of kept bits in rows of 128 for each octave, steps kept of each octave, its steps and the first of them.
_SLOTS = 128 * (OCTAVES + 1)
_KEPT = np.bincount(_OCTAVE)
_SLOT = 128 * _OCTAVE + np.arange(len(_STEPS)) - np.searchsorted(_OCTAVE, _OCTAVE)
_WIDTH = np.append(1, 1 << np.arange(OCTAVES)).astype(np.float64)
_BEGIN = np.append(0, _WIDTH[1:])


#: Buckets of up to so many documents are held against each other pair by pair, all those of a batch at once.
SMALL = 32
#: The first kept step of each octave.
_FIRST = np.searchsorted(_OCTAVE, np.arange(OCTAVES + 1))


def _decoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fingerprints the numbers of steps and of kept bits, and the bits in rows that end in zeros."""
    parts = [t.partition(".") for t in texts]
    ends = np.array([int(p[0], 16) for p in parts], np.int64)
    kept = np.searchsorted(_STEPS, ends)
    data = [base64.b64decode(p[2]) for p in parts]
    most = max(map(len, data), default=0)
    packed = np.frombuffer(b"".join([d.ljust(most, b"\0") for d in data]), np.uint8).reshape(len(data), most)
    return ends, kept, np.unpackbits(packed, axis=1)[:, : int(kept.max(initial=0))]


def _likenesses(texts: list[str], a: np.ndarray, b: np.ndarray, least: float = 0) -> np.ndarray:
    """likeness() of the pairs a[k], b[k] of these fingerprints, but for rounding; 0 for those that the last two octaves alone show to be under `least`."""
    ends, kept, bits = _decoded(texts)
    octaves = int(_OCTAVE[bits.shape[1] - 1]) + 1
    rows = []
    for x in (bits, np.arange(bits.shape[1]) < kept[:, None]):
        slots = np.zeros((len(texts), 128 * octaves), np.uint8)
        slots[:, _SLOT[: bits.shape[1]]] = x
        rows.append(np.packbits(slots, axis=1).view(np.uint64))
    packed, valid = rows
    each = np.clip(kept[:, None] - _FIRST[:octaves], 0, _KEPT[:octaves])
    long, last = np.maximum(ends[a], ends[b]), _OCTAVE[np.maximum(kept[a], kept[b]) - 1]
    found = np.zeros(len(a))
    left = np.arange(len(a))
    if least > 0 and octaves > 1:
        x, y, two = a[:, None], b[:, None], np.maximum(last, 1)[:, None] + np.arange(-1, 1)
        words = np.repeat(2 * two, 2, axis=1) + np.array([0, 1, 0, 1])
        bits_differ = np.bitwise_count((packed[x, words] ^ packed[y, words]) & valid[x, words] & valid[y, words]).reshape(len(a), 2, 2).sum(axis=2, dtype=np.int64)
        share = (2 * bits_differ + np.abs(each[x, two] - each[y, two])) / np.maximum(1, np.maximum(each[x, two], each[y, two]))
        widths = np.stack([_WIDTH[np.maximum(last, 1) - 1], long - _BEGIN[np.maximum(last, 1)]], axis=1)
        left = np.flatnonzero((last < 1) | (1 - (widths * np.minimum(1, share)).sum(axis=1) / long >= least - 1e-9))
        a, b, long, last = a[left], b[left], long[left], last[left]
    differ = 2 * np.bitwise_count((packed[a] ^ packed[b]) & valid[a] & valid[b]).reshape(len(a), octaves, 2).sum(axis=2, dtype=np.int64) + np.abs(each[a] - each[b])
    width = np.tile(_WIDTH[:octaves], (len(a), 1))
    width[np.arange(len(a)), last] = long - _BEGIN[last]
    found[left] = np.clip(1 - (width * np.minimum(1, differ / np.maximum(1, np.maximum(each[a], each[b])))).sum(axis=1) / long, 0, 1)
    return found


def _small(docs: list[int], texts: list[str], sizes: list[int], similarity: float) -> Iterator[tuple[int, int, float]]:
    """What _Bucket.meet() gives for the documents of small buckets, which lie end to end."""
    starts = np.cumsum([0, *sizes[:-1]])
    pairs = {n: np.triu_indices(n, 1) for n in set(sizes)}
    a, b = (np.concatenate([at + pairs[n][side] for at, n in zip(starts.tolist(), sizes, strict=True)]) for side in (0, 1))
    near: dict[tuple[int, int], float] = {}
    for k in np.flatnonzero(_likenesses(texts, a, b, similarity) >= similarity - 1e-9).tolist():
        i, j = int(a[k]), int(b[k])
        if (found := likeness(Print.read(texts[i]), Print.read(texts[j]))) >= similarity:
            near[i, j] = found
    if not near:
        return
    some = np.unique(np.searchsorted(starts, [i for i, _ in near], "right") - 1)
    for at, n in ((int(starts[x]), sizes[x]) for x in some.tolist()):
        group: list[int] = []
        firsts: list[int] = []
        for j in range(at, at + n):
            joined: set[int] = set()
            # the first one of each group, then the others of groups whose first one it isn't like
            for k in [*firsts, *(k for k in range(at, j) if firsts[group[k - at]] != k)]:
                if group[k - at] not in joined and (k, j) in near:
                    joined.add(group[k - at])
                    yield docs[j], docs[k], near[k, j]
            group.append(min(joined, default=len(firsts)))
            if group[-1] == len(firsts):
                firsts.append(j)


def _buckets(texts: list[str], picks: dict[int, list[np.ndarray]], orders: list[np.ndarray], short: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each fingerprint, as 64 bits of hash: which fingerprint, and the bucket."""
    ends, kept, bits = _decoded(texts)
    which, names = [], []
    for k in np.flatnonzero(ends < SHORT).tolist():
        for n, c in enumerate(orders):
            name = f"{salt}.{ends[k]:x}.{n}.".encode() + bits[k][c[c < kept[k]][:short]].tobytes()
            which.append(np.array([k]))
            names.append(np.frombuffer(hashlib.blake2b(name, digest_size=8).digest(), np.uint64))
    for o, choices in picks.items():
        some = np.flatnonzero(ends >= 1 << o)
        for n, c in enumerate(choices if len(some) else []):
            # 128 bits at most, as two numbers
            rows = np.zeros((len(some), 16), np.uint8)
            cut = np.packbits(bits[np.ix_(some, c)], axis=1)
            rows[:, : cut.shape[1]] = cut
            low, high = rows.view(np.uint64).T
            band = mixed(np.array([(salt * OCTAVES + o) * BANDS + n + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            names.append(mixed(mixed(low ^ band) + mixed(high + np.uint64(1))))
            which.append(some)
    return (np.concatenate(which), np.concatenate(names).view(np.int64)) if which else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _near_by(docs: DataFrame, similarity: float, walks: int) -> DataFrame:
    every = stored(walked(docs, walks).where("fingerprint <> '0.'"), "prints")
    first = every.groupBy("walk", "fingerprint").agg(F.min("doc_id").alias("first"))
    begins = np.searchsorted(_OCTAVE, np.arange(8, OCTAVES))
    chosen: dict[int, tuple] = {}
    for r in first.groupBy("walk").count().collect():
        log = int(r["count"]).bit_length()
        size, short = min(SAMPLES, max(BAND_BITS, log + 2)), max(0, log - SHORT_LOG)
        choice = np.random.default_rng(5)
        picks = {o + 8: [np.sort(choice.choice(SAMPLES, size, replace=False)) + b for _ in range(BANDS)] for o, b in enumerate(begins.tolist())}
        chosen[r["walk"]] = picks, [choice.permutation(SHORT) for _ in range(BANDS if short else 1)], short

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
                walk_of = batch.column(0).to_numpy()
                for k in np.unique(walk_of).tolist():
                    own = batch.take(pa.array(np.flatnonzero(walk_of == k)))
                    picks, orders, short = chosen[k]
                    which, names = _buckets(own.column(1).to_pylist(), picks, orders, short, k)
                    at = pa.array(which)
                    yield pa.RecordBatch.from_arrays([pa.array(names), own.column(2).take(at), own.column(1).take(at)], names=["bucket", "doc", "print"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, alone = None, _Bucket(), None
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            names = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(names)))
            # buckets that may go on before or behind this batch, and large ones, are met one by one; of those with one document nobody needs the bits
            little = (sizes > 1) & (sizes <= SMALL) & (starts > 0) & (starts + sizes < len(names))
            step = np.repeat(little, sizes)
            single = np.repeat((sizes == 1) & (starts > 0) & (starts + sizes < len(names)), sizes)
            for part in np.array_split(np.flatnonzero(little), max(1, int(step.sum()) // 2000)):
                if len(part):
                    rows = pa.array(ragged(starts[part], sizes[part]))
                    out += _small(batch.column(1).take(rows).to_pylist(), batch.column(2).take(rows).to_pylist(), sizes[part].tolist(), similarity)
            rest = batch.filter(pa.array(~(step | single)))
            for name, doc, text in zip(*(c.to_pylist() for c in rest.columns), strict=True):
                if name != bucket:
                    bucket, held, alone = name, _Bucket(), (doc, text)
                    continue
                if alone:
                    out += held.meet(*alone, similarity)
                    alone = None
                out += held.meet(doc, text, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "copy_of", "near"])

    found = first.select("walk", "fingerprint", "first").mapInArrow(bands, "bucket long, doc long, print string")
    pairs = found.repartition("bucket").sortWithinPartitions("bucket", "doc").mapInArrow(verified, "doc_id long, copy_of long, near double")
    same = every.join(first, ["walk", "fingerprint"]).where(F.col("doc_id") != F.col("first")).select("doc_id", F.col("first").alias("copy_of"), F.lit(1.0).alias("near"))
    return pairs.unionByName(same)


_OUT = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_with_next(docs: DataFrame, share: int = 4) -> DataFrame:
    """Each document with its fingerprint, that of its edited text, and likenesses.

    The edited text has the last floor(n/share) code points replaced by the first as many (or all) of the next
    document in ascending doc_id (null first; those of one id by a hash of the text); after the last comes the first. Columns:
    doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as
    empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = texts_of(docs).select(F.col("doc_id").isNotNull().alias("there"), F.coalesce("doc_id", F.lit(0)).alias("key"), F.xxhash64("text").alias("hash"), "text")
    # the first place of each range: one row for each range, of which there are some for each task, as they are dealt by hash
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct("there", "key", "hash")
    ranges = rows.select("there", "key", "hash").repartitionByRange(n, "there", "key", "hash").groupBy(F.spark_partition_id().alias("p")).agg(F.min(place).alias("place"))
    heads = [np.array(c, np.int64) for c in zip(*sorted(tuple(r["place"]) for r in ranges.collect()), strict=True)] or [np.zeros(0, np.int64)] * 3
    shared = spark.sparkContext.broadcast(heads)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document in its range, and those at a range's first place once more at the end of the range before."""
        heads = shared.value
        m = len(heads[0])
        for batch in batches:
            own = [batch.column(k).cast(pa.int64()).to_numpy() for k in range(3)]
            place, first = _ranges(heads, own)
            ghost = np.flatnonzero(first)
            which = np.concatenate([np.arange(len(place)), ghost])
            ranges = np.concatenate([place, (place[ghost] - 1) % max(1, m)])
            columns = [batch.column(k).take(pa.array(which)) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), pa.array(np.arange(len(which)) >= len(place)), *columns], names=["range", "ghost", "there", "key", "hash", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row so far, for which the next is needed
        for batch in slices(batches, "text", SLICE):
            place, ghost, there, key, _, text = (c.to_pylist() for c in batch.columns)
            key = [k if t else None for k, t in zip(key, there, strict=True)]
            if held:
                place, ghost, key, text = ([h, *c] for h, c in zip(held, (place, ghost, key, text), strict=True))
            held = (place[-1], ghost[-1], key[-1], text[-1])
            own = [k for k in range(len(key) - 1) if not ghost[k]]  # in one range and not the last, as each range ends with ghosts
            if not own:
                continue
            found, walks = prints(text)
            kept = [len(text[k]) - len(text[k]) // share for k in own]
            tails = [text[k + 1][: len(text[k]) // share] for k in own]
            after = edited_prints([walks[k] for k in own], kept, tails)
            names = [x.partition(" ")[0] for x in _OUT.split(", ")]
            columns = [
                pa.array([key[k] for k in own], pa.int64()), pa.array([len(text[k]) for k in own], pa.int64()),
                pa.array([text[k][:n] + t for k, n, t in zip(own, kept, tails, strict=True)], pa.string()),
                pa.array([found[k].text() for k in own], pa.string()), pa.array([p.text() for p in after], pa.string()),
                pa.array([likeness(found[k], p) for k, p in zip(own, after, strict=True)], pa.float64()), pa.array([likeness(found[k], found[k + 1]) for k in own], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    dealt = rows.mapInArrow(deal, "range int, ghost boolean, there boolean, key long, hash long, text string")
    return dealt.repartition("range").sortWithinPartitions("range", "ghost", "there", "key", "hash", "text").mapInArrow(run, _OUT)


def _ranges(heads: list[np.ndarray], own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of places (three numbers each) the range, by the ranges' first places, and whether it is such a first place."""
    m = len(heads[0])
    every = [np.concatenate(pair) for pair in zip(heads, own, strict=True)]
    order = np.lexsort((np.arange(m + len(own[0])) >= m, *every[::-1]))  # of equal ones the head comes first
    before = np.cumsum(order < m)
    found = np.zeros(m + len(own[0]), np.int64)
    found[order] = before
    place = np.maximum(0, found[m:] - 1)
    first = np.logical_and.reduce([h[place] == c for h, c in zip(heads, own, strict=True)]) if m else np.zeros(len(own[0]), bool)
    return place, first
