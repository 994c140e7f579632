"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, and only the document has a label. Each passage is encoded; gated attention
(tanh times sigmoid) gives it a weight among its document's passages; the weighted sum of the encodings is
classified. The weights are learned from the documents' labels alone, so that one bad passage can show.

A passage is PASSAGE words (the last one of a text has fewer). Its features are how often each pair of
neighbouring character classes occurs in it, and how its words repeat and are formed; nothing of them depends
on a language's vocabulary, nor on ids, sources or labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.shared import begin_task, mixed, slices, small_batches, text_bytes, texts_of

PASSAGE = 48
#: Bytes of text that are scored at once: features take up to a hundred times their memory.
SLICE = 1 << 18
#: Classes of bytes; what is in none of these has a class of its own.
_GROUPS = [b" \t\r\x0b\x0c", b"\n", b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"'\"-", b"()[]{}<>", b"|/\\", b"#$%&*@^~=+_", b":;", bytes(range(0x80, 0xC0))]
_CLASS = np.full(256, 15, np.uint8)
for _k, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _k
_PAIRS = 256
WIDTH = _PAIRS + 9


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages of texts (UTF-8 bytes, end to end) as rows of features, and the text of each. Every text has at least one."""
    n_texts = len(offsets) - 1
    kind = _CLASS[data]
    blank = kind <= 1
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~blank & (np.append(True, blank[:-1]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~blank & (np.append(blank[1:], True) | edge[1:])) + 1 if len(data) else starts
    owner = np.searchsorted(offsets, starts, "right") - 1
    before = np.searchsorted(starts, offsets[:-1])
    count = np.searchsorted(starts, offsets[1:]) - before
    passages = np.maximum(1, -(-count // PASSAGE))
    first_passage = np.cumsum(passages) - passages
    total = int(passages.sum())
    text_of = np.repeat(np.arange(n_texts), passages)
    out = np.zeros((total, WIDTH), np.float32)
    if not len(starts):
        return out, text_of
    place = np.arange(len(starts)) - before[owner]
    passage = first_passage[owner] + place // PASSAGE
    # each byte belongs to the passage of the last word that began before it in its text, or to the text's first one
    begin = np.repeat(offsets[:-1], passages)
    opens = np.append(True, passage[1:] != passage[:-1]) & (place > 0)
    begin[passage[opens]] = starts[opens]
    of_byte = np.repeat(np.arange(total, dtype=np.int64 if total * _PAIRS >> 31 else np.int32), np.diff(np.append(begin, len(data))))
    # and each pair to the passage of its second byte; none crosses from text to text
    second = 1 + np.flatnonzero(~edge[1 : len(data)])
    pairs = np.bincount(of_byte[second] * _PAIRS + (kind[second - 1] * 16 + kind[second]), minlength=total * _PAIRS).reshape(total, _PAIRS)
    size = np.maximum(1, pairs.sum(axis=1, keepdims=True))
    out[:, :_PAIRS] = np.sqrt(pairs / size)
    del of_byte, second, pairs
    # words: a rolling sum identifies each
    powers = np.full(len(data) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    inverse = np.full(len(data) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    word = mixed((sums[ends] - sums[starts]) * inverse[starts])
    length = (ends - starts).astype(np.float64)
    words = np.bincount(passage, minlength=total)
    some = np.maximum(1, words)
    per = lambda x: np.bincount(passage, x, minlength=total) / some
    twin = lambda k: np.concatenate([np.zeros(k, bool), (word[k:] == word[:-k]) & (owner[k:] == owner[:-k])]) if len(word) > k else np.zeros(len(word), bool)
    order = np.lexsort((word, passage))
    same = np.append(False, (word[order][1:] == word[order][:-1]) & (passage[order][1:] == passage[order][:-1]))
    repeats = np.bincount(passage[order][same], minlength=total)
    whole = np.lexsort((word, owner))
    seen = np.zeros(len(word), bool)
    seen[whole] = np.append(False, (word[whole][1:] == word[whole][:-1]) & (owner[whole][1:] == owner[whole][:-1]))
    mean = per(np.log1p(length))
    for k, x in enumerate([np.log1p(words), mean, np.sqrt(np.maximum(0, per(np.log1p(length) ** 2) - mean**2)), per(length > 14), per(twin(1)), per(twin(2)), repeats / some, per(seen), np.log1p(count)[text_of]]):
        out[:, _PAIRS + k] = x
    return out, text_of


@dataclass
class Model:
    """Weights by name, and the features' mean and scale. Without weights every document scores `prior`."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    prior: float = 0.5

    def forward(self, x: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        """x: rows of scaled passages; first, sizes: where each document's rows are."""
        w = self.weights
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        a, g = np.tanh(h @ w["attend"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (a * g) @ w["weigh"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        attention = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(attention[:, None] * h, first)
        logit = np.clip(z @ w["score"] + w["score_bias"], -30, 30)
        return {"h": h, "a": a, "g": g, "attention": attention, "z": z, "p": 1 / (1 + np.exp(-logit))}

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.weights or not n:
            return np.full(n, self.prior)
        x, text = features(data, offsets)
        sizes = np.bincount(text, minlength=n)
        # a product's last digits may depend on the rows beside it; in doubles, they are far behind the eighth place
        found = self.forward((x.astype(np.float64) - self.mean) / self.scale, np.cumsum(sizes) - sizes, sizes)["p"]
        return np.round(found, 8)


def train(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, *, width: int = 32, heads: int = 16, epochs: int = 24, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """x: passages of all documents in order; sizes: passages of each; y: 0 or 1 of each. Adam on the log loss."""
    if not len(y):
        return Model()
    if len(set(y.tolist())) < 2:
        return Model(prior=float(y[0]) * 0.98 + 0.01)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    x = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"encode": draw(x.shape[1], width), "encode_bias": np.zeros(width, np.float32), "attend": draw(width, heads), "gate": draw(width, heads), "weigh": draw(heads), "score": draw(width), "score_bias": np.zeros(1, np.float32)}
    model = Model(w, mean, scale)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    starts, turn = np.cumsum(sizes) - sizes, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            docs = order[k : k + batch]
            own = sizes[docs]
            rows = np.repeat(starts[docs] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            xs, first = x[rows], np.cumsum(own) - own
            f = model.forward(xs, first, own)
            d_logit = (f["p"] - y[docs]) / len(docs)
            d_z = np.repeat(d_logit[:, None] * w["score"], own, axis=0)
            d_attention = (f["h"] * d_z).sum(axis=1)
            d_e = f["attention"] * (d_attention - np.repeat(np.add.reduceat(f["attention"] * d_attention, first), own))
            d_ag = d_e[:, None] * w["weigh"]
            d_a, d_g = d_ag * f["g"] * (1 - f["a"] ** 2), d_ag * f["a"] * f["g"] * (1 - f["g"])
            d_h = (f["attention"][:, None] * d_z + d_a @ w["attend"].T + d_g @ w["gate"].T) * (1 - f["h"] ** 2)
            grads = {"encode": xs.T @ d_h, "encode_bias": d_h.sum(axis=0), "attend": f["h"].T @ d_a, "gate": f["h"].T @ d_g, "weigh": (f["a"] * f["g"]).T @ d_e, "score": f["z"].T @ d_logit, "score_bias": d_logit.sum(keepdims=True)}
            turn += 1
            step = rate * (1 - epoch / epochs)
            for name, g in grads.items():
                g = g + decay * w[name]
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[name] -= (step * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text, modulo 5, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _within(sizes: list[tuple[int, int, int]], most: int) -> list[int]:
    """Of documents (id, label, bytes) in order those that fit into `most` bytes, passing over any that doesn't; of a label of which none fits, the shortest."""
    taken, total = {}, 0
    for i, y, size in sizes:
        if total + size <= most:
            taken[i] = y
            total += size
    for y in {y for _, y, _ in sizes} - set(taken.values()):
        taken[min((size, i) for i, own, size in sizes if own == y)[1]] = y
    return list(taken)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 6000, most_bytes: int = 24 << 20) -> Model:
    """Learn from labelled documents that aren't held out.

    Of them at most `most_rows` and `most_bytes` of text are taken, in the order of a hash of doc_id; these two
    bound the sample, which comes to the driver as features of whole texts. A text that doesn't fit any more is
    passed over; of a label of which no text fits, the shortest is taken all the same. Rows of labels with null are
    ignored, as are documents with different labels. Repeated documents count as often as they are there.
    """
    spark = docs.sparkSession
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("z"))
    ids = one.where("y = z").select("id", "y").orderBy(F.xxhash64("id"), "id").limit(most_rows)
    chosen = spark.createDataFrame(ids.collect(), "id long, y int")  # most_rows at most, so it can be broadcast
    sizes = docs.select(F.col("doc_id").cast("long").alias("id"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    sizes = sizes.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.sum("size").alias("size")).orderBy(F.xxhash64("id"), "id").collect()
    chosen = chosen.where(F.col("id").isin(_within([tuple(r) for r in sizes], most_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in slices(batches, "text", SLICE):
            x, text = features(*text_bytes(batch.column(1)))
            counts = np.bincount(text, minlength=batch.num_rows)
            raw = [p.astype("<f2").tobytes() for p in np.split(x, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw, pa.binary())], names=["doc_id", "y", "x"])

    rows = texts_of(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, x binary").toArrow()
    found = sorted(zip(rows["doc_id"].to_pylist(), rows["y"].to_pylist(), rows["x"].to_pylist(), strict=True))
    parts = [np.frombuffer(x, "<f2").reshape(-1, WIDTH) for _, _, x in found]
    return train(np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, WIDTH), np.float32), np.array([len(p) for p in parts], np.int64), np.array([y for _, y, _ in found], np.float64))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All rows and columns of docs with the score of each whole text, 0 to 1; null and empty texts have one, too.

    A score is a function of the text alone: equal texts have equal ones, to eight places, wherever they stand.
    A column named like the score is replaced; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size that doesn't depend on the documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in slices(batches, "_text", SLICE):
            found = shared.value.score(*text_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.float64)), batch.column(1)], names=["_score", "_all"])

    small_batches(docs.sparkSession)
    docs = docs.drop(column)
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.struct("*").alias("_all"))
    scored = rows.mapInArrow(run, StructType.fromDDL("_score double").add("_all", rows.schema["_all"].dataType))
    return scored.select("_all.*", F.col("_score").alias(column))
