import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.shared import slices, text_bytes


def clean(rng):
    return " ".join(rng.choice(["the", "of", "river", "stone", "walks", "slowly", "evening"]) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(5, 300)))


def spoiled(rng):
    """Clean text with one bad passage somewhere."""
    bad = " ".join(rng.choice(["buy", "now", "win"]) + rng.choice(["!!", "$$", "%%"]) for _ in range(60))
    w = clean(rng).split(" ")
    k = rng.randrange(len(w))
    return " ".join([*w[:k], bad, *w[k:]])


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows = [(k, spoiled(rng) if k % 3 == 0 else clean(rng), int(k % 3 != 0)) for k in range(700)]
    docs = spark.createDataFrame([(k, t, "x", 0.5) for k, t, _ in rows] + [(9000, None, "x", 0.5), (9001, "", "x", 0.5), (None, "some text", "x", 0.5), (1, rows[1][1], "x", 0.5), (9002, "z" * 100_000, "x", 0.5)], "doc_id long, text string, y string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (9000, None), (3, 1)], "doc_id long, quality int")
    return docs, labels, {k: y for k, _, y in rows}


def test_held_out_accuracy(tables):
    docs, labels, truth = tables
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).withColumn("held_out", quality.held_out(F.col("doc_id"))).collect()
    assert len(rows) == 705 and all(0 <= r.score <= 1 for r in rows) and rows[0].y == "x"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    out = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(out) > 80 and np.mean([(s >= 0.5) == y for s, y in out]) > 0.95
    empty = [r.score for r in rows if r.doc_id in (9000, 9001)]
    assert empty[0] == empty[1]


def test_attention_goes_to_the_bad_passage(tables):
    docs, labels, _ = tables
    model = quality.fit(docs, labels)
    text = " ".join([" ".join(["river"] * 2 + ["the", "stone"] * 23)] * 3) + " " + " ".join(["win!!", "buy%%"] * 24)
    raw = np.frombuffer(text.encode(), np.uint8)
    x, _ = quality.features(raw, np.array([0, len(raw)]))
    f = model.forward((x - model.mean) / model.scale, np.array([0]), np.array([len(x)]))
    assert abs(f["attention"].sum() - 1) < 1e-6 and len(x) == 4


def test_gradients(monkeypatch):
    """One plain step lowers the loss on its batch."""
    rng = np.random.default_rng(2)
    x, sizes = rng.normal(size=(60, 8)).astype(np.float32), np.full(20, 3)
    y = (x.reshape(20, 3, 8)[:, :, 0].max(axis=1) > 0.8).astype(float)
    loss = lambda m: -np.mean(np.log(np.where(y == 1, (p := m.forward((x - m.mean) / m.scale, np.arange(0, 60, 3), sizes)["p"]), 1 - p)))
    assert loss(quality.train(x, sizes, y, epochs=80)) < 0.5 * loss(quality.train(x, sizes, y, epochs=1, rate=0.0))


def test_without_labels_or_with_one_kind(spark, tables):
    docs, labels, _ = tables
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    good = quality.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score(docs, good).collect()} == {0.99}
    assert quality.score(docs.limit(0), none).count() == 0


def test_every_text_has_a_passage():
    data = np.frombuffer("a b  c".encode(), np.uint8)
    x, text = quality.features(data, np.array([0, 0, 5, 6, 6]))
    assert text.tolist() == [0, 1, 2, 3] and x.shape == (4, quality.WIDTH)
    x, text = quality.features(np.zeros(0, np.uint8), np.array([0, 0]))
    assert text.tolist() == [0] and not x.any()


def features_by_force(text):
    """One text's features, passage by passage, byte by byte."""
    raw = text.encode()
    kind = [int(quality._CLASS[b]) for b in raw]
    found = [(m.start(), m.group()) for m in re.finditer(rb"[^ \t\r\x0b\x0c\n]+", raw)]
    parts = [found[k : k + quality.PASSAGE] for k in range(0, len(found), quality.PASSAGE)] or [[]]
    begin = [0] + [p[0][0] for p in parts[1:]] + [len(raw)]
    rows = []
    for k, part in enumerate(parts):
        pairs = np.zeros(256)
        for j in range(max(1, begin[k]), begin[k + 1]):
            pairs[kind[j - 1] * 16 + kind[j]] += 1
        place, n = k * quality.PASSAGE, max(1, len(part))
        words = [w for _, w in found]
        logs = [np.log1p(len(w)) for _, w in part]
        mean = sum(logs) / n
        own = range(place, place + len(part))
        share = lambda test: sum(map(bool, map(test, own))) / n
        more = [
            np.log1p(len(part)), mean, np.sqrt(max(0, sum(x * x for x in logs) / n - mean**2)), share(lambda i: len(words[i]) > 14), share(lambda i: i >= 1 and words[i] == words[i - 1]),
            share(lambda i: i >= 2 and words[i] == words[i - 2]), share(lambda i: words[i] in words[place:i]), share(lambda i: words[i] in words[:i]), np.log1p(len(found)),
        ]
        rows.append([*np.sqrt(pairs / max(1, pairs.sum())), *more])
    return np.array(rows)


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_features_and_scores_are_of_the_text_alone(tables):
    docs, labels, _ = tables
    model = quality.fit(docs, labels)
    rng = random.Random(8)
    texts = ["short text", "  leads with blanks", "\n", "", "ends with blanks \n", "x", clean(rng), spoiled(rng), "Ünï " * 120, "a a a b " * 90, "one\n" * 49]
    alone = {t: model.score(*joined([t]))[0] for t in texts}
    for t in texts:
        assert np.allclose(quality.features(*joined([t]))[0], features_by_force(t), atol=1e-6), t
    for _ in range(6):
        some = [rng.choice(texts) for _ in range(30)]
        x, of = quality.features(*joined(some))
        assert all(np.array_equal(x[of == k], quality.features(*joined([t]))[0]) for k, t in enumerate(some))
        assert model.score(*joined(some)).tolist() == [alone[t] for t in some]


def test_the_sample_passes_over_what_does_not_fit():
    sizes = [(1, 0, 90), (2, 1, 500), (3, 1, 5), (4, 0, 5), (5, 1, 20)]
    assert quality._within(sizes, 100) == [1, 3, 4]
    assert quality._within([(1, 0, 500), (2, 0, 400), (3, 1, 50)], 100) == [3, 2]
    assert quality._within([], 100) == []


def test_a_text_over_the_bound_does_not_shut_out_others(spark, tables):
    docs, labels, truth = tables
    some = docs.where("doc_id in (1, 2, 3, 6, 9002) or doc_id between 10 and 60")
    more = labels.unionByName(spark.createDataFrame([(9002, 0)], "doc_id long, quality int"))
    assert quality.fit(some, more, most_bytes=60_000).weights


def test_scoring_takes_little_memory(tables):
    rng = random.Random(3)
    batch = pa.record_batch([pa.array([clean(rng) for _ in range(3000)])], names=["text"])
    assert batch.nbytes > 2 << 20
    docs, labels, _ = tables
    model = quality.fit(docs, labels)
    whole = model.score(*text_bytes(batch.column(0)))
    tracemalloc.start()
    parts = [model.score(*text_bytes(part.column(0))) for part in slices(iter([batch]), "text", quality.SLICE)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(np.concatenate(parts), whole)
    # two workers, their executor's heap and all else of it have to fit into its 3 GB
    assert peak < 32 << 20
