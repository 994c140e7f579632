"""The pipeline's stages on a small corpus, against what each must do."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import shared
from test_exact_operators import cut_by_force, groups_by_force
from tidemark.llm.queries import ORACLE_SQL, QUERIES, TOKENIZER
from tidemark.llm.shared import stored
from tidemark.llm.tokens import encoder


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(3)
    say = lambda n: (" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(n)) + ".").capitalize()
    prose = lambda n: " ".join(say(rng.randint(6, 12)) for _ in range(n))
    junk = lambda: " ".join(f"{rng.choice('abc')}{rng.randrange(10**5)}%%%" for _ in range(60))
    item, other = say(40), say(40)
    texts = {k: (prose(20), 1) for k in range(200)} | {k: (junk(), 0) for k in range(200, 300)}
    passage = prose(8)
    texts[400] = (texts[7][0] + " more", 1)
    texts[401] = (texts[7][0], 1)
    texts[402] = (prose(10) + "\n" + passage + "\n" + prose(10), 1)
    texts[403] = (prose(10) + "\n" + passage + "\n" + prose(10), 1)
    texts[404] = (say(5) + " " + item, 1)
    texts[405] = (prose(200) + " " + other + " " + prose(200), 1)
    rows = [(k, t, "en", "s", len(t)) for k, (t, _) in texts.items()] + [(500, None, None, None, None), (501, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, y, 0) for k, (_, y) in texts.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, other)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, passage, other


def test_stages(spark, corpus):
    folder, texts, passage, other = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert {k for k in texts if k not in kept["quality"]} == set(range(200, 300))
    assert kept["quality"].keys() - kept["near_copies"].keys() == {400, 401}
    changed = {k for k, t in kept["repeats"].items() if t != kept["near_copies"][k]}
    assert changed == {403} and passage in kept["repeats"][402] and passage not in kept["repeats"][403]
    assert kept["repeats"].keys() - kept["leaks"].keys() == {404}
    assert other not in kept["leaks"][405] and len(kept["leaks"][405]) > 3000
    clean = set(range(200)) - {7}
    assert all(kept["leaks"][k] == texts[k][0] for k in clean)
    name, stage = corpus_pipeline.STAGES[-1]
    ids = {k: np.array(encoder(TOKENIZER).tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for k, t in kept["leaks"].items()}
    tokens = 0
    for r in stage(spark, docs, folder).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        tokens += r.length
    assert tokens == sum(map(len, ids.values()))
    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == set(kept["leaks"])


def stages_by_force(docs, items):
    """What near_copies, repeats and leaks make of documents (id, text), by ascending id, in plain Python."""
    _, firsts = zip(*groups_by_force([t for _, t in docs], 5, 80)[0], strict=True)
    docs = [d for k, d in enumerate(docs) if firsts[k] == k]
    near = dict(docs)
    cut = cut_by_force([t for _, t in docs])
    docs = [(i, after) for (i, before), after in zip(docs, cut, strict=True) if before == after or after.strip(" ")]
    repeats = dict(docs)
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: [(m.start(), m.end(), m.group().lower()) for m in word.finditer(t.encode())]
    windows = {tuple(w for _, _, w in split(t)[k : k + 13]) for t in items for k in range(max(1, len(split(t)) - 12))}
    leaks = {}
    for i, text in docs:
        found = split(text or "")
        hit = {p for size in {len(w) for w in windows} for k in range(len(found) - size + 1) if tuple(w for _, _, w in found[k : k + size]) in windows for p in range(k, k + size)}
        if hit and 20 * len(hit) >= len(found):
            continue
        gone = {b for p in hit for b in range(found[p][0], found[p + 1][0] if p + 1 in hit else found[p][1])}
        leaks[i] = text if text is None else bytes(b for k, b in enumerate(text.encode()) if k not in gone).decode()
    return near, repeats, leaks


def test_stages_by_force(spark, tmp_path):
    rng = random.Random(31)
    say = lambda n: " ".join(rng.choice(["", "", "Ä"]) + f"w{rng.randrange(3000)}" + rng.choice(["", "", "", "", ".", ",", "\n"]) for _ in range(n))
    items, passages = [say(30) for _ in range(4)], [say(45) for _ in range(5)]
    texts = []
    for k in range(90):
        parts = [say(rng.choice([5, 40, 500])), rng.choice(passages) if k % 3 == 0 else say(9), rng.choice(items) if k % 5 == 0 else say(9), say(rng.choice([3, 300]))]
        texts.append("\n".join(parts))
    for k in range(12):  # near and exact copies, and texts that are all passage
        w = texts[k].split(" ")
        w[len(w) // 2] = "other"
        texts += [" ".join(w), texts[k + 20], passages[k % 5]]
    docs = list(enumerate([*texts, None, "", " "]))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for k, expect in enumerate(stages_by_force(docs, items)):
        name, stage = corpus_pipeline.STAGES[k + 1]
        table = stored(stage(spark, table, str(tmp_path)), name)
        got = table.collect()
        assert {r.doc_id: r.text for r in got} == expect and len(got) == len(expect), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_queries_cover_the_ten_operators():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _all string, row long, _goes boolean, removed string"


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_stages_of_odd_tables(spark, tmp_path, kind):
    """No rows at all; or nulls, empties, repeated rows and shared ids, with columns named like inner ones."""
    odd = [(None, None), (None, ""), (None, "a b"), (None, "a b"), (1, "text " * 400), (1, "text " * 400), (1, "other"), (2, None), (3, "\n \n"), (4, "é" * 5000)]
    rows = [] if kind == "empty" else [(i, t, None, "s", None, "x", 5, True, "r") for i, t in odd]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}")
    kept = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    texts = [t for _, t in kept]
    if kind == "empty":
        assert kept == [] and corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    else:
        # one of each repeated row; of a text that repeats itself its first span
        assert texts.count(None) == 2 and texts.count("a b") == 1 and texts.count("other") == 1 and texts.count("") == 1
        assert len(kept) == 8 and all(r._all == "x" and r.row == 5 and r.removed == "r" for r in docs.collect())


def test_runs_leave_nothing_behind_but_what_they_return(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.count() > 0 and len([p for p in tmp_path.iterdir() if p.name.startswith("tidemark-")]) == 1
