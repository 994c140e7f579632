"""Queries over the test tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import benchmark, edit_embedding, ngram_join, packing, quality, rollups, sentence_spans, suffix_dedup, token_store, url_rules
from tidemark.llm.shared import fresh_path, stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(table(spark, sf_dir, "documents"), length=200, keep="none")
    spans = F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans"))
    digests = cut.select("doc_id", "n_bytes", "n_removed", spans.cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    # rows of 100 bytes, which would make a file for each task that reads texts
    return digests.hint("rebalance", "doc_id")


OP1_SQL = r"""
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), p as (
  select doc_id, h, unnest(range(len(h) // 2 - 199)) as p from d where len(h) >= 400
), s as (
  select doc_id, p, md5(substr(h, 2 * p + 1, 400)) as m from p
), many as (
  select m from s group by m having count(*) > 1
), starts as (
  select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 200 then 0 else 1 end as new from s where m in (select m from many)
), numbered as (
  select doc_id, p, sum(new) over (partition by doc_id order by p) as span from starts
), spans as (
  select doc_id, span, min(p) as a, max(p) + 200 as b from numbered group by doc_id, span
), gaps as (
  select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as done from spans
), kept as (
  select g.doc_id, cast(sum(g.b - g.a) as bigint) as n_removed, count(*) as n_spans, string_agg(substr(d.h, cast(2 * g.done + 1 as bigint), cast(2 * (g.a - g.done) as bigint)), '' order by g.a) as front, max(g.b) as tail
  from gaps as g join d on d.doc_id = g.doc_id group by g.doc_id
)
select d.doc_id, cast(len(d.h) // 2 as bigint) as n_bytes, coalesce(k.n_removed, 0) as n_removed, coalesce(k.n_spans, 0) as n_spans,
       sha256(unhex(case when k.doc_id is null then d.h else k.front || substr(d.h, cast(2 * k.tail + 1 as bigint)) end)) as kept_sha256
from d left join kept as k on k.doc_id = d.doc_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two tokenizers; the second one's counts are revised; documents under 20 words are deleted; batches come twice."""
    counts = table(spark, sf_dir, "documents").select(
        "source", "lang", *[rollups.count_matches(F.col("text"), p).alias(n) for n, p in (("space", "[^ \\t\\n\\x0B\\f\\r]+"), ("runs", "[A-Za-z]+"), ("words", "[A-Za-z]{2,}"))]
    )
    counts = stored(counts, "counts")
    now = lambda name, tokens: [F.col("source"), F.col("lang"), F.lit(name).alias("tokenizer"), F.col(tokens).alias("tokens")]
    old = lambda name, tokens: [F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit(name).alias("old_tokenizer"), F.col(tokens).alias("old_tokens")]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("old_source", "string"), ("old_lang", "string"), ("old_tokenizer", "string"), ("old_tokens", "long"))]
    change = lambda op, rows, *columns: rows.select(F.lit(op).alias("op"), *columns)
    short = counts.where("space < 20")
    batches = {
        "load space": change("insert", counts, *now("space/1", "space"), *none),
        "load letters": change("insert", counts, *now("letters/1", "runs"), *none),
        "revise letters": change("revise", counts, *now("letters/1", "words"), *old("letters/1", "runs")),
        "drop short": change("delete", short, *now("space/1", "space"), *none).unionAll(change("delete", short, *now("letters/1", "words"), *none)),
    }
    store = rollups.Rollups(spark, fresh_path(spark, "rollups"))
    for _ in range(2):
        for name, changes in batches.items():
            store.apply(name, changes)
    store.compact()
    return store.totals()


OP2_SQL = """
with c as (
  select source, lang, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) as space,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{2,}')) as words from documents
)
select source, lang, 'space/1' as tokenizer, cast(count(*) as bigint) as documents, cast(sum(space) as bigint) as tokens
from c where space >= 20 group by source, lang
union all
select source, lang, 'letters/1', cast(count(*) as bigint), cast(sum(words) as bigint) from c where space >= 20 group by source, lang
"""


def token_counts_by_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2_token_counts, by a public tokenizer's ids: all documents come in, each language but one is revised to have end ids, too; batches come twice."""
    docs = table(spark, sf_dir, "documents").select("text", "source", "lang")
    counts = stored(rollups.count_tokens(docs, TOKENIZER, "source", "lang"), "counts")
    name = F.lit("word_bpe_49k/1")
    new = [F.col("source"), F.col("lang"), name.alias("tokenizer")]
    old = [F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), name.alias("old_tokenizer"), F.col("tokens").alias("old_tokens")]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("old_source", "string"), ("old_lang", "string"), ("old_tokenizer", "string"), ("old_tokens", "long"))]
    batches = {
        "load": counts.select(F.lit("insert").alias("op"), *new, "tokens", *none),
        "with ends": counts.where("lang <> 'en'").select(F.lit("revise").alias("op"), *new, (F.col("tokens") + 1).alias("tokens"), *old),
    }
    store = rollups.Rollups(spark, fresh_path(spark, "rollups"))
    for _ in range(2):
        for batch, changes in batches.items():
            store.apply(batch, changes)
    return store.totals()


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    n_hit, n_words = F.col("n_hit"), F.col("n_words")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
    )


OP4_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bk as (
  select item_id, w, unnest(range(greatest(1, len(w) - 12))) as k from b where len(w) > 0
), windows as (
  select distinct item_id, array_to_string(w[k + 1 : k + 13], ' ') as win, len(w[k + 1 : k + 13]) as size from bk
), sizes as (
  select distinct size from windows
), dk as (
  select doc_id, w, size, unnest(range(len(w) - size + 1)) as k from d cross join sizes where len(w) >= size
), dw as (
  select doc_id, k, size, array_to_string(w[k + 1 : k + size], ' ') as win from dk
), found as (
  select dw.doc_id, dw.k, dw.size, windows.item_id from dw join windows on dw.win = windows.win and dw.size = windows.size
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + size)) as p from found) as x group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, cast(item_id as varchar) as item from found) as y group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(hit.n_hit, 0) as n_hit, coalesce(items.n_items, 0) as n_items, sha256(coalesce(items.names, '')) as items_sha256,
       coalesce(hit.n_hit, 0) > 0 and 20 * coalesce(hit.n_hit, 0) >= len(d.w) as contaminated
from d left join hit on hit.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_rules.RULES)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
with u as (
  select page_id, case when url is null then '' else url end as url, strpos(coalesce(url, ''), '://') as pos from pages
), parts as (
  select page_id, case when pos = 0 then '' else regexp_extract(substr(url, pos + 3), '^[^/?#]*') end as raw_host,
         case when pos = 0 then '' else substr(url, pos + 3) end as rest from u
), p as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from parts
), r(rhost, rpath, rverdict) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fit as (
  select p.page_id, p.host, p.path, r.rhost || r.rpath as rule, r.rverdict,
         row_number() over (partition by p.page_id order by length(r.rhost || r.rpath) desc nulls last) as k
  from p left join r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)
)
select page_id, host, path, rule, coalesce(rverdict, 'allow') as verdict from fit where k = 1
"""


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edit_embedding.edited_with_next(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def near_copies_by_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of that method, banding and verification, over all documents."""
    return edit_embedding.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sentence_spans.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", "text", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"), size=3, percent=90)


OP8_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), k as (
  select doc_id, w, unnest(range(greatest(1, len(w) - 2))) as k from d where len(w) > 0
), g as (
  select distinct doc_id, array_to_string(w[k + 1 : k + 3], ' ') as s from k
), n as (
  select doc_id, count(*) as n from g group by doc_id
), pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from g as a join g as b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
  select x, y from pairs join n as nx on nx.doc_id = pairs.x join n as ny on ny.doc_id = pairs.y where 100 * c >= 90 * (nx.n + ny.n - c)
), both_ways as (
  select x, y from links union all select y as x, x as y from links
), reach(doc_id, other) as (
  select doc_id, doc_id as other from d union select r.doc_id, l.y as other from reach as r join both_ways as l on l.x = r.other
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id
from d left join n on n.doc_id = d.doc_id join (select doc_id, min(other) as component_id from reach group by doc_id) as m on m.doc_id = d.doc_id
"""


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_store.digests(spark, path)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontamination": op4_decontamination,
    "op5_url_filters": op5_url_filters,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_token_store": op9_token_store,
    "op10_packing": op10_packing,
    "token_counts_by_tokenizer": token_counts_by_tokenizer,
    "near_copies_by_edits": near_copies_by_edits,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": OP1_SQL,
    "op2_token_counts": OP2_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_url_filters": OP5_SQL,
    "op8_ngram_jaccard_join": OP8_SQL,
}
