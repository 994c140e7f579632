"""The corpus pipeline: stages that each take what the one before kept.

quality drops documents that the classifier rejects; near_copies keeps one document of each group of near
copies; repeats cuts spans of sentences that other documents have, too; leaks drops documents that benchmark
items fill, and cuts what else of them occurs; packed makes sequences of token ids. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import benchmark, ngram_join, packing, quality, sentence_spans
from tidemark.llm.queries import TOKENIZER, table
from tidemark.llm.shared import folders_of, spare, stored, temporary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of 0.3 or more, with all columns; null and empty texts are scored, too. Without labels every score is 0.5."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "_score").where(F.col("_score") >= 0.3).drop("_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8), that with the smallest doc_id, null last; repeated rows are copies. Texts without words stay."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without spans of sentences that came before; n_chars follows. Documents of which nothing is left go; empty ones, nulls and repeated rows stay as they are."""
    name = "removed"
    while name in docs.columns:
        name += "_"
    cut = sentence_spans.dedup(docs, column=name)
    # documents of which nothing is left are dropped; those that were empty before stay
    return cut.where((F.size(name) == 0) | (F.trim("text") != "")).select(*docs.columns)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit less than a twentieth of the words, without those words. Null and empty texts have none and stay."""
    return benchmark.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens; null and empty texts are an end id, repeated rows documents of their own."""
    pieces = packing.pack(docs, TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("leaks", remove_leaks), ("packed", pack_sequences)]

#: Tokenisers, hashes of words and learned weights are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns, over all documents. A stage's tables are deleted once the next one's are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark) as made:
            kept = stored(stage(spark, docs, sf_dir), name)
            spare(made, kept)
            made += folders_of(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
