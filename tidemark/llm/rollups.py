"""Token counts kept up to date by signed changes.

A store holds one delta for each batch of changes: sums of documents and tokens by source, language and
tokenizer version, signed. Totals are the sums of all live deltas, so no document is counted anew. A batch
is written first and committed by the next numbered file of a log, which appears whole or not at all; applying
it again, after a failure or twice at once, changes nothing. compact() folds deltas into one in the same log, and a
checkpoint of the log saves reading what came before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.shared import slices, small_batches
from tidemark.llm.tokens import encoder
from tidemark.plans.files import Files

#: Bytes of text that are encoded at once.
SLICE = 2 << 20

KEYS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, documents long, tokens long"
CHANGES = "op string, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokenizer string, old_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """changes (op, source, lang, tokenizer, tokens, old_...) as additive rows of SUMS.

    insert adds a document, delete takes it away (both by the columns without old_), revise takes the old one
    away and adds the new. Null keys are keys of their own; null tokens count 0. A null or unknown op raises when the
    rows are read.
    """
    known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown change "), F.coalesce("op", F.lit("null")))).cast("string"))
    row = lambda sign, old="": F.struct(*[F.col(old + c).cast("string").alias(c) for c in KEYS], F.lit(sign).cast("long").alias("documents"), (sign * F.coalesce(F.col(old + "tokens").cast("long"), F.lit(0))).alias("tokens"))
    rows = F.when(F.col("_op") == "insert", F.array(row(1))).when(F.col("_op") == "delete", F.array(row(-1))).otherwise(F.array(row(1), row(-1, "old_")))
    return changes.withColumn("_op", known).select(F.explode(rows).alias("x")).select("x.*")


def _sums(rows: DataFrame) -> DataFrame:
    # partial sums come before the shuffle, so a source with most rows sends one row from each task
    return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Rollups:
    """Use apply(), totals() and compact(); any number of writers may do so at once."""

    #: Commits after which apply() writes a checkpoint of the log.
    EVERY = 64

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.files = Files(spark, path)
        self.path = self.files.root
        self._seq, self._live, self._batches = 0, set(), set()

    def _read(self) -> None:
        """Take in what was committed since the last call."""
        names = [n for n in self.files.names("log") if n[0] != "."]
        if not self._seq and (kept := [n for n in names if n.endswith(".checkpoint")]):
            told = json.loads(self.files.read(f"log/{kept[-1]}"))
            self._seq, self._live, self._batches = told["seq"], set(told["live"]), set(told["batches"])
        for name in names:
            if name.endswith(".json") and int(name[:20]) > self._seq:
                told = json.loads(self.files.read(f"log/{name}"))
                self._live = (self._live - set(told["replaces"])) | {told["folder"]}
                self._batches |= set(told["batches"])
                self._seq = int(name[:20])

    def _commit(self, folder: str, batch: str | None = None, replaces: frozenset[str] = frozenset()) -> bool:
        """Append to the log; False if the batch is in it, or what this replaces no longer is live."""
        while True:
            self._read()
            if batch in self._batches or not replaces <= self._live:
                return False
            told = {"folder": folder, "batches": [] if batch is None else [batch], "replaces": sorted(replaces)}
            if self.files.create(f"log/{self._seq + 1:020d}.json", json.dumps(told).encode()):
                self._read()
                return True

    def batches(self) -> set[str]:
        self._read()
        return set(self._batches)

    def _write(self, sums: DataFrame) -> str:
        folder = f"deltas/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{folder}")
        return folder

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False, and nothing done, if that batch was applied before. An empty batch counts as applied."""
        if batch in self.batches():
            return False
        folder = self._write(_sums(signed(changes)))
        done = self._commit(folder, batch)
        if not done:
            self.files.delete(folder)
        elif not self._seq % self.EVERY:
            self.checkpoint()
        return done

    def _sum(self, folders: set[str]) -> DataFrame:
        rows = self.spark.read.schema(SUMS).parquet(*[f"{self.path}/{f}" for f in sorted(folders)]) if folders else self.spark.createDataFrame([], SUMS)
        return _sums(rows).where("documents <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens of all committed batches; keys whose sums are all 0 are left out."""
        self._read()
        return self._sum(self._live)

    def compact(self) -> bool:
        """Fold all live deltas into one; batches stay known. Of two at once one has no effect, and returns False.

        Folded deltas stay on disk for readers of older totals, until vacuum().
        """
        self._read()
        live = frozenset(self._live)
        if len(live) < 2:
            return False
        folder = self._write(self._sum(set(live)))
        done = self._commit(folder, replaces=live)
        if not done:
            self.files.delete(folder)
        return done

    def checkpoint(self) -> None:
        """Write down the state of the log, so that a new opening reads that and what comes after."""
        self._read()
        if self._seq:
            told = {"seq": self._seq, "live": sorted(self._live), "batches": sorted(self._batches)}
            self.files.create(f"log/{self._seq:020d}.checkpoint", json.dumps(told).encode())

    def vacuum(self, before: int) -> int:
        """Delete deltas that aren't live and were written before a time (Unix milliseconds), as lost writers leave them; how many files."""
        self._read()
        gone = [n for n, _, written in self.files.walk("deltas") if "/".join(n.split("/")[:2]) not in self._live and written < before]
        for name in gone:
            self.files.delete(name)
        return len(gone)


def count_matches(text: Column, pattern: str) -> Column:
    """Tokens of a tokenizer that a pattern describes; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def count_tokens(docs: DataFrame, tokenizer: str, *columns: str) -> DataFrame:
    """columns of docs and tokens, the number of ids of each whole text by a tokenizer file; null texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in slices(batches, "_text", SLICE):
            _, lengths = encode(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lengths, pa.int64())], names=[*columns, "tokens"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_text"), *columns)
    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in columns), StructField("tokens", LongType())]))
