"""Connected components of links: by alternating large and small stars, or in one task where they are few."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, stored


#: Up to this many links (16 bytes each) are solved in one task.
FEW = 400_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    over: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := over.setdefault(x, x)) != x:
            over[x] = over[y]
            x = over[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            if u != v:
                over[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(list(over), pa.int64()), pa.array([top(x) for x in over], pa.int64())], names=["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """links a, b (longs) to node, label: the smallest node of each one's component. Loops and nulls are ignored.

    The result is stored, and whether it is broadcast is left to Spark. Over FEW links, each round of stars is written to the shared folder; rounds grow with the logarithm of a
    component's width.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "edges")
    few = edges.count() <= FEW
    return stored(edges.repartition(1).mapInArrow(_united, "node long, label long") if few else _stars(edges), "labels")


def _stars(edges: DataFrame) -> DataFrame:
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        least = stored(least, "least")  # on its own, so that Spark may split the rows of a hub in the join
        large = both.join(least, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        low = stored(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")), "low")
        # each node keeps its least neighbour; its other neighbours are handed to that one
        small = large.join(low, F.col("u") == F.col("x")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = stored(small.where("u <> v").distinct(), "edges")
        mark = [x.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first() for x in (edges, after)]
        discard(edges, least, large, low)
        edges = after
        if mark[0] == mark[1]:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionAll(nodes.select(F.col("label").alias("node"), "label").distinct())
