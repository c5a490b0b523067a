"""Connected components of a distributed edge list, and streaming over sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import discard, keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """node, component (its smallest node) for every node of the edges (a, b).

    Alternating large-star and small-star contraction: every round replaces the edges by ones to smaller nodes and
    writes them; it ends when a round changes nothing, after a number of rounds logarithmic in the longest path.
    A node with very many edges is reduced before the shuffle and joined under adaptive skew handling.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), label)
    before, state = None, _state(now)
    while state != before and state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .where("a <> b").distinct()
        large = keep(large, label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), label)
        discard(old, large)
        before, state = state, _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        start = 0
        for i, v in enumerate(values):
            if v != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, v
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
