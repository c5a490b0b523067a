"""Runs of consecutive readings as a monoid, so that a long series is folded piece by piece.

A piece is (prefix, best, suffix, n): the length of the run it starts with, its longest run, the run it ends with and
its readings.  Two neighbouring pieces make one of the same shape, and a piece that is one run has prefix == n.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tripweave.operators.ordered import chunk_by_sequence

CHUNK_ROWS = 16_384


def _piece(prefix, best, suffix, n) -> Column:
    return F.struct(*[c.cast("bigint").alias(k) for k, c in
                      (("prefix", prefix), ("best", best), ("suffix", suffix), ("n", n))])


def no_readings() -> Column:
    return _piece(*[F.lit(0)] * 4)


def run_piece(flags: Column) -> Column:
    """The piece of an array of flags, in order; a null flag breaks a run."""
    def step(acc: Column, flag: Column) -> Column:
        on = F.coalesce(flag, F.lit(False))
        suffix = F.when(on, acc["suffix"] + 1).otherwise(0)
        prefix = acc["prefix"] + F.when(on & (acc["prefix"] == acc["n"]), 1).otherwise(0)
        return _piece(prefix, F.greatest(acc["best"], suffix), suffix, acc["n"] + 1)

    return F.aggregate(flags, no_readings(), step)


def join_pieces(a: Column, b: Column) -> Column:
    """The piece of two neighbours."""
    return _piece(F.when(a["prefix"] == a["n"], a["n"] + b["prefix"]).otherwise(a["prefix"]),
                  F.greatest(a["best"], b["best"], a["suffix"] + b["prefix"]),
                  F.when(b["suffix"] == b["n"], b["n"] + a["suffix"]).otherwise(b["suffix"]),
                  a["n"] + b["n"])


def fold_pieces(pieces: Column) -> Column:
    """The piece of an array of neighbours, in order."""
    return F.aggregate(pieces, no_readings(), join_pieces)


def fold_by(rows: DataFrame, keys: Sequence[str], order: Column, piece: str = "piece") -> DataFrame:
    """Per group the piece of all its pieces; a group has one row per chunk, so it is short."""
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("at"), F.col(piece).alias("piece"))))
    return rows.groupBy(*keys).agg(fold_pieces(F.transform(ordered, lambda p: p["piece"])).alias(piece))


def flagged(series: DataFrame, keys: Sequence[str], low: Column, seq: str = "seq", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, _chunk, _seq, _low): what the pieces of a series are made of."""
    return series.select(*keys, chunk_by_sequence(seq, chunk_rows).alias("_chunk"), F.col(seq).alias("_seq"), low.alias("_low"))


def chunk_pieces(flags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _chunk, piece): rows meet by (group, chunk) only, and a chunk leaves four numbers."""
    in_order = F.array_sort(F.collect_list(F.struct("_seq", "_low")))
    return flags.groupBy(*keys, "_chunk").agg(run_piece(F.transform(in_order, lambda r: r["_low"])).alias("piece"))


def longest_run(series: DataFrame, keys: Sequence[str], low: Column, seq: str = "seq",
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, longest_run): the longest run of rows for which ``low`` holds, in the order of ``seq``."""
    chunks = chunk_pieces(flagged(series, keys, low, seq, chunk_rows), keys)
    return fold_by(chunks, keys, F.col("_chunk")).select(*keys, F.col("piece.best").alias("longest_run"))
