"""Join helpers that hold up under skew and unknown sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SALTS = 32


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: str,
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join per-key facts (one row per key) to rows of possibly hot keys.

    A key's rows spread over ``salts`` tasks by ``spread``; the facts are repeated
    once per salt.  Grouping by the key afterwards then starts with a partial
    aggregation instead of staying on one hot partition.
    """
    left = big.withColumn("_salt", F.pmod(F.hash(spread), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def chunked_join(big: DataFrame, small: DataFrame, key: str, order: str, rows: int = 65_536) -> DataFrame:
    """Join per-key rows to ordered rows of possibly hot keys: a task holds at most ``rows`` of ``order`` of a key.

    The small side is repeated once per chunk that exists, not for every salt, so it grows only where a key is large.
    """
    piece = F.expr(f"`{order}` div {rows}").alias("_piece")
    pieces = big.select(key, piece).distinct().join(small, key)
    return big.select("*", piece).join(pieces, [key, "_piece"]).drop("_piece")
