"""A bit filter of fixed size for ids: lets all wanted ids pass and few others, so texts needn't be joined."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def slot_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS)).cast("int")


def bit_filter(ids: DataFrame) -> np.ndarray:
    """BITS bits, set for every ``doc_id``; bits are or-ed in Spark before they reach the driver."""
    words = ids.groupBy(F.floor(slot_of("doc_id") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))")).alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    for w, bits in words.toLocalIterator():
        out[w] = bits
    return out


def passes(bits: np.ndarray, slots: pa.Array) -> pa.Array:
    at = slots.to_numpy(zero_copy_only=False)
    return pa.array((bits[at // 64] >> (at % 64) & 1).astype(bool))
