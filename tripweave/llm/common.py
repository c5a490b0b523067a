"""What the operators of this subpackage share: input columns, batches of text, stored intermediates."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.operators.durable import CODEC, new_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only: other columns of any name are left behind; a null text is empty.

    A row without an id is no document and is left out.
    """
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(folds: int, left_out: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text falls into the fold that is never learned from."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds) == left_out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the n + 1 offsets of its rows; no copy."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` of text; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def give_back() -> None:
    """Return freed memory to the system: idle Python workers stand beside the next step's for a while."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it back; ``discard`` removes it again.

    The job's shuffle files go when the driver collects garbage, which a quiet driver would put off until the end.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    df.write.option("compression", CODEC).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    spark._jvm.System.gc()
    return out


def discard(*kept: DataFrame) -> None:
    """Remove intermediates that nothing will read again: what came from them must have been written."""
    for df in kept:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
