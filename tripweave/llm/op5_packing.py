"""Packing by powers of two: every document is cut into pieces of binary length, equal lengths form a bucket.

A document of n tokens gives n div 2048 pieces of 2048 and one piece for each bit of the rest. A piece is a sequence
of its own: its length is a power of two, so it is never padded and no sequence crosses documents. Batches are drawn
from one bucket (``write_buckets`` lays them out as one folder per length). Nothing is shuffled: a document is
cut where it is read.

Cases: a null or empty text is the end id alone; equal rows give equal pieces under ids of their own; other input
columns are ignored. A long text leaves as many rows, none longer than 2048 tokens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import give_back, slices, text_buffer, texts
from tripweave.llm.tokenizing import PartMemo

LONGEST = 2048
END_ID = 1
_SLICE = 2 << 20          # an executor's workers hold a slice, its parts and their ids at once


@cache
def _coder(path: str) -> PartMemo:
    """Ids by a vocabulary of the tokenizers library, once per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder().values()
    if any(t.single_word or t.lstrip or t.rstrip for t in added):
        raise ValueError("added tokens that depend on the text around them can't be cut out")
    return PartMemo(lambda new: [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(
        [p.decode() for p in new], add_special_tokens=False)], added=[t.content for t in added])


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that add up to n, longest first, none over ``longest``."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens of every piece."""
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _pieces_of(batch, tokenizer_path, longest, end_id)

    return texts(docs).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")


def _pieces_of(batch: pa.RecordBatch, tokenizer_path: str, longest: int, end_id: int) -> Iterator[pa.RecordBatch]:
    data, offsets = text_buffer(batch.column("text"))
    for lo, hi in slices(offsets, _SLICE):
        ids, border = _coder(tokenizer_path).ids(data, offsets[lo:hi + 1])
        yield from _cut(batch.column("doc_id")[lo:hi].to_pylist(), ids, border, longest, end_id)
        del ids
        give_back()


def _cut(docs: list, ids: np.ndarray, border: np.ndarray, longest: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Batches of pieces, each of a few megabytes."""
    rows: list[tuple] = []
    size = 0
    for doc, a, b in zip(docs, border[:-1].tolist(), border[1:].tolist()):
        raw, n, at = ids[a:b].tobytes() + int(end_id).to_bytes(4, "little"), b - a + 1, 0
        for length in binary_lengths(n, longest):
            rows.append((doc, at, length, raw[4 * at:4 * (at + length)], n))
            at += length
            size += length
            if size > 1 << 20:
                yield _batch(rows)
                rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      ["doc_id", "start", "length", "ids", "doc_tokens"])


def pack(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """Pieces with ``sequence_id`` (unique, one per piece) and ``offset`` (0: a sequence is one piece).

    Ids say the partition and the row in it, so they need no count over all data; a task that is run again
    replaces its rows as a whole and ids stay unique.
    """
    return (pieces(docs, tokenizer_path, longest, end_id)
            .withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per length, to be read as batches of equal shape."""
    packed.write.partitionBy("length").parquet(path)
