"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint keeps every hash of a five-word shingle that is below the fixed fraction 1 / ``SCALE`` of the hash
range. As the threshold is the same for all documents, sketches merge by union, and the share of a short document's
hashes found in a long one estimates containment without a bias from the lengths. A text with words whose
shingles all lie above the threshold keeps its smallest hash, marked as such, so that unrelated short texts don't look
alike.

As text a fingerprint is its hashes in ascending order, eight hexadecimal digits each (the top 32 bits below the
threshold); ``~`` and eight digits for a lone smallest hash; empty for a text without words.

``next_documents`` streams documents in descending order of id, each with the one after it: range buckets are sorted
apart, and the first document of a bucket is sent to the bucket before it as well, so no task sees more than its bucket.

Cases: null texts are empty; two empty fingerprints are equal (likeness 1), an empty and another one differ (0);
rows with the same id follow each other in the order of their texts; a lone document is its own next one. Other input
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import slices, text_buffer, texts
from tripweave.llm.hashing import shingle_hashes, word_hashes, word_spans

SCALE_BITS = 3                      # the threshold is 1 / 8 of the range
WORDS = 5
_SLICE = 4 << 20


def sketches(data: np.ndarray, bounds: np.ndarray) -> list[tuple[bool, np.ndarray]]:
    """(whether it is only the smallest hash, ascending 32-bit hashes) of each row."""
    n = len(bounds) - 1
    starts, ends, rows = word_spans(data, bounds)
    h, border = shingle_hashes(word_hashes(data, starts, ends, fold_case=True), rows, n, WORDS)
    below = h < np.uint64(1 << (64 - SCALE_BITS))
    of = np.repeat(np.arange(n), np.diff(border))
    kept = ((h[below] << np.uint64(SCALE_BITS)) >> np.uint64(32)) | (of[below].astype(np.uint64) << np.uint64(32))
    kept = np.unique(kept)          # by row, then by hash
    cut = np.searchsorted(kept, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    values = (kept & np.uint64(0xFFFFFFFF)).astype(">u4")
    out = []
    for i in range(n):
        if cut[i] < cut[i + 1] or border[i] == border[i + 1]:
            out.append((False, values[cut[i]:cut[i + 1]]))
        else:
            out.append((True, np.array([h[border[i]:border[i + 1]].min() >> np.uint64(32)]).astype(">u4")))
    return out


def as_text(sketch: tuple[bool, np.ndarray]) -> str:
    return "~" * sketch[0] + sketch[1].tobytes().hex()


def from_text(fingerprint: str) -> tuple[bool, np.ndarray]:
    return fingerprint.startswith("~"), np.frombuffer(bytes.fromhex(fingerprint.lstrip("~")), ">u4")


def _both(a, b) -> int:
    return len(np.intersect1d(a[1], b[1], assume_unique=True)) if a[0] == b[0] else 0


def likeness(a: tuple[bool, np.ndarray], b: tuple[bool, np.ndarray]) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a[1]) or not len(b[1]):
        return float(len(a[1]) == len(b[1]))
    both = _both(a, b)
    return both / (len(a[1]) + len(b[1]) - both)


def containment(a: tuple[bool, np.ndarray], b: tuple[bool, np.ndarray]) -> float:
    """Estimated share of a's shingles that b has."""
    return _both(a, b) / len(a[1]) if len(a[1]) else 1.0


def merge(a: tuple[bool, np.ndarray], b: tuple[bool, np.ndarray]) -> tuple[bool, np.ndarray]:
    """The fingerprint of both documents' shingles together."""
    full = [x for x in (a, b) if len(x[1]) and not x[0]]
    if full:
        return False, np.unique(np.concatenate([x[1] for x in full])).astype(">u4")
    lone = [x[1] for x in (a, b) if len(x[1])]
    return (True, np.concatenate(lone).min(keepdims=True)) if lone else (False, np.zeros(0, ">u4"))


def _sketch_all(raw: list[bytes]) -> list[tuple[bool, np.ndarray]]:
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return [s for lo, hi in slices(bounds, _SLICE) for s in sketches(data, bounds[lo:hi + 1])]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            found = [as_text(s) for lo, hi in slices(offsets, _SLICE) for s in sketches(data, offsets[lo:hi + 1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())],
                                             ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def in_descending_order(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, _bucket, _tail: each bucket sorted, then (as _tail) the first document of the next one."""
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs)
    cuts = rows.agg(F.max("doc_id"), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [1.0], 20_000)) \
        .first()                                          # as many ids as there are buckets
    heads = np.array(sorted({cuts[0], *(cuts[1] or [])} - {None}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "_bucket", "_tail"]
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(heads, ids)           # ascending; the highest holds the first documents
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bucket), pa.array(np.zeros(len(ids), bool))], names)
            first = np.isin(ids, heads)
            if first.any():
                also = batch.filter(pa.array(first))
                yield pa.RecordBatch.from_arrays(
                    [*also.columns, pa.array((bucket[first] + 1) % len(heads)),
                     pa.array(np.ones(int(first.sum()), bool))], names)

    dealt = rows.mapInArrow(deal, "doc_id long, text string, _bucket long, _tail boolean")
    return (dealt.repartition(n, "_bucket")
            .sortWithinPartitions("_bucket", "_tail", F.desc("doc_id"), "text"))


def with_next(docs: DataFrame, share: int = 3, buckets: int | None = None) -> DataFrame:
    """Every document, its text with the last ``1 / share`` replaced by the start of the next document, fingerprints.

    doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            ids, text, bucket, tail = (h + batch.column(c).to_pylist() for h, c in
                                       zip(held, ("doc_id", "text", "_bucket", "_tail")))
            held = (ids[-1:], text[-1:], bucket[-1:], tail[-1:])
            at = [i for i in range(len(ids) - 1) if bucket[i] == bucket[i + 1] and not tail[i]]
            if not at:
                continue
            own = _sketch_all([t.encode() for t in text])
            edited = []
            for i in at:
                k = len(text[i]) // share
                edited.append(text[i][:len(text[i]) - k] + text[i + 1][:k])
            other = _sketch_all([t.encode() for t in edited])
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in at], pa.int64()), pa.array([len(text[i]) for i in at], pa.int64()),
                pa.array(edited, pa.string()), pa.array([as_text(own[i]) for i in at], pa.string()),
                pa.array([as_text(s) for s in other], pa.string()),
                pa.array([likeness(own[i], s) for i, s in zip(at, other)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64())],
                ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return in_descending_order(docs, buckets).mapInArrow(
        run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
