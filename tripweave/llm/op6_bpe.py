"""Byte-level BPE as a monoid: halves are encoded apart and neighbours joined; decoding concatenates up the tree.

A fragment's value is the exact encoding of its bytes. ``join`` re-encodes a window around the border of two
fragments and widens it until the tokens outside provably stay: a sequence is the encoding of its bytes exactly if each
token of it is and every two neighbours encode to themselves (the first merge over a border in the whole would also
happen in the pair). So the join holds as soon as the outermost window tokens agree with their outer neighbours.

Cases: a null or empty text has no ids and decodes to no bytes; repeated rows each give a row; other input columns are
ignored. One endless word is a tree of its own, so long texts need no special care.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import slices, text_buffer, texts
from tripweave.llm.tokenizing import PartMemo

LEAF = 4
_SLICE = 4 << 20
Ids = tuple[int, ...]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> Ids:
    """Encode by merging the pair of lowest rank, leftmost first, until none is left; n log n."""
    n = len(piece)
    if n < 2:
        return tuple(ranks[piece[i:i + 1]] for i in range(n))
    end = list(range(1, n + 1))            # token at i reaches to end[i]; 0 once it is swallowed
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue                       # one of the two has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return tuple(out)


class TreeEncoder:
    """Encodes and decodes by one rank table; keeps what it has met, within bounds."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 100_000):
        self.ranks, self.pattern, self.most = ranks, regex.compile(pattern), most
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.small: dict[bytes, Ids] = {}
        self.pairs: dict[tuple[int, int], Ids] = {}
        self.parts = PartMemo(lambda new: [self._part(p) for p in new])

    def pair(self, a: int, b: int) -> Ids:
        """Encoding of the bytes of two tokens."""
        out = self.pairs.get((a, b))
        if out is None:
            if len(self.pairs) > self.most:
                self.pairs.clear()
            out = self.pairs[a, b] = merge_bytes(self.bytes_of[a] + self.bytes_of[b], self.ranks)
        return out

    def stays(self, a: int, b: int) -> bool:
        return self.pair(a, b) == (a, b)

    def join(self, left: Ids, right: Ids) -> Ids:
        """The encoding of two fragments' bytes together: the monoid's product."""
        if not left or not right:
            return left or right
        reach, mid = 1, self.pair(left[-1], right[0])
        while True:
            i, j = max(len(left) - reach, 0), min(reach, len(right))
            if (i == 0 or self.stays(left[i - 1], mid[0])) and (j == len(right) or self.stays(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            reach *= 2
            window = (*left[max(len(left) - reach, 0):], *right[:reach])
            mid = merge_bytes(b"".join([self.bytes_of[t] for t in window]), self.ranks)

    def fragment(self, piece: bytes) -> Ids:
        """Encoding of bytes that no pattern cuts, by halves."""
        if len(piece) <= LEAF:
            out = self.small.get(piece)
            if out is None:
                if len(self.small) > self.most:
                    self.small.clear()
                out = self.small[piece] = merge_bytes(piece, self.ranks)
            return out
        mid = len(piece) // 2
        return self.join(self.fragment(piece[:mid]), self.fragment(piece[mid:]))

    def _part(self, part: bytes) -> bytes:
        out: list[int] = []
        for match in self.pattern.findall(part.decode()):
            raw = match.encode()
            whole = self.ranks.get(raw)       # as the library does: a known piece is one token
            if whole is None:
                out += self.fragment(raw)
            else:
                out.append(whole)
        return np.array(out, "<u4").tobytes()

    def encode_rows(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Ids of each row as little-endian unsigned 32-bit integers."""
        ids, border = self.parts.ids(data, bounds)
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(border[:-1].tolist(), border[1:].tolist())]

    def encode(self, text: str) -> bytes:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_rows(data, np.array([0, len(data)]))[0]

    def decode(self, ids: bytes, block: int = 1 << 14) -> bytes:
        """Bytes of ids: those of blocks, concatenated up the tree."""
        each = np.frombuffer(ids, "<u4")
        done = [b"".join(map(self.bytes_of.__getitem__, each[i:i + block].tolist()))
                for i in range(0, len(each), block)]
        while len(done) > 1:
            done = [b"".join(done[i:i + 2]) for i in range(0, len(done), 2)]
        return done[0] if done else b""


@cache
def encoder(ranks_path: str, pattern: str) -> TreeEncoder:
    """One encoder per Python worker."""
    return TreeEncoder(read_ranks(ranks_path), pattern)


def _add(df: DataFrame, source: str, target: str,
         work: Callable[[np.ndarray, np.ndarray], list[bytes]]) -> DataFrame:
    """df with the bytes that ``work`` makes of slices (bytes and row borders) of the column ``source``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(source))
            for lo, hi in slices(offsets, _SLICE):
                made = pa.array(work(data, offsets[lo:hi + 1]), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, made],
                                                 [*batch.schema.names, target])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{target}` binary")


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of every whole text."""
    coded = _add(texts(docs), "text", "ids", lambda data, at: encoder(ranks_path, pattern).encode_rows(data, at))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the bytes that the column ``ids`` stands for."""
    def work(data: np.ndarray, at: np.ndarray) -> list[bytes]:
        tree = encoder(ranks_path, pattern)
        return [tree.decode(data[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    return _add(encoded, "ids", "decoded", work)
