"""BPE by an index of pair occurrences: each pair knows all its positions, ranks are applied in ascending order.

All new parts of a batch lie in one array of symbols. The index maps the rank of a pair to the positions where it occurs
anywhere in the batch. The lowest active rank is applied to all its positions at once, and the lists of the pairs that
arise at their borders grow; entries of pairs that have gone are dropped when their rank's turn comes. As a pair is always
learned after the merges that make its two symbols, ascending ranks give each part what merging it alone would give.

Cases: a null or empty text has no ids and decodes to an empty text; repeated rows each give a row; rows without an id
are left out; other input columns are ignored. The time of one endless word is that of its merges, not its square. Ids
outside the vocabulary decode to nothing, bytes that are no UTF-8 to U+FFFD, both as the tokenizers library does.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import slices, text_buffer, texts
from tripweave.llm.tokenizing import PartMemo

_SLICE = 4 << 20
_NONE = np.iinfo(np.int32).max        # the rank of a pair that is never merged


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, more = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else more))
        more += b not in plain
    return letters


class Vocabulary:
    """Merges and tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") \
                or not before.get("use_regex", True) or spec["normalizer"] or spec["post_processor"] \
                or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") \
                or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        ids, added = model["vocab"], spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that depend on the text around them can't be cut out")
        self.added = {t["content"]: t["id"] for t in added}
        letters = byte_letters()
        self.first = np.array([ids[c] for c in letters], np.int32)
        self.size = max([*ids.values(), *self.added.values()]) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        left, right = (np.array([ids[m[side]] for m in pairs], np.int64) for side in (0, 1))
        learned = np.full(self.size, -1, np.int64)
        learned[made[::-1]] = np.arange(len(made))[::-1]
        if len(made) and (np.maximum(learned[left], learned[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge comes before one that makes its symbols, so ranks can't be applied in ascending order")
        self.left, self.right, self.made = left.astype(np.int32), right.astype(np.int32), made
        keys = left * self.size + right
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[by_key], by_key.astype(np.int32)
        value = {c: b for b, c in enumerate(letters)}
        raw = [b""] * self.size
        for token, i in [*ids.items(), *self.added.items()]:
            raw[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, raw), np.int64, self.size))
        self.lengths = np.diff(self.ends, prepend=0)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, _NONE where there is none."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE) if len(self.keys) else np.full(len(key), _NONE, np.int32)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and before which byte each one starts (n + 1)."""
        ids = np.asarray(ids, np.int64)
        known = ids < self.size
        ids = np.where(known, ids, 0)
        n = np.where(known, self.lengths[ids], 0)
        before = np.concatenate([[0], np.cumsum(n)])
        return self.raw[np.repeat(self.ends[ids] - n - before[:-1], n) + np.arange(before[-1])], before


class PairIndex:
    """The symbols of many words and, by rank, the positions where each pair occurs."""

    def __init__(self, words: list[bytes], vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(sizes)
        self.symbol = v.first[np.frombuffer(b"".join(words), np.uint8)]
        n = len(self.symbol)
        self.after = np.arange(1, n + 1, dtype=np.int64)       # the next symbol's position, -1 at a word's end
        self.after[self.ends[sizes > 0] - 1] = -1
        self.before = np.arange(-1, n - 1, dtype=np.int64)
        self.before[(self.ends - sizes)[sizes > 0]] = -1
        self.positions: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._enter(np.flatnonzero(self.after >= 0))

    def _enter(self, at: np.ndarray) -> None:
        """Add the pairs that start at the positions to the lists of their ranks."""
        rank = self.vocabulary.rank(self.symbol[at], self.symbol[self.after[at]])
        some = rank != _NONE
        at, rank = at[some], rank[some]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        begin = [0, *cuts.tolist()]
        for r, lo, hi in zip(rank[begin].tolist(), begin, [*begin[1:], len(at)]):
            held = self.positions.get(r)
            if held is None:
                self.positions[r] = [at[lo:hi]]
                heapq.heappush(self.active, r)
            else:
                held.append(at[lo:hi])

    def _apply(self, r: int) -> None:
        """Merge every occurrence of a rank's pair, leftmost first where they overlap."""
        a, b = self.vocabulary.left[r], self.vocabulary.right[r]
        lists = self.positions.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        nxt = self.after[at]
        good = (self.symbol[at] == a) & (nxt >= 0)
        good &= self.symbol[nxt] == b                          # where nxt is -1 it is off already
        at, nxt = at[good], nxt[good]
        if not len(at):
            return
        if a == b and len(at) > 1:
            k = np.arange(len(at))
            fresh = np.concatenate([[True], nxt[:-1] != at[1:]])
            odd = (k - np.maximum.accumulate(np.where(fresh, k, 0))) & 1 == 1
            at, nxt = at[~odd], nxt[~odd]
        beyond = self.after[nxt]
        self.symbol[at], self.symbol[nxt] = self.vocabulary.made[r], -1
        self.after[at], self.after[nxt] = beyond, -1
        inner = beyond >= 0
        self.before[beyond[inner]] = at[inner]
        left = self.before[at]
        self._enter(np.unique(np.concatenate([left[left >= 0], at[inner]])))

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        while self.active:
            self._apply(heapq.heappop(self.active))
        live = self.symbol >= 0
        upto = np.concatenate([[0], np.cumsum(live)])[self.ends]
        return self.symbol[live].astype("<u4"), np.diff(upto, prepend=0)


class PairEncoder:
    """Encodes batches of text; one per Python worker."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.pattern = Vocabulary(path), regex.compile(pattern)
        self.parts = PartMemo(self._encode, added=list(self.vocabulary.added))

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part: equal pattern matches of all parts are one word of the index."""
        added = {token.encode(): i for token, i in self.vocabulary.added.items()}
        number: dict[str, int] = {}
        matches, counts = [], np.zeros(len(parts), np.int64)
        for i, part in enumerate(parts):
            if part not in added:
                found = self.pattern.findall(part.decode())
                counts[i] = len(found)
                matches.append([number.setdefault(m, len(number)) for m in found])
        ids, n = PairIndex([m.encode() for m in number], self.vocabulary).run()
        start = np.cumsum(n) - n
        flat = np.fromiter(chain.from_iterable(matches), np.int64, int(counts.sum()))
        size, begin = n[flat], start[flat]
        upto = np.concatenate([[0], np.cumsum(size)])
        raw = ids[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        border = (4 * upto[np.concatenate([[0], np.cumsum(counts)])]).tolist()
        out = [raw[lo:hi] for lo, hi in zip(border, border[1:])]
        for i, part in enumerate(parts):
            if part in added:
                out[i] = int(added[part]).to_bytes(4, "little")
        return out

    def encode_rows(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Ids of each row as little-endian unsigned 32-bit integers."""
        ids, border = self.parts.ids(data, bounds)
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(border[:-1].tolist(), border[1:].tolist())]

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return np.frombuffer(self.encode_rows(data, np.array([0, len(data)]))[0], "<u4").tolist()


@cache
def encoder(path: str, pattern: str) -> PairEncoder:
    return PairEncoder(path, pattern)


def encode(docs: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets, _SLICE):
                made = encoder(tokenizer_path, pattern).encode_rows(data, offsets[lo:hi + 1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(made, pa.binary())],
                                                 ["doc_id", "ids"])

    coded = texts(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and ``decoded``, the text that the ids stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("ids"))
            for lo, hi in slices(offsets, _SLICE):
                at = offsets[lo:hi + 1]
                raw, before = encoder(tokenizer_path, pattern).vocabulary.decode(
                    np.frombuffer(data[at[0]:at[-1]].tobytes(), "<u4"))
                whole, cuts = raw.tobytes(), before[(at - at[0]) // 4].tolist()
                made = pa.array([whole[a:b].decode(errors="replace") for a, b in zip(cuts, cuts[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, made],
                                                 [*batch.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded string")
