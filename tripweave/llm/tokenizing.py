"""Cutting text where byte-level BPE can be cut, and encoding each distinct part once.

No match of the tokenizers' pattern reaches over, or looks back from, a place where white space follows something
else or ASCII punctuation follows an ASCII letter or digit. So the parts between such places are encoded apart, and a
part met before needs no second encoding. Texts that hold an added token of the vocabulary, which the library matches
before its pattern, are cut around it: the token is a part, and no border lies inside. All but the encoding of new parts is NumPy over a batch of bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

from tripweave.llm.hashing import SPACE, word_hashes

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK &= ~_WORD
_REMEMBERED = 64      # bytes of the longest part that is kept for later batches


def part_starts(data: np.ndarray, bounds: np.ndarray, whole: re.Pattern[bytes] | None = None) -> np.ndarray:
    """Where the parts of the rows start; each ends where the next one, or its row, does.

    A border before ASCII white space is used unless the bytes before may be white space beyond ASCII. Matches of ``whole``
    within a row are parts of their own.
    """
    lo, hi = int(bounds[0]), int(bounds[-1])
    block = data[lo:hi]
    if not len(block):
        return np.zeros(0, np.int64)
    start = np.zeros(len(block), bool)
    space = SPACE[block]
    maybe = np.zeros(len(block), bool)        # the character that ends here may be white space beyond ASCII
    maybe[1:] |= (block[:-1] == 0xC2) & ((block[1:] == 0x85) | (block[1:] == 0xA0))
    maybe[2:] |= (block[:-2] >= 0xE1) & (block[:-2] <= 0xE3) & (block[2:] >= 0x80)
    start[1:] = space[1:] & ~space[:-1] & ~maybe[:-1]
    start[1:] |= _MARK[block[1:]] & _WORD[block[:-1]]
    rows = bounds[:-1][bounds[:-1] < bounds[1:]] - lo
    start[rows] = True
    if whole is not None:
        raw = block.tobytes()
        if whole.search(raw):
            for a, b in zip((bounds[:-1] - lo).tolist(), (bounds[1:] - lo).tolist()):
                for found in whole.finditer(raw, a, b):
                    start[found.start()] = True
                    start[found.start() + 1:found.end()] = False
                    if found.end() < b:
                        start[found.end()] = True
    return np.flatnonzero(start) + lo


class PartMemo:
    """Ids of batches of text. ``encode`` turns a list of new parts (bytes) into their ids (little-endian, 32-bit).

    Within a batch equal parts are found by a 64-bit hash, between batches by their bytes. It starts anew when it
    holds ``most`` parts, so its memory is bounded. Each of ``added``, the vocabulary's added tokens, is a part as it stands.
    """

    def __init__(self, encode: Callable[[list[bytes]], Sequence[bytes]], most: int = 250_000,
                 added: Sequence[str] = ()):
        self.encode, self.most, self.known = encode, most, {}
        longest_first = sorted(added, key=lambda t: (-len(t), t))
        self.whole = re.compile(b"|".join(re.escape(t.encode()) for t in longest_first)) if added else None

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after the other, and the row borders among them."""
        n_rows = len(bounds) - 1
        starts = part_starts(data, bounds, self.whole)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(n_rows + 1, np.int64)
        ends = np.append(starts[1:], bounds[-1])
        _, first, same = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        lo = int(bounds[0])
        raw = data[lo:int(bounds[-1])].tobytes()
        keys = [raw[a:b] for a, b in zip((starts[first] - lo).tolist(), (ends[first] - lo).tolist())]
        found = list(map(self.known.get, keys))
        missing = [i for i, v in enumerate(found) if v is None]
        if missing:
            fresh = self.encode([keys[i] for i in missing])
            if len(self.known) + len(missing) > self.most:
                self.known.clear()
            for i, ids in zip(missing, fresh):
                found[i] = ids
                if len(keys[i]) <= _REMEMBERED:
                    self.known[keys[i]] = ids
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = (np.cumsum(size) - size)[same]
        n = size[same]
        before = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(begin - before[:-1], n) + np.arange(before[-1])]
        return out, before[np.searchsorted(starts, bounds)]
