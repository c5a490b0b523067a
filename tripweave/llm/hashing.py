"""Word hashes of whole batches of text, computed on the UTF-8 bytes with NumPy.

The hash of a word is a polynomial over per-byte random values modulo 2**64, read off prefix sums, so a batch costs a
few array passes whatever the number of words; prefixes of words come from the same sums.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) \
    + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random (finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SPACE):
    """Starts and ends (in ``data``) of the words of the rows cut at ``bounds``, and the row of each word."""
    lo, hi = int(bounds[0]), int(bounds[-1])
    inside = ~separator[data[lo:hi]]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = bounds[1:-1] - lo                      # a row border ends a word
    cuts = cuts[(cuts > 0) & (cuts < hi - lo)]
    starts[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    s = np.flatnonzero(starts) + lo
    e = np.flatnonzero(ends) + lo + 1
    return s, e, np.searchsorted(bounds, s, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False,
                prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """One 64-bit hash per word; with ``prefixes`` a row of hashes: the words cut to each length, then the whole.

    Works block by block, cut between words, so memory doesn't grow with the batch or with one long text.
    """
    n = len(starts)
    out = np.zeros((n, len(prefixes) + 1), np.uint64)
    i = 0
    while i < n:
        j = int(np.searchsorted(ends, starts[i] + _BLOCK, side="right"))
        j = max(j, i + 1)
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _tables(max(hi - lo + 1, _BLOCK + 1))
        block = data[lo:hi]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_VALUES[LOWER[block] if fold_case else block] * up[:hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        for k, most in enumerate((*prefixes, None)):
            until = e if most is None else np.minimum(e, s + most)
            out[i:j, k] = mix((sums[until] - sums[s]) * down[s] + (until - s).astype(np.uint64))
        i = j
    return out if prefixes else out[:, 0]


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words of a row and the row borders (n_rows + 1) among them.

    A row with one to k - 1 words has one shingle, its whole sequence; a row without words has none.
    """
    count = np.bincount(rows, minlength=n_rows)
    first = np.zeros(n_rows + 1, np.int64)
    np.cumsum(count, out=first[1:])
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    border = np.zeros(n_rows + 1, np.int64)
    np.cumsum(made, out=border[1:])
    of = np.repeat(np.arange(n_rows), made)
    at = first[of] + np.arange(border[-1]) - border[of]
    size = np.minimum(count, k)[of]
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        more = size > j
        if more.all():
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[at + j])
        else:
            h[more] = mix(h[more] * np.uint64(0x9FB21C651E98DF25) + words[at[more] + j])
    return mix(h + size.astype(np.uint64)), border
