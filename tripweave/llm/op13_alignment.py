"""Alignment of two tokenizers by pointer jumping, with the corpus counts of the id pairs that it links.

The tokens of both tokenizers over the same bytes are nodes. Every token points to the overlapping token that reaches
farthest to the right (of two that end together to the second tokenizer's), itself if none reaches farther. Doubling the
pointers (each takes its target's) until nothing changes leads every token of a connected component to the component's last
token, whose byte end is where tokens of both sides end: the label of its group. All texts of a slice are jumped at once.

Counts go by slices of a few megabytes: a slice names its distinct linked pairs once, with the number of its documents
that hold them, so the shuffles carry pairs of slices and not of documents. Pair counts are sums of these; each slice then
gets the counts of its own pairs back and its documents look them up. No pair, group or document passes the driver.

Cases: texts null, empty, or that one of the tokenizers doesn't give back byte for byte have no tokens: all numbers 0, groups
''. Repeated rows are documents each, in the counts too. Rows without an id are left out; other input columns are
ignored. A text longer than a slice is a slice of its own. An empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import keep, slices, text_buffer, texts
from tripweave.llm.hashing import word_hashes
from tripweave.llm.op11_pair_bpe import PairIndex, Vocabulary

_SLICE = 2 << 20
_REMEMBERED = 64                    # bytes of the longest part that is kept for later slices
_TOGETHER = 500                     # parts that are encoded in one call
_MARK = "▁".encode()                # the second tokenizer takes it for a space
_SPACE = 0x20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Tokens:
    """The bytes of the tokens of one tokenizer."""

    def __init__(self, raw: list[bytes]):
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.start = np.cumsum(self.size) - self.size
        digits = [str(i).encode() for i in range(len(raw))]
        self.width = max(map(len, digits), default=1)
        self.digits = np.zeros((len(raw), self.width + 1), np.uint8)      # one place is left for what follows
        for i, d in enumerate(digits):
            self.digits[i, self.width - len(d):self.width] = np.frombuffer(d, np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(self.start[ids] - upto[:-1], n) + np.arange(upto[-1])]


class PairOfTokenizers:
    """Both tokenizers over parts of text that neither reaches over; one per Python worker.

    Parts start at a space behind something else than white space. The first tokenizer's pattern always cuts there, and no
    piece of the second has a space behind another character, which is checked when it is read.
    """

    def __init__(self, a_path: str, b_path: str, most: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"                    # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(a_path)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        vocabulary = Vocabulary(a_path)
        ends = vocabulary.ends.tolist()
        raw = vocabulary.raw.tobytes()
        tokens = [raw[e - n:e] for e, n in zip(ends, vocabulary.lengths.tolist())]
        self.a = Tokens(tokens)
        self.many = _by_ranks(vocabulary, tokens) or (lambda text: self.first.encode(text, add_special_tokens=False).ids)
        self.second = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any(x != "▁" and y == "▁" for p in pieces for x, y in zip(p, p[1:])):
            raise ValueError("a piece of the second tokenizer reaches over a space")
        self.b = Tokens([bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode()
                         for i, p in enumerate(pieces)])
        self.one_space = [self.second.piece_to_id("▁")]
        self.most, self.known = most, {}

    def _one_by_one(self, parts: list[bytes]) -> list[tuple[bytes, bytes]]:
        words = [p.decode() for p in parts]
        first = self.first.encode_batch_fast(words, add_special_tokens=False)
        second = self.second.encode([w[1:] for w in words], num_threads=1)   # it adds the space itself
        return [(np.array(a.ids, "<i4").tobytes(), np.array(b if len(w) > 1 else self.one_space, "<i4").tobytes())
                for a, b, w in zip(first, second, words)]

    def _fresh(self, parts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids of each part. Parts are strung together, as calls cost more than words, unless they can't be told apart again."""
        out: list = [None] * len(parts)
        joint, single = [], []
        for i, part in enumerate(parts):
            (joint if 0x21 <= part[-1] < 0x7F and _MARK not in part else single).append(i)
        for k in range(0, len(joint), _TOGETHER):
            some = joint[k:k + _TOGETHER]
            text = b"".join([parts[i] for i in some]).decode()
            ends = np.cumsum([len(parts[i]) for i in some])
            first = _cut(self.a, self.many(text), ends)
            second = _cut(self.b, self.second.encode(text[1:]), ends)
            if first is None or second is None:
                single += some
                continue
            for i, both in zip(some, zip(first, second)):
                out[i] = both
        if single:
            for i, both in zip(single, self._one_by_one([parts[i] for i in single])):
                out[i] = both
        return out

    def ids(self, data: np.ndarray, bounds: np.ndarray):
        """Ids of both tokenizers for all rows, one after the other, and the row borders among each."""
        starts = _part_starts(data, bounds)
        ends = np.append(starts[1:], bounds[-1])
        _, first, same = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        lo = int(bounds[0])
        raw = data[lo:int(bounds[-1])].tobytes()
        keys = [raw[x:y] for x, y in zip((starts[first] - lo).tolist(), (ends[first] - lo).tolist())]
        found = list(map(self.known.get, keys))
        missing = [i for i, v in enumerate(found) if v is None]
        if missing:
            fresh = self._fresh([keys[i] for i in missing])
            if len(self.known) + len(missing) > self.most:
                self.known.clear()
            for i, both in zip(missing, fresh):
                found[i] = both
                if len(keys[i]) <= _REMEMBERED:
                    self.known[keys[i]] = both
        rows = np.searchsorted(starts, bounds)
        out = []
        for side in (0, 1):
            own = [f[side] for f in found]
            size = np.fromiter(map(len, own), np.int64, len(own)) // 4
            flat = np.frombuffer(b"".join(own), "<i4")
            begin, n = (np.cumsum(size) - size)[same], size[same]
            upto = np.concatenate([[0], np.cumsum(n)])
            out.append((flat[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])], upto[rows]))
        return out


def _by_ranks(vocabulary: Vocabulary, tokens: list[bytes]):
    """A faster encoder of the same ids, or None: merging by ranks of whole tokens instead of by listed pairs.

    Both give the same if later merges have larger ids and each token's own bytes encode to it, as then any two neighbours
    that make a token are the pair it was learned from.
    """
    import public_tokenizers
    import tiktoken

    own = np.array(sorted({*vocabulary.first.tolist(), *vocabulary.made.tolist()}), np.int64)
    ids, n = PairIndex([tokens[i] for i in own.tolist()], vocabulary).run()
    if (np.diff(vocabulary.made) <= 0).any() or (n != 1).any() or not np.array_equal(ids, own) \
            or vocabulary.first.max() > vocabulary.made.min(initial=1 << 30):
        return None
    ranks = {tokens[i]: i for i in own.tolist()}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary


def _cut(tokens: Tokens, ids: list[int], ends: np.ndarray) -> list[bytes] | None:
    """The ids of parts that end at these bytes; None if a token reaches over an end."""
    ids = np.array(ids, "<i4")
    upto = np.cumsum(tokens.size[ids])
    at = np.searchsorted(upto, ends)
    if at[-1] != len(ids) - 1 or not np.array_equal(upto[at], ends):
        return None
    raw, cuts = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
    return [raw[x:y] for x, y in zip(cuts, cuts[1:])]


def _part_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    lo = int(bounds[0])
    block = data[lo:int(bounds[-1])]
    start = np.zeros(len(block), bool)
    maybe = np.zeros(len(block), bool)        # the character that ends here may be white space beyond ASCII
    maybe[1:] |= (block[:-1] == 0xC2) & ((block[1:] == 0x85) | (block[1:] == 0xA0))
    maybe[2:] |= (block[:-2] >= 0xE1) & (block[:-2] <= 0xE3) & (block[2:] >= 0x80)
    start[1:] = (block[1:] == _SPACE) & ~_BLANK[block[:-1]] & ~maybe[:-1]
    start[bounds[:-1][bounds[:-1] < bounds[1:]] - lo] = True
    return np.flatnonzero(start) + lo


@cache
def tokenizers(a_path: str, b_path: str) -> PairOfTokenizers:
    return PairOfTokenizers(a_path, b_path)


# ---- pointer jumping ----------------------------------------------------------------------------------------------

def jump(pointer: np.ndarray) -> np.ndarray:
    """Where each node's chain of pointers ends: successors are doubled until none changes."""
    pointer, open_ = pointer.copy(), np.flatnonzero(pointer != np.arange(len(pointer)))
    while len(open_):
        target = pointer[pointer[open_]]
        moved = target != pointer[open_]
        pointer[open_] = target
        open_ = open_[moved]
    return pointer


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of the first side the range of tokens of the second that overlap it; all tokens have bytes."""
    a_start = np.concatenate([[0], a_end[:-1]])
    b_start = np.concatenate([[0], b_end[:-1]])
    return np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_start, a_end, side="left")


def terminals(a_end: np.ndarray, b_end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte end of the last token of each token's component, for both sides."""
    n, m = len(a_end), len(b_end)
    a_start = np.concatenate([[0], a_end[:-1]])
    b_start = np.concatenate([[0], b_end[:-1]])
    last_b = hi - 1                                                        # farthest to the right over each token
    last_a = np.searchsorted(a_start, b_end, side="left") - 1
    node = np.arange(n + m)
    pointer = node.copy()
    pointer[:n] = np.where(b_end[last_b] >= a_end, n + last_b, node[:n])
    pointer[n:] = np.where(a_end[last_a] > b_end, last_a, node[n:])
    end = np.concatenate([a_end, b_end])[jump(pointer)]
    return end[:n], end[n:]


class Aligned:
    """The alignment of the texts of one slice whose tokens give them back; offsets run over all of them."""

    def __init__(self, both: PairOfTokenizers, data: np.ndarray, bounds: np.ndarray):
        (a, a_rows), (b, b_rows) = both.ids(data, bounds)
        n_rows = len(bounds) - 1
        whole = (np.diff(bounds) > 1) & _gives_back(both.a, a, a_rows, data, bounds) \
            & _gives_back(both.b, b, b_rows, data, bounds)
        self.both, self.whole = both, whole
        self.a, self.n_a = _of_rows(a, a_rows, whole)
        self.b, self.n_b = _of_rows(b, b_rows, whole)
        self.a_end, self.b_end = np.cumsum(both.a.size[self.a]), np.cumsum(both.b.size[self.b])
        self.lo, self.hi = overlaps(self.a_end, self.b_end)
        if len(self.a):
            a_label, b_label = terminals(self.a_end, self.b_end, self.lo, self.hi)
        else:
            a_label = b_label = np.zeros(0, np.int64)
        cut = np.zeros(len(self.b), bool)                                  # the last token of a group
        cut[:-1] = b_label[1:] != b_label[:-1]
        cut[-1:] = True
        self.b_group = np.cumsum(cut) - cut
        self.a_group = np.searchsorted(b_label[cut], a_label)
        self.b_row = np.repeat(np.arange(n_rows), self.n_b)
        self.n_groups = np.bincount(self.b_row[cut], minlength=n_rows)
        self.n_links = np.bincount(np.repeat(np.arange(n_rows), self.n_a), weights=self.hi - self.lo,
                                   minlength=n_rows).astype(np.int64)

    def groups(self) -> list[str]:
        """Each row's ids as ``a1,a2|b1;a3|b2,b3``."""
        n, m = len(self.a), len(self.b)
        if not n:
            return [""] * len(self.n_a)
        total = int(self.b_group[-1]) + 1
        b_upto = np.concatenate([[0], np.cumsum(np.bincount(self.b_group, minlength=total))])
        a_upto = np.concatenate([[0], np.cumsum(np.bincount(self.a_group, minlength=total))])
        width = max(self.both.a.width, self.both.b.width)
        text = np.zeros((n + m, width + 1), np.uint8)
        a_at, b_at = np.arange(n) + b_upto[self.a_group], np.arange(m) + a_upto[self.b_group + 1]
        text[a_at, width - self.both.a.width:] = self.both.a.digits[self.a]
        text[b_at, width - self.both.b.width:] = self.both.b.digits[self.b]
        text[:, width] = ord(",")
        text[a_at[a_upto[1:] - 1], width] = ord("|")
        text[b_at[b_upto[1:] - 1], width] = ord(";")
        ends = np.cumsum(self.n_a + self.n_b)
        text[ends[self.n_b > 0] - 1, width] = 0                            # nothing follows a row's last id
        sizes = np.concatenate([[0], np.cumsum(np.count_nonzero(text, axis=1))])
        flat = text.ravel()
        raw = flat[flat != 0].tobytes().decode("ascii")
        cuts = sizes[np.concatenate([[0], ends])].tolist()
        return [raw[x:y] for x, y in zip(cuts, cuts[1:])]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked pairs of rows: row, first id, second id and number of links, by row and pair."""
        each = self.hi - self.lo
        upto = np.concatenate([[0], np.cumsum(each)])
        b_at = np.repeat(self.lo - upto[:-1], each) + np.arange(upto[-1])
        pairs = np.repeat(self.a.astype(np.int64), each) << 32 | self.b[b_at]
        distinct, pair = np.unique(pairs, return_inverse=True)
        key, times = np.unique(self.b_row[b_at] * max(len(distinct), 1) + pair, return_counts=True)
        row, pair = np.divmod(key, max(len(distinct), 1))
        return row, distinct, pair, times


def _gives_back(tokens: Tokens, ids: np.ndarray, rows: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each row's tokens spell its bytes."""
    upto = np.concatenate([[0], np.cumsum(tokens.size[ids])])
    size = upto[rows[1:]] - upto[rows[:-1]]
    spelt = tokens.spell(ids)
    if np.array_equal(size, np.diff(bounds)):
        differ = np.concatenate([[0], np.cumsum(spelt != data[bounds[0]:bounds[-1]])])
        at = bounds - bounds[0]
        return differ[at[1:]] == differ[at[:-1]]
    begin = upto[rows[:-1]].tolist()
    return np.array([n == y - x and np.array_equal(spelt[s:s + n], data[x:y])
                     for s, n, x, y in zip(begin, size.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())], bool)


def _of_rows(ids: np.ndarray, rows: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(rows)
    return ids[np.repeat(some, n)], np.where(some, n, 0)


# ---- Spark --------------------------------------------------------------------------------------------------------

_SCHEMA = ("slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pair binary, "
           "times binary, a int, b int, n_docs long, at int")


def aligned_slices(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of two kinds, told apart by ``a``: documents with their alignment, and the distinct pairs of a slice.

    A document holds its pairs as numbers within the slice (``pair``, little-endian 32-bit) and how many links each has.
    The result names slices by the task that made them, so it has to be stored before it is read twice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 33
        schema = pa.schema([("slice", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                            ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
                            ("pair", pa.binary()), ("times", pa.binary()), ("a", pa.int32()), ("b", pa.int32()),
                            ("n_docs", pa.int64()), ("at", pa.int32())])
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets, _SLICE):
                found = Aligned(both, data, offsets[lo:hi + 1])
                row, distinct, pair, times = found.links()
                cuts = (4 * np.searchsorted(row, np.arange(hi - lo + 1))).tolist()
                pairs, counts = pair.astype("<i4").tobytes(), times.astype("<i4").tobytes()
                n, m = hi - lo, len(distinct)
                rows = {"slice": np.full(n, number), "doc_id": batch.column("doc_id")[lo:hi], "n_a": found.n_a,
                        "n_b": found.n_b, "n_groups": found.n_groups, "n_links": found.n_links, "groups": found.groups(),
                        "pair": [pairs[x:y] for x, y in zip(cuts, cuts[1:])],
                        "times": [counts[x:y] for x, y in zip(cuts, cuts[1:])]}
                named = {"slice": np.full(m, number), "a": distinct >> 32, "b": distinct & 0xFFFFFFFF,
                         "n_docs": np.bincount(pair, minlength=m), "at": np.arange(m)}
                for columns, size in ((rows, n), (named, m)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type)
                         for f in schema], schema=schema)
                number += 1

    spaced = texts(docs).select("doc_id", F.concat(F.lit(" "), "text").alias("text"))
    return spaced.mapInArrow(run, _SCHEMA)


def _looked_up(key, mine: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of one slice with the counts of their links."""
    at = counts.column("at").to_numpy()
    n_docs, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    n_docs[at], best[at] = counts.column("n_docs").to_numpy(), counts.column("best").to_numpy()
    total, top = [], []
    for pair, times in zip(mine.column("pair"), mine.column("times")):
        of, t = np.frombuffer(pair.as_py(), "<i4"), np.frombuffer(times.as_py(), "<i4")
        total.append(int(n_docs[of] @ t.astype(np.int64)))
        top.append(int(best[of] @ t.astype(np.int64)))
    out = mine.drop_columns(["slice", "pair", "times"])
    return out.append_column("n_best", pa.array(top, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def align(docs: DataFrame, a_path: str, b_path: str, instead: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of every document.

    ``instead`` names columns, made from ``groups``, that are stored in its place.
    """
    kept = {"groups": F.col("groups")} if instead is None else instead
    made = aligned_slices(docs, a_path, b_path)
    stored = keep(made.select(*[c for c in made.columns if c != "groups"], *[c.alias(n) for n, c in kept.items()]), "aligned")
    named = stored.where("a is not null").select(F.col("slice").alias("of_slice"), "a", "b", "n_docs", "at")
    by_pair = named.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"))
    pairs = keep(by_pair, "pair-counts")
    highest = pairs.groupBy("a").agg(F.max("n_docs").alias("highest"))     # no more rows than the vocabulary has ids
    facts = pairs.join(F.broadcast(highest), "a") \
        .select("a", "b", "n_docs", (F.col("n_docs") == F.col("highest")).cast("long").alias("best"))
    counted = named.drop("n_docs").join(facts.hint("merge"), ["a", "b"]).select("of_slice", "at", "n_docs", "best")
    rows = stored.where("doc_id is not null").select(
        "slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", *kept, "pair", "times")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields
                      if f.name not in ("slice", "pair", "times"))
    return rows.groupBy("slice").cogroup(counted.groupBy("of_slice")).applyInArrow(
        _looked_up, f"{types}, n_best long, count_sum long")
