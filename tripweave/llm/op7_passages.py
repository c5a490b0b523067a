"""Substring dedup by collinear chaining: passages that documents share, exactly or with small edits.

Seeds are five-word shingles, thinned by minimisers (the smallest hash of every ``WINDOW`` neighbouring shingles), so a
shared run of WINDOW + 4 words has a seed in both documents. Every seed is matched with its *first* occurrence in the
corpus (smallest id, then position), and every pair of neighbouring seeds with the *previous* document that has the pair, as
the first occurrence of a seed may be a common phrase or a part too short to be a passage: at most three times as many
matches as seeds, however many copies there are. (So a passage is missed if each of its seeds first occurs, and each pair last
occurred, in documents without the rest of it, even if a third one has all; the README says so.) The matches of two
documents are chained in order, gaps cost, by a Fenwick tree over positions; a chain is extended at both ends and
aligned (longest common subsequence, bit-parallel, between anchors) and is a passage if it has ``MIN_WORDS`` words and
agrees in ``AGREE`` of them. The first document keeps its copy, later ones lose theirs.

Texts never move for the search: seeds carry positions, and for documents with a chain only 32-bit word hashes are sent
(picked by a filter of fixed size). Matches are dealt by the later document, so a passage in a third of all documents is
no hot group; what it is first found in is joined under adaptive skew handling.

Cases: null and empty texts, and texts under MIN_WORDS words, have no passages; repeats within one document don't count;
rows that share id and text are one document; equal positions and scores go to the smaller one; an empty table gives an
empty table. Words are runs without ASCII white space, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm.common import discard, keep, slices, text_buffer, texts
from tripweave.llm.components import groups
from tripweave.llm.filters import bit_filter, passes, slot_of
from tripweave.llm.hashing import mix, shingle_hashes, word_hashes, word_spans

SEED_WORDS = 5
WINDOW = 16
MIN_WORDS = 45             # so that a passage of 50 words is found with edits at its ends too
AGREE = 0.8
GAP = 0.05                 # of a chain's score for each word skipped on either side
BLOCK = 1024               # words aligned at once, from anchor to anchor
DROP = 6                   # an extension ends this far below its best
RANGES = 64                # of document ids, among which a pair of seeds in many documents is dealt
SAMPLE_DOCS = 2000         # whose pairs show which ones many documents have; no result depends on it
HOT = 200                  # a pair is dealt if more than one of so many documents has it
_SLICE = 4 << 20


def minimisers(h: np.ndarray, border: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the hashes that are smallest in some window of their row (in all of it, if it is shorter)."""
    n = len(h)
    picked = [np.zeros(0, np.int64)]
    if n >= window:
        row = np.repeat(np.arange(len(border) - 1), np.diff(border))
        for lo in range(0, n - window + 1, 1 << 18):
            hi = min(lo + (1 << 18), n - window + 1)
            view = np.lib.stride_tricks.sliding_window_view(h[lo:hi + window - 1], window)
            inside = row[lo:hi] == row[lo + window - 1:hi + window - 1]
            picked.append((view.argmin(axis=1) + np.arange(lo, hi))[inside])
    for a, b in zip(border[:-1], border[1:]):
        if 0 < b - a < window:
            picked.append(np.array([a + int(h[a:b].argmin())]))
    return np.unique(np.concatenate(picked))


def seeds(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """hash, doc_id, at (word) of the seeds of every whole text, pair (with the next seed of the text) and step to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for lo, hi in slices(offsets, _SLICE):
                starts, ends, rows = word_spans(data, offsets[lo:hi + 1])
                enough = np.bincount(rows, minlength=hi - lo) >= min_words
                keep = enough[rows]
                starts, ends, rows = starts[keep], ends[keep], rows[keep]
                h, border = shingle_hashes(word_hashes(data, starts, ends, fold_case=True), rows, hi - lo, SEED_WORDS)
                at = minimisers(h, border, WINDOW)
                row = np.searchsorted(border, at, side="right") - 1
                last = np.append(row[1:] != row[:-1], True)[:len(at)]
                after = np.append(at[1:], 0)[:len(at)]
                pair = mix(h[at] * np.uint64(0x9FB21C651E98DF25) + h[after])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), pa.array(ids[lo + row]),
                     pa.array((at - border[row]).astype(np.int32)), pa.array(pair.view(np.int64), mask=last),
                     pa.array((after - at).astype(np.int32), mask=last)], ["hash", "doc_id", "at", "pair", "step"])

    return texts(docs).mapInArrow(run, "hash long, doc_id long, at int, pair long, step int")


def first_places(found: DataFrame) -> DataFrame:
    """hash, source, source_at: the first occurrence of every seed that occurs again."""
    return found.groupBy("hash").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")) \
        .where("n > 1").select("hash", F.col("first.doc_id").alias("source"), F.col("first.at").alias("source_at"))


def matches(found: DataFrame, first: DataFrame) -> DataFrame:
    """doc_id, at, source, source_at: each seed with its first occurrence, if that is in another document."""
    return found.join(first, "hash").where("doc_id <> source").select("doc_id", "at", "source", "source_at")


def _hot_pairs(rows: DataFrame) -> list[int]:
    """Pairs that a sample of SAMPLE_DOCS documents shows in more than one of HOT; they decide on the layout alone."""
    few = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    seen = rows.join(F.broadcast(few), "doc_id", "left_semi").groupBy("pair").agg(F.count_distinct("doc_id").alias("n"))
    return [r.pair for r in seen.where(F.col("n") > max(SAMPLE_DOCS // HOT, 1)).select("pair").collect()]


def previous_matches(found: DataFrame) -> DataFrame:
    """doc_id, at, source, source_at: both seeds of each pair with the first place in the previous document that has it.

    The documents of a pair that many have are cut by ranges of ids, and a row per pair and range carries the last document
    over the cuts. Rows are laid out once; only those of such pairs are dealt again.
    """
    rows = found.where("pair is not null").select("pair", "doc_id", "at", "step")
    hot = _hot_pairs(rows)
    cuts = found.where("pair is not null").approxQuantile("doc_id", [i / RANGES for i in range(1, RANGES)], 0.001) if hot else []
    part = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    named = F.broadcast(found.sparkSession.createDataFrame([(p,) for p in hot], "pair long").withColumn("hot", F.lit(True)))
    rows = rows.join(named, "pair", "left").withColumn("part", F.when(F.col("hot"), part).otherwise(-1)).drop("hot")

    def places_of(rows: DataFrame) -> DataFrame:
        return rows.repartition("pair", "part").groupBy("pair", "part", "doc_id").agg(
            F.sort_array(F.collect_list(F.struct("at", "step"))).alias("places"))

    place = F.struct("doc_id", F.col("places")[0].alias("place"))
    inside = places_of(rows).withColumn("before", F.lag(place).over(Window.partitionBy("pair", "part").orderBy("doc_id"))) \
        .where("before is not null").select("doc_id", "places", "before")
    stored = []
    if hot:
        places = keep(places_of(rows.where("part >= 0")), "places")
        ends = places.groupBy("pair", "part").agg(F.max_by(place, "doc_id").alias("last"), F.min("doc_id").alias("doc_id"))
        carried = keep(ends.withColumn("before", F.lag("last").over(Window.partitionBy("pair").orderBy("part")))
                       .where("before is not null").select("pair", "doc_id", "before"), "carried")
        inside = inside.unionByName(places.join(carried.hint("merge"), ["pair", "doc_id"]).select("doc_id", "places", "before"))
        stored = [places, carried]
    pairs = inside.select("doc_id", "before", F.explode("places").alias("p"))
    ends_of = F.array(F.struct(F.col("p.at").alias("at"), F.col("before.place.at").alias("source_at")),
                      F.struct((F.col("p.at") + F.col("p.step")).alias("at"),
                               (F.col("before.place.at") + F.col("before.place.step")).alias("source_at")))
    out = keep(pairs.select("doc_id", F.col("before.doc_id").alias("source"), F.explode(ends_of).alias("m"))
               .select("doc_id", "m.at", "source", "m.source_at"), "previous")
    discard(*stored)
    return out


class Fenwick:
    """Largest value over a prefix of positions."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def over(self, n: int) -> tuple[float, int]:
        """Of the first n positions."""
        out = (float("-inf"), -1)
        while n:
            if self.best[n] > out:
                out = self.best[n]
            n -= n & -n
        return out


def chains(x: np.ndarray, y: np.ndarray, gap: float = GAP, weight: float = SEED_WORDS) -> list[list[int]]:
    """Ordered matches (x, y) as chains of indexes, best first; every match is in one chain at most.

    ``x`` is ascending. A step to a later match costs ``gap`` for each word passed on either side, which splits into
    a part of each match, so the best predecessor is a prefix maximum over y.
    """
    n = len(x)
    levels, rank = np.unique(y, return_inverse=True)
    tree, score, before = Fenwick(len(levels)), [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:          # matches at one place don't follow each other
            value, p = tree.over(int(rank[j]))
            value -= gap * float(x[j] + y[j])
            score[j], before[j] = (weight + value, p) if value > 0 else (weight, -1)
            j += 1
        for k in range(i, j):
            tree.put(int(rank[k]), (score[k] + gap * float(x[k] + y[k]), k))
        i = j
    out, used = [], [False] * n
    for end in sorted(range(n), key=lambda k: (-score[k], k)):
        if used[end]:
            continue
        chain, k = [], end
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = before[k]
        out.append(chain[::-1])
    return out


def chained(matched: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, source, the anchors (at, source_at; about one per BLOCK words, first and last) of promising chains, and by_first:

    whether the documents have a first occurrence of a seed in common (column ``by_first`` of the matches).
    """
    least = min_words - 2 * (WINDOW - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for group in groups(batches, ["doc_id", "source"]):
            if group.num_rows < 2:
                continue
            x, y = group.column("at").to_numpy(), group.column("source_at").to_numpy()
            doc, source = group.column("doc_id")[0].as_py(), group.column("source")[0].as_py()
            by_first = bool(group.column("by_first").to_numpy(zero_copy_only=False).any())
            for chain in chains(x, y):
                if x[chain[-1]] + SEED_WORDS - x[chain[0]] < least or len(chain) < 2:
                    continue
                anchors, last = [], None
                for k in chain:
                    if last is None or x[k] - x[last] >= BLOCK or k == chain[-1]:
                        anchors.append(k)
                        last = k
                rows.append((doc, source, [int(x[k]) for k in anchors], [int(y[k]) for k in anchors], by_first))
            if len(rows) > 5000:
                yield _table(rows)
                rows = []
        if rows:
            yield _table(rows)

    names = ["doc_id", "source", "at", "source_at", "by_first"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()]

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    once = matched.repartition("doc_id").groupBy("doc_id", "source", "at", "source_at").agg(F.max("by_first").alias("by_first"))
    return (once.sortWithinPartitions("doc_id", "source", "at", "source_at")
            .mapInArrow(run, "doc_id long, source long, at array<int>, source_at array<int>, by_first boolean"))


def _words_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), words (32-bit hashes) of at least the documents ``ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(ids))     # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(passes(shared.value, batch.column("slot")))
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets, _SLICE):
                starts, ends, rows = word_spans(data, offsets[lo:hi + 1])
                h = (word_hashes(data, starts, ends, fold_case=True) >> np.uint64(32)).astype("<u4")
                cut = np.searchsorted(rows, np.arange(hi - lo + 1))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("version"),
                     pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    ["doc_id", "version", "words"])

    rows = texts(docs).withColumn("version", F.xxhash64("text")).withColumn("slot", slot_of("doc_id"))
    return rows.mapInArrow(run, "doc_id long, version long, words binary")


def common_subsequence(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    if len(x) == len(y) and (x == y).all():
        return len(x)
    where: dict[int, int] = {}
    for i, v in enumerate(x.tolist()):
        where[v] = where.get(v, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for v in y.tolist():
        hit = row & where.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def _extension(x: np.ndarray, y: np.ndarray) -> int:
    """How many words further two sequences agree; differing ones count against it."""
    n = min(len(x), len(y))
    if not n:
        return 0
    run = np.cumsum(np.where(x[:n] == y[:n], 1, -1.5))
    low = np.flatnonzero(np.maximum.accumulate(np.maximum(run, 0)) - run >= DROP)
    run = run[:low[0]] if len(low) else run
    return int(run.argmax()) + 1 if len(run) and run.max() > 0 else 0


def align(x: np.ndarray, y: np.ndarray, at: list[int], source_at: list[int]) -> tuple[int, int, int, int, int]:
    """Start and end of the passage in x and in y, and the words that agree; anchors are positions in x and y."""
    back = _extension(x[:at[0]][::-1], y[:source_at[0]][::-1])
    end, source_end = at[-1] + SEED_WORDS, source_at[-1] + SEED_WORDS
    ahead = _extension(x[end:], y[source_end:])
    cuts = [(at[0] - back, source_at[0] - back), *list(zip(at, source_at))[1:-1], (end + ahead, source_end + ahead)]
    same = sum(common_subsequence(x[a:c], y[b:d]) for (a, b), (c, d) in zip(cuts[:-1], cuts[1:]))
    return cuts[0][0], cuts[-1][0], cuts[0][1], cuts[-1][1], same


def aligned(docs: DataFrame, chain: DataFrame, min_words: int = MIN_WORDS, agree: float = AGREE) -> DataFrame:
    """doc_id, version, start, end, source_id, source_start, source_end, same: passages, in words."""
    ids = chain.select("doc_id").unionByName(chain.select(F.col("source").alias("doc_id"))).distinct()
    words = keep(_words_of(docs, ids), "words")
    own = words.select("doc_id", "version", F.col("words").alias("own"))
    other = words.select(F.col("doc_id").alias("source"), F.col("words").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "version", "start", "end", "source_id", "source_start", "source_end", "same",
                 "by_first"]
        for batch in batches:
            rows = []
            for doc, version, source, at, source_at, x, y, by_first in zip(*[batch.column(c) for c in (
                    "doc_id", "version", "source", "at", "source_at", "own", "other", "by_first")]):
                x, y = (np.frombuffer(v.as_py(), "<u4") for v in (x, y))
                at, source_at = at.as_py(), source_at.as_py()
                if at[-1] + SEED_WORDS > len(x) or source_at[-1] + SEED_WORDS > len(y):
                    continue                     # another text under the same id
                a, b, c, d, same = align(x, y, at, source_at)
                if b - a >= min_words and same >= agree * max(b - a, d - c):
                    rows.append((doc.as_py(), version.as_py(), a, b, source.as_py(), c, d, same, by_first.as_py()))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.bool_() if name == "by_first" else pa.int64())
                                              for c, name in zip(columns, names)], names)

    joined = chain.join(own.hint("merge"), "doc_id").join(other.hint("merge"), "source")
    found = joined.select("doc_id", "version", "source", "at", "source_at", "own", "other", "by_first").mapInArrow(
        run, "doc_id long, version long, start long, end long, source_id long, source_start long, source_end long, "
             "same long, by_first boolean")
    every = keep(found.groupBy(*found.columns[:-1]).agg(F.max("by_first").alias("by_first")), "every")
    found = keep(_uncovered(every), "passages")
    discard(words, every)
    return found


def _uncovered(every: DataFrame) -> DataFrame:
    """Passages but those of a previous document alone whose words an earlier document has as well: copies of copies."""
    columns = [c for c in every.columns if c != "by_first"]
    rows = every.groupBy("doc_id", "version").agg(F.collect_list(F.struct(*every.columns)).alias("all"))
    wanted = F.filter("all", lambda a: a["by_first"] | ~F.exists(
        "all", lambda b: (b["source_id"] < a["source_id"]) & (b["start"] <= a["start"]) & (b["end"] >= a["end"])))
    return rows.select(F.explode(wanted).alias("p")).select(*[F.col(f"p.{c}") for c in columns])


def passages(docs: DataFrame, min_words: int = MIN_WORDS, agree: float = AGREE) -> DataFrame:
    """Passages of every document that an earlier one (smaller id) has too; a row per pair of places, in words."""
    found = keep(seeds(docs, min_words), "seeds")
    first = keep(first_places(found), "first")       # stored, so that a hot seed's partition can be split in the join
    previous = previous_matches(found)
    places = matches(found, first).withColumn("by_first", F.lit(True)).unionByName(
        previous.withColumn("by_first", F.lit(False)))
    chain = keep(chained(places, min_words), "chains")
    discard(found, first, previous)
    out = aligned(docs, chain, min_words, agree)
    discard(chain)
    return out


def drop_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the passages ``found``; other columns pass unchanged."""
    gone = found.groupBy(F.col("doc_id").alias("_gone_doc"), F.col("version").alias("_gone_version")).agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_gone"))
    gone = gone.hint("merge")                        # the same plan at every size
    joined = docs.join(gone, (docs["doc_id"].cast("long") == gone["_gone_doc"])
                       & (F.xxhash64(docs["text"]) == gone["_gone_version"]), "left")
    text = F.when(gone["_gone"].isNull(), docs["text"]).otherwise(_without(docs["text"], gone["_gone"]))
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (in order) and the white space after them."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, _, _ = word_spans(data, np.array([0, len(data)]))
    border = np.append(starts, len(data))
    out, at = [], 0
    for a, b in spans:
        lo, hi = int(border[min(a, len(starts))]), int(border[min(b, len(starts))])
        if lo > at:
            out.append(raw[at:lo])
        at = max(at, hi)
    return b"".join([*out, raw[at:]]).decode()


def _without(text, spans):
    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t.as_py() if not s.is_valid else
                         cut_words(t.as_py(), [(x["start"], x["end"]) for x in s.as_py()])
                         for t, s in zip(text, spans)], pa.string())

    return cut(text, spans)
