"""N-gram Jaccard join over count vectors: tokens are hashed into groups, documents are points of group counts.

The shared shingles of two documents are at most the sum over groups of the smaller count, so a pair whose summed
minima are too few is never verified. Points of a block stand in an R-tree, whose boxes bound that sum for all
points below a node; surviving pairs are verified on the whole shingle sets.

Which documents meet is decided by the groups' contents. Documents with sizes up to ``hi`` that reach the threshold
differ in at most d = 2 hi (1 - t) / (1 + t) shingles, so of d + 1 + s groups at least 1 + s hold the same shingles
(s: a ``SPARE``-th of the groups). A document is sent to the key of every group that isn't empty (one with more than s
empty groups also to those), in the scheme of its size band and, near the upper end, of the next. One with fewer shared
keys than 1 + s less its empty groups links to no different set and is let go. No link is lost, and few unrelated
documents meet.

Within a key all documents are first compared with the smallest id (as many pairs as documents). Only where a key still holds
several components do its documents go to an R-tree block, cut into cells of bounded size, and there pairs of one component
are skipped. Points are compared first, as they take a tenth of the bytes; only pairs and documents that they leave are sent
with their sets. So a group of copies costs one comparison a document, and the result is exact for connectivity: no pair within
a group is emitted. Equal sets are one class from the start, found by a 128-bit sum of their hashes. Sets are 64-bit
hashes of shingles.

Cases: null and empty texts, and texts without words, have an empty set and are alone; shorter texts than a shingle have
one shingle, the whole sequence; rows with the same id are one node, linked by any of their texts; an empty table
gives an empty table. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import discard, keep, slices, text_buffer, texts
from tripweave.llm.components import components, groups
from tripweave.llm.filters import bit_filter, passes, slot_of
from tripweave.llm.hashing import mix, shingle_hashes, word_hashes, word_spans

SPARE = 8
CELL = 1024                # documents of one side of a block's cell
LEAF = 16
POINTS = 8192              # points of one side of a cell of points, whose leaves are large as well
POINT_BYTES = 8 << 20
POINT_LEAF = 256
PEEL = 3                   # rounds in which documents without enough keys across components are let go
_SLICE = 4 << 20
_BAND = 1.5


def bands(percent: int) -> list[int]:
    """Largest set size of each band, from the smallest size that can link without being equal."""
    hi, out = max(percent // (100 - percent), 2), []
    while hi < 1 << 40:
        hi = int(hi * _BAND) + 1
        out.append(hi)
    return out


def _sets(data: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Ascending hashes of each row's shingles."""
    starts, ends, rows = word_spans(data, bounds)
    h, border = shingle_hashes(word_hashes(data, starts, ends, fold_case=True), rows, len(bounds) - 1, k)
    for a, b in zip(border[:-1], border[1:]):
        yield np.unique(h[a:b])


def group_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The group, out of n, of each hash; ascending hashes have ascending groups."""
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def schemes_of(n: int, percent: int, limits: list[int]) -> list[int]:
    """The size band of a set and, near its upper end, the next: two that link have one in common."""
    band = int(np.searchsorted(limits, n))
    return [band] + [band + 1] * (n * 100 >= percent * (limits[band] + 1))


def keys_of(hashes: np.ndarray, percent: int, limits: list[int]) -> tuple[np.ndarray, int]:
    """What a document is found by, one key for each group, and how many keys it must share to link at all."""
    n, least = len(hashes), 1 << 30
    if n < percent // (100 - percent):
        return np.zeros(0, np.int64), least   # only an equal set reaches the threshold
    out = []
    for s in schemes_of(n, percent, limits):
        differ = 2 * limits[s] * (100 - percent) // (100 + percent)
        spare = max(2, differ // (SPARE - 1))
        parts = differ + 1 + spare
        cut = np.searchsorted(group_of(hashes, parts), np.arange(parts + 1))
        full = np.flatnonzero(cut[1:] > cut[:-1])
        content = np.zeros(parts, np.uint64)
        content[full] = np.add.reduceat(mix(hashes), cut[full])
        empty = parts - len(full)
        used = full if empty <= spare else np.arange(parts)
        least = min(least, spare + 1 - (empty if empty <= spare else 0))
        out.append(mix(content[used] + mix((used + (s << 32)).astype(np.uint64))))
    return np.concatenate(out).view(np.int64), least


def _hashed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, two sums that name the set, keys, least (of them shared with others by one that links)."""
    limits = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets, _SLICE):
                n, one, two, keys, least = [], [], [], [], []
                for h in _sets(data, offsets[lo:hi + 1], k):
                    n.append(len(h))
                    one.append(mix(h).sum(dtype=np.uint64).view(np.int64))
                    two.append(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))
                    found, needed = keys_of(h, percent, limits)
                    keys.append(found)
                    least.append(needed)
                border = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(one, pa.int64()),
                     pa.array(two, pa.int64()),
                     pa.ListArray.from_arrays(border, pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))),
                     pa.array(least, pa.int32())],
                    ["doc_id", "n_shingles", "one", "two", "keys", "least"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, one long, two long, keys array<long>, "
                                       "least int")


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id, shingles (ascending, bytes of 64-bit hashes) of at least the documents ``ids``; texts aren't moved."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(ids))     # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(passes(shared.value, batch.column("slot")))
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets, _SLICE):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo),
                     pa.array([h.tobytes() for h in _sets(data, offsets[lo:hi + 1], k)], pa.binary())],
                    ["doc_id", "shingles"])

    return texts(docs).withColumn("slot", slot_of("doc_id")).mapInArrow(run, "doc_id long, shingles binary")


def n_groups(size: float) -> int:
    """Groups of a point: about eight shingles each, where random points are well apart."""
    return int(min(max(16, 1 << int(np.log2(max(size, 1) / 8 + 1))), 4096))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def may_link(minima: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles with that many shared at most can reach the threshold."""
    return (100 + percent) * np.minimum(minima, np.minimum(n, m)) >= percent * (n + m)


def point_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes in each of n groups, as bytes; more than a byte holds makes a point that excludes no link."""
    counts = np.bincount(group_of(hashes, n), minlength=n)
    return (counts if counts.max(initial=0) < 256 else np.full(n, 255)).astype(np.uint8)


def _points(sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, scheme, n, point of stored sets that aren't empty: about a tenth of their bytes."""
    limits = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, scheme, n, point = [], [], [], []
            for i, shingles in enumerate(batch.column("shingles")):
                h = np.frombuffer(shingles.as_py(), np.uint64)
                for s in schemes_of(len(h), percent, limits) if len(h) else ():
                    at.append(i)
                    scheme.append(s)
                    n.append(len(h))
                    point.append(point_of(h, 1 << max(limits[s].bit_length() - 1, 4)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(scheme, pa.int32()), pa.array(n, pa.int64()),
                 pa.array(point, pa.binary())], ["doc_id", "scheme", "n", "point"])

    return sets.mapInArrow(run, "doc_id long, scheme int, n long, point binary")


def _likely(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose points allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(may_link(np.minimum(np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8))
                                  .sum(dtype=np.int64), n, m, percent))
                    for x, y, n, m in zip(batch.column("left"), batch.column("right"), *(
                        batch.column(c).to_pylist() for c in ("n", "m")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = points.select(F.col("doc_id").alias("a"), "scheme", "n", F.col("point").alias("left"))
    right = points.select(F.col("doc_id").alias("b"), "scheme", F.col("n").alias("m"), F.col("point").alias("right"))
    return pairs.join(left, "a").join(right, ["b", "scheme"]).select("a", "b", "n", "m", "left", "right") \
        .mapInArrow(run, "a long, b long").distinct()


def able_rows(points: np.ndarray, n: np.ndarray, part: np.ndarray, sides: np.ndarray, percent: int) -> np.ndarray:
    """Rows of a cell whose points allow a link to a row of another component ``part``; ``sides`` as in block_links."""
    hit = np.zeros(len(n), bool)
    if part.min() == part.max():
        return np.flatnonzero(hit)
    indexed = np.flatnonzero(sides == 0)
    tree = RTree(points[indexed], n[indexed], POINT_LEAF)
    for i in np.flatnonzero(sides == 1) if sides.any() else range(len(n)):
        found = indexed[tree.matches(points[i], int(n[i]), percent)]
        found = found[part[found] != part[i]]
        hit[i] |= len(found) > 0
        hit[found] = True
    return np.flatnonzero(hit)


def _able(dealt: DataFrame, percent: int) -> DataFrame:
    """doc_id of the points (block, component, doc_id, scheme, n, point) that may link to another component of their block.

    Only these are sent on with their sets. A block meets scheme by scheme, so documents of too different sizes don't.
    """
    sized = dealt.groupBy("block", "scheme").agg(F.count("*").alias("n"), F.sum(F.length("point")).alias("bytes")).select(
        "block", "scheme", F.ceil(F.greatest(F.col("n") / POINTS, F.col("bytes") / POINT_BYTES)).cast("int").alias("chunks"))
    dealt = dealt.join(sized, ["block", "scheme"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "block", "scheme", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component",
        "doc_id", "n", "point")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, ["block", "scheme", "i", "j"]):
            own, i, j, ids, n, part = (cell.column(c).to_numpy() for c in ("own", "i", "j", "doc_id", "n", "component"))
            sides = (own != i).astype(int)
            if i[0] != j[0] and (not sides.any() or sides.all()):
                continue
            points = np.frombuffer(b"".join(cell.column("point").to_pylist()), np.uint8).reshape(len(n), -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[able_rows(points, n, part, sides, percent)])], ["doc_id"])

    return (cells.repartition("block", "scheme", "i", "j").sortWithinPartitions("block", "scheme", "i", "j")
            .mapInArrow(run, "doc_id long").distinct())


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, b, left, right) that link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (left, right))
                g = n_groups((len(x) + len(y)) / 2)
                minima = np.minimum(np.bincount(group_of(x, g), minlength=g),
                                    np.bincount(group_of(y, g), minlength=g)).sum()
                keep.append(bool(may_link(minima, len(x), len(y), percent)) and linked(x, y, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


class RTree:
    """Points of group counts, bulk-loaded by size and then by the widest coordinate; boxes keep maxima and sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes, self.leaf = points, sizes, leaf
        self.root = self._node(np.arange(len(points)))

    def _node(self, rows: np.ndarray) -> dict:
        p = self.points[rows]
        node = {"top": p.max(axis=0), "least": int(self.sizes[rows].min()), "most": int(self.sizes[rows].max()),
                "first": int(rows.min())}
        if len(rows) <= self.leaf:
            return node | {"rows": rows}
        spread = p.max(axis=0) - p.min(axis=0)
        by = self.sizes[rows] if node["most"] - node["least"] > spread.max() else p[:, int(spread.argmax())]
        order = rows[np.argsort(by, kind="stable")]
        step = -(-len(order) // 4)
        return node | {"below": [self._node(order[i:i + step]) for i in range(0, len(order), step)]}

    def matches(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose summed minima with the point are enough."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            # the fewest shingles a partner needs decide, so the smallest size that could still match is taken
            m = max(node["least"], -(-size * percent // 100))
            if m > node["most"] or m * percent > size * 100 or not may_link(
                    int(np.minimum(node["top"], point).sum()), size, m, percent):
                continue
            if "rows" in node:
                rows = node["rows"]
                minima = np.minimum(self.points[rows], point).sum(axis=1, dtype=np.int64)
                out.append(rows[may_link(minima, size, self.sizes[rows], percent)])
            else:
                stack += node["below"]
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def block_links(sets: list[np.ndarray], part: np.ndarray, sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (indexes) that join different components ``part`` of one cell; enough to connect all that link.

    ``sides``: 0 and 1 for the two chunks of a cell (pairs across are wanted), all 0 for a chunk with itself.
    """
    n = np.array([len(s) for s in sets])
    g = n_groups(float(n.mean()))
    points = np.array([np.bincount(group_of(s, g), minlength=g) for s in sets])
    up = {int(p): int(p) for p in part}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    across = bool(sides.any())
    indexed = np.flatnonzero(sides == 0)
    tree = RTree(points[indexed], n[indexed])
    out = []
    for i in np.flatnonzero(sides == 1) if across else range(len(sets)):
        for j in indexed[tree.matches(points[i], int(n[i]), percent)]:
            if (across or j < i) and (a := find(int(part[i]))) != (b := find(int(part[j]))) \
                    and linked(sets[i], sets[j], percent):
                up[a] = b
                out.append((int(i), int(j)))
    return out


def _block_join(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of a block, of members (block, component, doc_id, shingles)."""
    sized = members.groupBy("block").agg(F.count("*").alias("n")).select(
        "block", F.ceil(F.col("n") / CELL).cast("int").alias("chunks"))
    dealt = members.join(sized, "block").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component",
        "doc_id", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, ["block", "i", "j"]):
            ids = cell.column("doc_id").to_pylist()
            sets = [np.frombuffer(s.as_py(), np.uint64) for s in cell.column("shingles")]
            own, i, j = (cell.column(c).to_numpy() for c in ("own", "i", "j"))
            sides = (own != i).astype(int) if i[0] != j[0] else np.zeros(len(ids), int)
            if i[0] != j[0] and (not sides.any() or sides.all()):
                continue
            found = block_links(sets, cell.column("component").to_numpy(), sides, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()),
                                                  pa.array([ids[b] for _, b in found], pa.int64())], ["a", "b"])

    return (cells.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
            .mapInArrow(run, "a long, b long"))


def _peeled(held: DataFrame, strong: DataFrame) -> DataFrame:
    """Rows (key, doc_id, component) of keys with several components and documents with enough such keys.

    A pair that links across components shares ``least`` keys, and all of them hold both components.
    """
    live = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo <> hi").select("key")
    rows = held.join(live, "key")
    enough = rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(strong, "doc_id").where("n >= least")
    out = keep(rows.join(enough.select("doc_id"), "doc_id"), "peeled")
    discard(held)
    return out


def _mapped(df: DataFrame, column: str, mapping: DataFrame, to: str) -> DataFrame:
    """``column`` of df replaced through (node, ``to``); a node that isn't in the mapping stays."""
    m = mapping.select(F.col("node").alias("_node"), F.col(to).alias("_to"))
    return df.join(m, F.col(column) == F.col("_node"), "left") \
        .withColumn(column, F.coalesce("_to", column)).drop("_node", "_to")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable over pairs of Jaccard similarity >= percent / 100."""
    rows = keep(_hashed(docs, k, percent), "rows")
    classes = rows.where("n_shingles > 0").groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("rep"))
    named = rows.select("doc_id", "n_shingles", "one", "two").join(classes, ["one", "two", "n_shingles"], "left") \
        .select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    named = keep(named, "named")
    same = named.where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    found = rows.select("doc_id", F.explode("keys").alias("key"))
    shared = keep(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    common = keep(found.join(shared, "key"), "common")          # shared is stored, so that a hot key can be split
    least = rows.select("doc_id", "least").groupBy("doc_id").agg(F.min("least").alias("least"))
    strong = keep(common.groupBy("doc_id").agg(F.count("*").alias("n")).join(least, "doc_id").where("n >= least")
                  .select("doc_id", "least"), "strong")
    near = keep(common.join(strong.select("doc_id"), "doc_id"), "near")
    discard(rows, shared, common)
    shared = keep(near.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
                  .select("key", "pivot"), "pivots")
    star = near.join(shared, "key").where("doc_id <> pivot")
    reps = same.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    star = keep(_mapped(star, "doc_id", reps, "component").where("doc_id <> pivot").distinct(), "star")
    discard(near, shared)

    pairs = star.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    ids = star.select("doc_id").unionByName(star.select(F.col("pivot").alias("doc_id"))).distinct()
    sets = keep(_sets_of(docs, ids, k), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    points = keep(_points(sets, percent), "points")
    links = _verified(_likely(pairs, points, percent).join(left, "a").join(right, "b"), percent)
    first = components(links.unionByName(same), "links")

    split = _mapped(_mapped(star.withColumn("x", F.col("doc_id")).withColumn("y", F.col("pivot")), "x", first,
                            "component"), "y", first, "component")
    held = keep(split.select("key", "doc_id", F.col("x").alias("component")).unionByName(
        split.select("key", F.col("pivot").alias("doc_id"), F.col("y").alias("component"))).distinct(), "held")
    discard(star)
    for _ in range(PEEL):
        held = _peeled(held, strong)
    discard(strong)
    least = held.groupBy("key").agg(F.min("component").alias("b"))
    blocks = components(held.join(least, "key").select(F.col("component").alias("a"), "b"), "blocks")
    members = keep(held.select("doc_id", "component").distinct()
                   .join(blocks.select(F.col("node").alias("component"), F.col("component").alias("block")), "component")
                   .select("block", "component", "doc_id"), "members")
    dealt = keep(members.join(points, "doc_id"), "dealt")
    able = keep(_able(dealt, percent), "able")
    discard(points, dealt)
    with_sets = members.join(able, "doc_id").join(sets, "doc_id")
    more = _mapped(_mapped(_block_join(with_sets, percent), "a", first, "component"), "b", first, "component")
    second = components(more, "more")
    discard(sets, held, members, able)
    out = _mapped(_mapped(named.withColumnRenamed("rep", "component_id"), "component_id", first, "component"),
                  "component_id", second, "component")
    return out.select("doc_id", "n_shingles", "component_id")


#: the same in SQL over the table ``documents`` for three words and 90 per cent, where ids occur once
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, chr(1))]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], chr(1)))) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS root FROM sets
  UNION
  SELECT y, root FROM reach JOIN both_ways ON doc_id = x)
SELECT doc_id, n_shingles, min(root) AS component_id
FROM reach JOIN (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM sets) USING (doc_id) GROUP BY ALL
"""
