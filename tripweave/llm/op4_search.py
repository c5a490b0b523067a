"""Exact top-k inner products by dual-tree search over cover trees.

Pivots (a farthest-first walk through a bounded sample, the upper levels of a cover tree) split all vectors into cells;
cells are cut into blocks of bounded size, queries into groups of bounded size. For a block and a group that may
meet, one task builds a cover tree over each: a node's children are chosen farthest first, so they are apart by what they
cover. Pairs of nodes are walked together; with centres p, c and covering radii s, r no member pair scores over

    p.c + |p| r + |c| s + r s

so a pair of nodes whose bound is below the worst k-th score of the query node is pruned. Every query starts with its
k-th score within the sample as a threshold, by which whole cells are passed over before anything is sent. Ties are kept
(bounds prune only when strictly smaller). Vectors are integers; scores are exact.

Cases: null vectors, and vectors with null or non-finite components, take no part; vectors are compared with those of
their own length only; rows with the same id count once, with the smallest vector; a query that has fewer than k partners
gets all; empty vectors score 0; no query or no candidate gives no row. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tripweave.llm.common import keep

SAMPLE = 2048
PIVOTS = 24
BLOCK_ROWS = 4096
GROUP_ROWS = 2048
FANOUT, LEAF = 8, 128


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, size, v (64-bit integers as bytes): floor(scale * component) of the vectors that take part."""
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.floor(scale * np.array(v.as_py(), np.float64)).astype("<i8") for v in batch.column("embedding")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([len(r) for r in rows], pa.int32()),
                 pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "size", "v"])

    rows = vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"),
                                       F.col("embedding").cast("array<double>").alias("embedding"))
    each = rows.mapInArrow(run, "vec_id long, size int, v binary")
    return each.groupBy("vec_id").agg(F.min(F.struct("v", "size")).alias("x")).select("vec_id", "x.size", "x.v")


def matrix(rows, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), size) if size else np.zeros((len(rows), 0), "<i8")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where it holds them exactly."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(axis=1))


def farthest_first(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen rows, and each row's nearest choice (its number) and distance."""
    chosen, nearest = [0], np.zeros(len(x), np.int64)
    distance = _distances(x, x[0])
    while len(chosen) < most and distance.max() > 0:
        k = int(distance.argmax())
        d = _distances(x, x[k])
        closer = d < distance
        nearest[closer], distance = len(chosen), np.minimum(d, distance)
        chosen.append(k)
    return np.array(chosen), nearest, distance


class CoverTree:
    """Nodes with a centre, the covering radius of their members, and children or, in a leaf, the members alone."""

    def __init__(self, vectors: np.ndarray):
        self.x = vectors.astype(np.float64)
        self.root = self._node(np.arange(len(vectors)), self.x[0])

    def _node(self, rows: np.ndarray, centre: np.ndarray) -> dict:
        x = self.x[rows]
        node = {"rows": rows, "centre": centre, "norm": float(np.sqrt((centre ** 2).sum())),
                "radius": float(_distances(x, centre).max()), "below": []}
        if len(rows) > LEAF and node["radius"] > 0:
            chosen, nearest, _ = farthest_first(x, FANOUT)
            if len(chosen) > 1:
                node["below"] = [self._node(rows[nearest == i], x[k]) for i, k in enumerate(chosen)]
        return node


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, query_ids: np.ndarray, floor: np.ndarray, k: int):
        n = len(query_ids)
        self.ids, self.k = query_ids, k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.vec = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor                      # a k-th score that is known to be reached

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.floor[rows], self.score[rows, -1])

    def offer(self, rows: np.ndarray, vec_ids: np.ndarray, scores: np.ndarray) -> None:
        good = (scores >= self.worst(rows)[:, None]) & (vec_ids[None, :] != self.ids[rows][:, None])
        some = np.flatnonzero(good.any(axis=1))
        if not len(some):
            return
        at = rows[some]
        lost = ~good[some]
        score = np.concatenate([self.score[at], np.where(lost, np.iinfo(np.int64).min, scores[some])], axis=1)
        vec = np.concatenate([self.vec[at], np.where(lost, np.iinfo(np.int64).max,
                                                     np.broadcast_to(vec_ids, lost.shape))], axis=1)
        order = np.lexsort((vec, -np.maximum(score, -np.iinfo(np.int64).max)), axis=1)[:, :self.k]
        self.score[at] = np.take_along_axis(score, order, axis=1)
        self.vec[at] = np.take_along_axis(vec, order, axis=1)


def dual_search(queries: np.ndarray, data: np.ndarray, data_ids: np.ndarray, best: Best) -> int:
    """Fill ``best`` from all data; returns the number of leaf pairs that were compared."""
    a, b = CoverTree(queries), CoverTree(data)
    stack, compared = [(a.root, b.root)], 0

    def bound(q: dict, d: dict) -> float:
        top = float(q["centre"] @ d["centre"]) + q["norm"] * d["radius"] + d["norm"] * q["radius"] \
            + q["radius"] * d["radius"]
        return top + 1e-6 * abs(top) + 1        # never below the true bound by rounding

    while stack:
        q, d = stack.pop()
        if bound(q, d) < best.worst(q["rows"]).min():
            continue
        if not q["below"] and not d["below"]:
            compared += 1
            best.offer(q["rows"], data_ids[d["rows"]], products(queries[q["rows"]], data[d["rows"]]))
        elif d["below"] and (not q["below"] or d["radius"] >= q["radius"]):
            stack += sorted(((q, c) for c in d["below"]), key=lambda p: bound(*p))
        else:
            stack += [(c, d) for c in q["below"]]
    return compared


def _cells(x: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell (text: length and pivot) and distance to its pivot; lengths without a pivot have the zero vector."""
    shared = x.sparkSession.sparkContext.broadcast(pivots)      # PIVOTS vectors for each length in the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            cell, distance = np.zeros(len(size), np.int64), np.zeros(len(size))
            values = batch.column("v").to_pylist()
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                v = matrix([values[i] for i in at], int(s)).astype(np.float64)
                p = shared.value.get(int(s), np.zeros((1, int(s))))
                square = (v ** 2).sum(1)[:, None] + (p ** 2).sum(1)[None, :] - 2 * v @ p.T
                cell[at] = square.argmin(axis=1)
                distance[at] = np.sqrt(((v - p[cell[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(distance)],
                                             [*batch.schema.names, "cell", "distance"])

    return x.mapInArrow(run, "vec_id long, size int, v binary, cell long, distance double")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best partners of the vectors with an id divisible by ``every``."""
    spark = vectors.sparkSession
    x = keep(quantised(vectors), "vectors")
    sample = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()      # at most SAMPLE rows
    by_size: dict[int, list] = {}
    for row in sample:
        by_size.setdefault(row["size"], []).append(row)
    points = {s: (np.array([r.vec_id for r in rows]), matrix([r.v for r in rows], s)) for s, rows in by_size.items()}
    pivots = {s: v.astype(np.float64)[farthest_first(v.astype(np.float64), PIVOTS)[0]] for s, (_, v) in points.items()}
    placed = keep(_cells(x, pivots), "cells")
    n_of = F.count(F.when(F.col("vec_id") % every == 0, 1))
    cells = placed.groupBy("size", "cell").agg(
        F.count("*").alias("n"), n_of.alias("n_queries"), F.max("distance").alias("radius")).orderBy("size", "cell")
    known = cells.collect()                                     # a row per pivot
    group_of, groups_of, at, held = {}, {}, 0, 0
    for c in known:                                             # neighbouring small cells share a query group
        key = (c["size"], c.cell)
        if held + c.n_queries > GROUP_ROWS or (group_of and last != c["size"]):
            at, held = at + 1, 0
        groups = max(-(-c.n_queries // GROUP_ROWS), 1)
        group_of[key], groups_of[key] = at, groups
        at, held, last = at + groups - 1, held + c.n_queries if groups == 1 else GROUP_ROWS, c["size"]
    plan = {"points": points, "pivots": pivots, "group": group_of, "groups": groups_of,
            "radius": {(c["size"], c.cell): c.radius for c in known},
            "blocks": {(c["size"], c.cell): -(-c.n // BLOCK_ROWS) for c in known}}
    shared = spark.sparkContext.broadcast(plan)                 # the sample and a few numbers per pivot

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with its starting threshold, once for every block it may have a partner in."""
        p = shared.value
        for batch in batches:
            rows = []
            for (size, cell), part in batch.groupby(["size", "cell"]):
                v, ids = matrix(part["v"].tolist(), size), part["vec_id"].to_numpy()
                sample_ids, s = p["points"].get(size, (np.zeros(0, np.int64), np.zeros((0, size), np.int64)))
                first = Best(ids, np.full(len(ids), np.iinfo(np.int64).min), k)
                first.offer(np.arange(len(ids)), sample_ids, products(v, s))
                floor, norm = first.score[:, -1], np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
                group = p["group"][size, cell] + ids % p["groups"][size, cell]
                centres = p["pivots"].get(size, np.zeros((1, size)))
                for c in [c for s2, c in p["radius"] if s2 == size]:
                    top = v @ centres[c] + norm * p["radius"][size, c]
                    near = np.flatnonzero(top + 1e-6 * np.abs(top) + 1 >= floor)
                    for block in range(p["blocks"][size, c]):
                        rows.append(pd.DataFrame({
                            "group": group[near], "size": size, "cell": c, "block": block, "vec_id": ids[near],
                            "v": part["v"].to_numpy()[near], "floor": floor[near]}))
            if rows:
                yield pd.concat(rows)

    schema = "group long, size int, cell long, block long, vec_id long, v binary, floor long"
    queries = placed.where(F.col("vec_id") % every == 0).select("vec_id", "size", "v", "cell").mapInPandas(aim, schema)
    queries = keep(queries, "queries")
    blocks = spark.createDataFrame([(s, c, int(b)) for (s, c), b in plan["blocks"].items()] or [(0, 0, 1)],
                                   "size int, cell long, blocks long")
    data = placed.join(F.broadcast(blocks), ["size", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).select("size", "cell", "block", "vec_id", "v")
    meet = queries.groupBy(F.col("group").alias("g"), F.col("size").alias("s"), F.col("cell").alias("c")).agg(
        F.lit(1).alias("one"))                                  # at most cells times groups
    sent = data.join(meet, (data["size"] == meet["s"]) & (data["cell"] == meet["c"])).select(
        F.col("g").alias("group"), "size", "cell", "block", "vec_id", "v")

    def search(key: tuple, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        size = int(key[1])
        best = Best(q["vec_id"].to_numpy(), q["floor"].to_numpy(), k)
        if len(q) and len(d):
            dual_search(matrix(q["v"].tolist(), size), matrix(d["v"].tolist(), size), d["vec_id"].to_numpy(), best)
        got = best.vec < np.iinfo(np.int64).max
        row, col = np.nonzero(got)
        return pd.DataFrame({"query_id": best.ids[row], "vec_id": best.vec[row, col], "score": best.score[row, col]})

    keys = ["group", "size", "cell", "block"]
    found = queries.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(
        search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


#: the same in SQL over the table ``embeddings``, for ids that occur once and vectors of one length
ORACLE = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
