"""Exact top-k inner-product search by dual-tree search over cover trees.

Both sides are indexed. A task takes its candidates in blocks and builds a cover tree of each: a node has a centre, a covering
radius and children whose centres lie further from each other than half of that radius; a vector that no other is near to at that
scale is a member of the node itself. The queries of a block have a cover tree too, built once. The search walks pairs of
nodes, the best bound first. For a query node with centre q and radius s and a candidate node with centre p and radius r, no
inner product exceeds

    q.p + |q| r + |p| s + r s,

and the pair is pruned if that is below the worst kth score of the query node's group (or equals it while every vec_id in the
candidate node is larger). Single vectors are nodes of radius zero and pruned in the same way. Vectors without any
structure, such as random directions in 64 dimensions, have no bound below the scores that matter, and all pairs are scored.
Each task keeps k rows a query, and a ranked window (with Spark's group limit before the shuffle) keeps the best k of all tasks.

Scale: the queries are a stated set. They are searched in blocks of about ``query_block`` rows: each block is one broadcast of
bounded size and one pass over the candidates, dealt over all tasks, and its result is written before the next begins. A task
holds one block of candidates at a time. No more than k rows a query and task are shuffled; a vector that
a third of all rows share is a node of radius zero, entered only while its ids can win ties.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without
vec_id. Fewer than k candidates: all are returned. Vectors of different lengths: only those of a query's
length are scored with it. A query's own rows are all rows of its vec_id; rows that repeat another vec_id
are candidates each. A query vec_id in several rows: its smallest vector asks. Scores are exact: floats
are used only where every partial sum is below 2**53, integers beyond; a score that takes more than 64 bits ends the query
with an error. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from textloom.llm.common import Scratch

K = 10
SCALE = 1024
QUERY_BLOCK = 16384
BLOCK = 4096
LEAF = 64
#: No score yet; no score is as small.
NONE = np.iinfo(np.int64).min


class CoverTree:
    """Nodes as arrays; the children of a node come after it. The centres of a node's children lie more than its scale apart and
    every vector lies within the scale of one of them; a child of a single vector is kept as a member of the node itself. A node of at most
    ``leaf`` vectors has members only."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.x, self.ids = x, ids
        self.norm2 = np.einsum("ij,ij->i", x, x)
        self.norm = np.sqrt(self.norm2)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.least: list[int] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(x):
            all_ = np.arange(len(x))
            self.build(0, all_, self._from(0, all_), leaf)
        self.centres = x[self.centre] if len(x) else x
        self.centre_norm = np.sqrt(np.einsum("ij,ij->i", self.centres, self.centres))
        self.below: list[np.ndarray] = [np.empty(0, np.int64)] * len(self.centre)
        for n in range(len(self.centre) - 1, -1, -1):
            self.below[n] = np.concatenate([self.members[n], *(self.below[k] for k in self.children[n])])

    def _from(self, c: int, who: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum(self.norm2[who] + self.norm2[c] - 2 * (self.x[who] @ self.x[c]), 0))
        d[who == c] = 0
        return d

    def build(self, root: int, who: np.ndarray, d: np.ndarray, leaf: int) -> None:
        """By a stack, not by recursion: depth follows the spread of distances."""
        stack = [(root, who, d, -1)]
        while stack:
            c, who, d, parent = stack.pop()
            node = len(self.centre)
            self.centre.append(c)
            # what rounding may have taken off a distance is a part of the vectors' length
            self.radius.append(float(d.max()) * (1 + 1e-9) + 1e-6 * float(self.norm[who].max()) + 1e-6)
            self.least.append(int(self.ids[who].min()))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if len(who) <= leaf or not d.any():
                self.members.append(who)
                continue
            alone, scale = [], float(d.max()) / 2
            while len(who):
                near = d <= scale
                near[who == c] = True
                if near.sum() > 1:
                    stack.append((c, who[near], d[near], node))
                else:
                    alone.append(c)
                who = who[~near]
                if len(who):
                    c = int(who[0])
                    d = self._from(c, who)
            self.members.append(np.array(alone, np.int64))


class Best:
    """The k best of each query: scores descending, ties by ascending id. Scores are whole numbers of 64 bits."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        k = self.score.shape[1]
        score = np.where(ids[None, :] == own[:, None], NONE, score)
        better = (score > self.score[rows, -1:]) | (score == self.score[rows, -1:]) & (ids[None, :] < self.id[rows, -1:])
        use = better.any(1)
        if not use.any():
            return
        rows, score = rows[use], score[use]
        s = np.concatenate([self.score[rows], score], 1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], 1)
        i = np.where(s == NONE, np.iinfo(np.int64).max, i)
        top = np.lexsort((i, ~s), axis=1)[:, :k]  # ~s: descending, without the overflow of -s
        self.score[rows], self.id[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole numbers held as floats. ``most``: no partial sum is larger."""
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.array([[int(v) for v in row] for row in a], object) @ np.array([[int(v) for v in row] for row in b], object).T
    return whole.astype(np.int64)  # a score beyond 64 bits raises


def dual_tree(q: CoverTree, c: CoverTree, best: Best, most: float = 0.0) -> tuple[int, int]:
    """Updates ``best`` with the candidates of ``c``: the numbers of pairs scored and of pairs pruned. ``most``: no partial sum is larger."""
    q_radius, c_radius, c_least = np.array(q.radius), np.array(c.radius), np.array(c.least)
    scored = pruned = 0

    def worst(rows: np.ndarray) -> tuple[int, int]:
        s = best.score[rows, -1]
        low = s.min()
        return int(low), int(best.id[rows, -1][s == low].max())

    def raised(b: np.ndarray) -> np.ndarray:
        """Bounds with room for rounding: scores are whole, so only the floor counts."""
        return b + np.abs(b) * 1e-9 + 1e-6

    def group(a: int, rows: np.ndarray, radius: float, nodes: list[int], points: np.ndarray) -> list[int]:
        """Scores ``points`` against the query group ``rows`` around the centre of ``a``, as far as they may count; the nodes that may count,
        the best bound last."""
        nonlocal scored, pruned
        centre, norm = q.centres[a], q.centre_norm[a]
        if len(points):
            low, last = worst(rows)
            bound = np.floor(raised(c.x[points] @ centre + c.norm[points] * radius))
            use = points[(bound > low) | (bound == low) & (c.ids[points] <= last)] if low != NONE else points
            pruned += len(rows) * (len(points) - len(use))
            scored += len(rows) * len(use)
            if len(use):
                best.add(rows, products(q.x[rows], c.x[use], most), c.ids[use], q.ids[rows])
        if not nodes:
            return []
        r = c_radius[nodes]
        bound = np.floor(raised(c.centres[nodes] @ centre + norm * r + c.centre_norm[nodes] * radius + r * radius))
        low, last = worst(rows)
        keep = []
        for k in np.argsort(bound).tolist():
            if low != NONE and (bound[k] < low or bound[k] == low and c_least[nodes[k]] > last):
                pruned += len(rows) * len(c.below[nodes[k]])
            else:
                keep.append(nodes[k])
        return keep

    stack = [(0, [0])] if len(q.centre) and len(c.centre) else []
    while stack:
        a, nodes = stack.pop()
        rows = q.below[a]
        nodes = group(a, rows, q_radius[a], nodes, np.empty(0, np.int64))
        if not nodes:
            continue
        b = nodes.pop()
        if nodes:
            stack.append((a, nodes))
        if q.children[a] and q_radius[a] > c_radius[b]:
            stack += [(k, [b]) for k in q.children[a]]
            own = q.members[a]  # single queries stand for themselves: at most the radius from the centre
            if len(own):
                below = [b]
                while below:
                    n = below.pop()
                    below += group(a, own, q_radius[a], c.children[n], c.members[n])
        else:
            left = group(a, rows, q_radius[a], c.children[b], c.members[b])
            if left:
                stack.append((a, left))
    return scored, pruned


def _search(queries: dict, x: list, ids: np.ndarray, k: int, leaf: int) -> Iterator[tuple]:
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(x):
        by_length.setdefault(len(v), []).append(i)
    for length, rows in by_length.items():
        if length not in queries:
            continue
        tree, largest = queries[length]
        y = np.array([x[i] for i in rows], dtype=np.float64).reshape(len(rows), length)
        best = Best(len(tree.ids), k)
        dual_tree(tree, CoverTree(y, ids[rows], leaf), best, largest * max(float(np.abs(y).max(initial=0)), 1) * max(length, 1))
        a, b = np.nonzero(best.score != NONE)
        yield from zip(tree.ids[a].tolist(), best.id[a, b].tolist(), best.score[a, b].tolist(), strict=True)


def vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer components (as doubles) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fit = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # a product that leaves the doubles is not finite either
    made = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("double"))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fit, made).alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")


def topk(vecs: DataFrame, is_query, k: int = K, query_block: int = QUERY_BLOCK, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """``vecs``: vec_id and x (integers as doubles); ``is_query``: a condition on vec_id."""
    spark = vecs.sparkSession
    scratch = Scratch(spark, "topk")
    asked = scratch.keep(vecs.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x")), "asked")
    blocks = max(1, -(-asked.count() // query_block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    folder = scratch.path("found")
    for n in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect()  # about query_block rows
        groups: dict[int, list] = {}
        for r in rows:
            groups.setdefault(len(r.x), []).append((r.vec_id, r.x))
        queries = {}
        for length, own in groups.items():
            x = np.array([v for _, v in own], dtype=np.float64).reshape(len(own), length)
            queries[length] = CoverTree(x, np.array([i for i, _ in own], np.int64), leaf), max(float(np.abs(x).max(initial=0)), 1)
        shared = spark.sparkContext.broadcast(queries)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held_x, held_ids = [], []
            for frame in frames:
                held_x += list(frame["x"])
                held_ids += frame["vec_id"].tolist()
                while len(held_x) >= block:
                    yield pd.DataFrame(_search(shared.value, held_x[:block], np.array(held_ids[:block], np.int64), k, leaf), columns=["query_id", "vec_id", "score"])
                    held_x, held_ids = held_x[block:], held_ids[block:]
            if held_x:
                yield pd.DataFrame(_search(shared.value, held_x, np.array(held_ids, np.int64), k, leaf), columns=["query_id", "vec_id", "score"])

        found = vecs.mapInPandas(run, "query_id long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.write.mode("append").parquet(folder)  # a block of queries at a time: the plan does not grow with their number
        shared.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(folder)


SQL = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: floor(1024 * e)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
     q AS (SELECT vec_id AS query_id, min(x) AS qx FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
     s AS (SELECT query_id, vec_id, CAST(CASE WHEN len(x) = 0 THEN 0 ELSE list_sum(list_transform(list_zip(qx, x), lambda p: p[1] * p[2])) END AS BIGINT) AS score
           FROM q JOIN v ON vec_id <> query_id AND len(qx) = len(x)),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
