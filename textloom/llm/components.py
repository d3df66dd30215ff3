"""Connected components of links, and the bucket stream that makes them.

``components`` alternates large-star and small-star steps on tables of links (Kiveris et al., 2014): each step
connects the neighbours of a node to the smallest of them, and a few steps turn each component into a
star around its smallest node. Steps are aggregations and joins; the smallest neighbours are aggregated
before they are joined back, and both sides of each join are written tables, so AQE can split a node
that holds a third of all links. Nothing is collected but one number a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): root is the smallest node of its component."""

    def both(edges: DataFrame) -> DataFrame:
        return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def step(edges: DataFrame, large: bool) -> DataFrame:
        """``edges``: (u, v) with u > v."""
        flat = both(edges) if large else edges
        least = scratch.keep(flat.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        joined = flat.join(least, "u")
        if large:
            made = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            made = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        out = scratch.keep(made.where("u <> v").distinct(), "links")
        scratch.drop(least)
        scratch.drop(edges)
        return out

    def open_(edges: DataFrame) -> bool:
        """Whether some component is not yet a star around its smallest node."""
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        seen = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        return bool(seen.where("up > 1 OR up = 1 AND down = 1").limit(1).count())

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = scratch.keep(edges, "links")
    while open_(edges):
        edges = step(step(edges, True), False)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def whole_runs(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of a partition that is sorted by ``key`` in frames that split no run of equal keys; a run may span batches."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        k = frame[key].to_numpy()
        if held and held[0][key].iloc[0] != k[0]:
            yield pd.concat(held)
            held = []
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if last:
            yield pd.concat([*held, frame.iloc[:last]]) if held else frame.iloc[:last]
            held = []
        held.append(frame.iloc[last:])
    if held:
        yield pd.concat(held)


def buckets(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Runs of at least two rows with equal ``key`` of a partition that is sorted by it. Rows alone are dropped without a look."""
    for frame in whole_runs(frames, key):
        k = frame[key].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
        size = np.diff(edge)
        for a, n in zip(edge[:-1][size > 1], size[size > 1], strict=True):
            yield frame.iloc[a : a + n]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of the component of each of 0 to n - 1 under the links (a, b)."""
    up = np.arange(n)
    while len(a):
        low = np.minimum(up[a], up[b])
        np.minimum.at(up, up[a], low)
        np.minimum.at(up, up[b], low)
        while (up[up] != up).any():
            up = up[up]
        open_ = up[a] != up[b]
        a, b = a[open_], b[open_]
    return up


class Union:
    """Union-find over 0 to n - 1; the smallest number is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
