"""Links between similar sets of shingles: MinHash bands, exact Jaccard similarity, components.

Points (a set each, copies are one point) that agree in a whole band of their MinHash signatures collide. Bands are aggregated to
the least point of each, and a colliding point first meets that one only, so that a candidate pair is made once and a band that
thousands of near copies share costs a comparison a point. A band whose points are then in one component is done, however
large it is. The others are dealt out in blocks: members of the band's largest component go to one block each, the rest to all blocks,
and the rest meets itself in pairs of blocks; no pair that collides is left out. No step gathers a band before it is dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textloom.llm.bloom import possible
from textloom.llm.common import Scratch, map_slices
from textloom.llm.components import components, whole_runs
from textloom.llm.words import mix


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    at = np.cumsum(size) - size
    return np.repeat(start - at, size) + np.arange(int(size.sum()))


def signatures(flat: np.ndarray, start: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """(sets, bands): a 64-bit hash of each band of the MinHash signature of the sets that begin at ``start`` in ``flat``."""
    short = (flat >> np.uint64(32)).astype(np.uint32)
    factors = np.random.default_rng(seed).integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    least = np.empty((len(start), bands * rows), np.uint64)
    for k, factor in enumerate(factors):
        least[:, k] = np.minimum.reduceat(short * factor, start) if len(start) else 0
    out = np.full((len(start), bands), 0x9E3779B97F4A7C15, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = mix(out ^ least[:, k::rows])
    return out


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def link(sets: list[np.ndarray], label: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that join the labels of all sets whose Jaccard similarity is at least ``least``; pairs of one label are not compared."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(size) - size
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    here, label, found = np.zeros(int(code.max()) + 1, bool), label.copy(), []
    for i in range(len(sets) - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        rest = rest[np.minimum(size[rest], size[i]) >= least * np.maximum(size[rest], size[i])]
        if not len(rest):
            continue
        own = code[start[i] : start[i] + size[i]]
        here[own] = True
        both = np.add.reduceat(here[code[ranges(start[rest], size[rest])]], np.cumsum(size[rest]) - size[rest], dtype=np.int64)
        here[own] = False
        near = rest[both >= least * (size[rest] + size[i] - both)]
        found += [(i, int(j)) for j in near]
        if len(near):
            label[np.isin(label, label[near])] = label[i]
    return found


#: Of a bucket: sets, labels, marks; the links that join labels.
Compare = Callable[[list[np.ndarray], np.ndarray, list[bytes]], list[tuple[int, int]]]


def similar_links(keys: DataFrame, fetch: Callable[[DataFrame], DataFrame], pair: Callable[..., bool], compare: Compare, block: int, scratch: Scratch) -> DataFrame:
    """(a, b): links that span the components of similar points. ``keys``: (short, key), where ``short`` is a part of a point's id;
    ``fetch`` gives (short, id, shingles, mark) of some (short, a written table), an id once. ``pair`` judges two (set, mark), ``compare`` a bucket."""
    least = keys.groupBy("key").agg(F.min("short").alias("centre"), F.max("short").alias("top")).where("centre <> top").select("key", "centre")
    least = scratch.keep(least, "least")
    met = possible(keys, F.col("key"), least, scratch).join(least, "key")
    hits = scratch.keep(met.select("key", "short", "centre").distinct(), "hits")
    pairs = scratch.keep(hits.where("short <> centre").select("short", "centre").distinct(), "pairs")
    some = scratch.keep(pairs.select("short").union(pairs.select("centre")).distinct(), "some")
    sets = scratch.keep(fetch(some), "sets")
    met = pairs.join(sets, "short").select("centre", F.col("id").alias("a"), F.col("shingles").alias("x"), F.col("mark").alias("m"))
    met = met.join(sets.select(F.col("short").alias("centre"), F.col("id").alias("b"), F.col("shingles").alias("y"), F.col("mark").alias("n")), "centre").drop("centre")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [pair(np.frombuffer(x, np.uint64), m, np.frombuffer(y, np.uint64), n) for x, m, y, n in zip(frame["x"], frame["m"], frame["y"], frame["n"], strict=True)]
            yield frame.loc[np.array(good, bool), ["a", "b"]]

    links = scratch.keep(map_slices(met, verify, "a binary, b binary", text="x"), "links")
    # bands in which more than one component is left
    label = components(links, scratch)
    label = sets.select("short", "id").join(label.withColumnsRenamed({"node": "id"}), "id", "left").select("short", "id", F.coalesce("root", "id").alias("label"))
    label = scratch.keep(label, "label")
    members = scratch.keep(hits.select("key", "short").join(label, "short"), "members")
    parts = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    parts = parts.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("most")).where("labels > 1")
    blocks = lambda n: F.ceil(n / block).cast("int")
    parts = parts.select("key", F.col("most.label").alias("most"), blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("most.n")).alias("others"))
    open_ = members.join(scratch.keep(parts, "parts"), "key")
    slot = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    all_ = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.lit(-1).alias("x"), k.alias("y")))
    own = slot(F.col("others"))
    among = F.when(F.col("others") > 1, F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y"))))
    empty = F.expr("CAST(array() AS array<struct<x: int, y: int>>)")
    place = F.when(F.col("label") == F.col("most"), F.array(F.struct(F.lit(-1).alias("x"), slot(F.col("blocks")).alias("y")))).otherwise(F.concat(all_, F.coalesce(among, empty)))
    dealt = open_.select("id", "label", "key", F.explode(place).alias("p")).select("id", "label", F.xxhash64("key", "p.x", "p.y").alias("bucket"))
    dealt = dealt.join(sets.select("id", "shingles", "mark"), "id")

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_runs(frames, "bucket"):
            for _, bucket in frame.groupby("bucket", sort=False):
                bucket = bucket.drop_duplicates("id").sort_values("id")
                if len(bucket) > 1:
                    found = compare([np.frombuffer(x, np.uint64) for x in bucket["shingles"]], pd.factorize(bucket["label"])[0], list(bucket["mark"]))
                    if found:
                        ids, at = bucket["id"].to_numpy(), np.array(found)
                        yield pd.DataFrame({"a": ids[at[:, 0]], "b": ids[at[:, 1]]})

    more = map_slices(dealt.repartition("bucket").sortWithinPartitions("bucket"), judge, "a binary, b binary", text="shingles")
    more = scratch.keep(more, "more")
    for table in (least, hits, pairs, some, sets, links, members):  # what is returned is written
        scratch.drop(table)
    return label.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")).union(more)
