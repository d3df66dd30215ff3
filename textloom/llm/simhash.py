"""SimHash near-duplicates with BK-trees.

A document's fingerprint has, bit by bit, the majority of the hashes of its word shingles. Equal fingerprints are one point (so exact
copies cost nothing further). Points are routed to shards, a BK-tree is built of each shard (children keyed by their integer Hamming
distance to the parent), and a search follows only the edges within the radius of a query's distance. Links become components,
and each document gets the smallest doc_id of its component.

Shards: a tree of all fingerprints can't be broadcast or collected when there are billions, so the points go to the shard
trees instead. The fingerprint is cut into blocks of bits. Two points that differ in at most ``radius`` bits agree in all but ``radius``
blocks, so each choice of so many blocks is a shard key and no link is lost. Of a key as many leading bits are taken as give a
shard about ``SHARD`` points; with three blocks a point goes to three shards, and beyond 2**34 points to six of four blocks.

``deduplicate`` looks for documents of exact Jaccard similarity. There shards are the bands of MinHash signatures, whose number does not
grow with the points; a point first meets the root of its shard's tree, and where that leaves more than one component
the shard's tree is searched. Candidates within the radius of 256-bit fingerprints are compared by their shingle sets.

Scale: only (key, fingerprint) rows are shuffled, and links that span each shard's components come back, never all pairs. A shard of
more than ``BLOCK`` points (many near copies of one text) is dealt out as pairs of blocks. The last join, documents to
fingerprints, is between written tables, so a fingerprint that a third of all documents share can be split by AQE.

Cases: text null, empty or without words: fingerprint zero, linked like any other. Fewer words than a
shingle has: the whole sequence is one shingle. Repeated rows and null doc_ids stay rows; a component of null doc_ids only
has a null id. A very long text is hashed whole, in batches of shingles. An empty table gives an empty result. Other columns are
kept by ``deduplicate`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.llm.bloom import possible, split, tested
from textloom.llm.common import Scratch, lean, map_slices
from textloom.llm.components import components, roots, whole_runs
from textloom.llm.sets import ranges, signatures, similar, similar_links
from textloom.llm.words import Words, binaries, by_bytes, range_hashes, shingles

SHINGLE, RADIUS = 3, 2
#: Points of a shard on average, and at most before it is dealt out in blocks.
SHARD, BLOCK = 1024, 8192
_BATCH = 32768
_FRONT = 1 << 18


def shingles_of(text: str | None, size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text joined by spaces, and where its shingles start and end."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(words) else ends
    n = min(size, len(words))
    return b" ".join(words), starts[: len(words) - n + 1] if n else starts, ends[n - 1 :] if n else ends


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, the most significant bit first."""
    joined, starts, ends = shingles_of(text, shingle)
    count, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for k in range(0, len(starts), _BATCH):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[k : k + _BATCH].tolist(), ends[k : k + _BATCH].tolist(), strict=True)])
        count += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(starts)).tobytes() if len(starts) else bytes(8)


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, w0): the fingerprint as a signed long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = b"".join(fingerprint(t, shingle) for t in frame["text"])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "w0": np.frombuffer(raw, ">i8").astype(np.int64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(rows, run, "doc_id long, w0 long", text="text")


def exact_keys(radius: int = RADIUS, blocks: int = RADIUS + 1, bits: int = 64) -> list[list[int]]:
    """Masks of one word, of at most ``bits`` bits each: no pair within the radius of 64 bits is missed."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    out = []
    for some in combinations(range(blocks), blocks - radius):
        of = [b for k in some for b in range(cuts[k], cuts[k + 1])]
        out.append([sum(1 << b for b in of[:bits])])
    return out


def shard_keys(points: int, radius: int = RADIUS, shard: int = SHARD) -> list[list[int]]:
    """Exact keys whose shards have about ``shard`` points."""
    bits = max(0, (points // shard).bit_length())
    blocks = radius + 1
    while (blocks - radius) * (64 // blocks) < bits - 3 and blocks < radius + 4:
        blocks += 1
    return exact_keys(radius, blocks, bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKForest:
    """BK-trees of many shards as arrays. ``x``: points (rows of uint64 words), ``shard``: their shards, numbered from 0 in order.
    Children of a node lie side by side, in order of their distance to it."""

    def __init__(self, x: np.ndarray, shard: np.ndarray):
        self.x, self.span = x, 64 * x.shape[1] + 1
        who, group, at, keys = np.arange(len(x)), shard, [], []
        self.trees = int(shard[-1]) + 1 if len(shard) else 0
        base = 0
        while len(who):  # a level: the first of each group is its node, the others go to its children
            first = np.flatnonzero(np.diff(group, prepend=-1))
            node = who[first]
            at.append(node)
            rest = np.ones(len(who), bool)
            rest[first] = False
            who, group = who[rest], group[rest]
            edge = (base + group) * self.span + self.distance(x[who], x[node[group]])
            order = np.argsort(edge, kind="stable")
            who = who[order]
            key, group = np.unique(edge[order], return_inverse=True)
            keys.append(key)
            base += len(node)
        self.at = np.concatenate([np.empty(0, np.int64), *at])
        self.keys = np.concatenate([np.empty(0, np.int64), *keys])
        self.compared = 0

    @staticmethod
    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)

    def search(self, queries: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of all points within the radius of the queries (numbers of points), each in its own tree."""
        out_q, out_p, stack = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [(queries, tree)]
        while stack:
            q, node = stack.pop()
            if len(q) > _FRONT:  # bounded memory where a shard is dense
                stack += [(q[_FRONT:], node[_FRONT:])]
                q, node = q[:_FRONT], node[:_FRONT]
            point = self.at[node]
            d = self.distance(self.x[q], self.x[point])
            self.compared += len(q)
            near = d <= radius
            out_q.append(q[near])
            out_p.append(point[near])
            low = np.searchsorted(self.keys, node * self.span + np.maximum(d - radius, 0))
            many = np.searchsorted(self.keys, node * self.span + np.minimum(d + radius, self.span - 1), "right") - low
            q, node = np.repeat(q, many), self.trees + ranges(low, many)
            if len(q):
                stack.append((q, node))
        return np.concatenate(out_q), np.concatenate(out_p)


def links_of(x: np.ndarray, shard: np.ndarray, radius: int, block: int = 512) -> np.ndarray:
    """For each point the smallest number of a point in its component of its shard (single links)."""
    forest, up = BKForest(x, shard), np.arange(len(x))
    for k in range(0, len(x), block):
        q = np.arange(k, min(k + block, len(x)))
        a, b = forest.search(q, shard[q], radius)
        up = roots(len(x), np.concatenate((np.arange(len(x)), a)), np.concatenate((up, b)))
    return up


def link(x: np.ndarray, radius: int) -> np.ndarray:
    """As ``links_of`` for one shard."""
    return links_of(x, np.zeros(len(x), np.int64), radius)


def _shard_links(points: DataFrame, masks: list[list[int]], radius: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(a, b): links of points (id, w0) that span each shard's components."""
    key: list[Column] = [F.xxhash64(F.lit(n), F.col("w0").bitwiseAND(F.lit(_signed(m)))) for n, (m,) in enumerate(masks)]
    # the key's hash stands for the key: a collision joins two shards, and distances decide anyhow
    routed = points.select("id", "w0", F.explode(F.array(*key)).alias("key"))
    large = routed.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    routed = routed.join(scratch.keep(large, "large"), "key", "left")
    slot = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, slot) * F.col("parts") + F.greatest(o, slot))
    routed = routed.select("id", "w0", "key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(pair)).alias("pair"))
    routed = routed.select("id", "w0", F.when(F.col("pair") < 0, F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("key"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_runs(frames, "key"):
            ids, x = frame["id"].to_numpy(), frame["w0"].to_numpy().view(np.uint64)[:, None]
            shard = np.cumsum(np.diff(frame["key"].to_numpy(), prepend=frame["key"].iloc[0]) != 0)
            up = links_of(x, shard, radius)
            far = np.flatnonzero(up != np.arange(len(up)))
            if len(far):
                yield pd.DataFrame({"a": ids[up[far]], "b": ids[far]})

    return map_slices(routed.repartition("key").sortWithinPartitions("key"), run, "a long, b long", 1 << 15)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(doc_id, w0, component_id) for each row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marks = scratch.keep(fingerprints(docs, shingle).withColumn("id", F.col("w0")), "marks")
    points = scratch.keep(marks.groupBy("id", "w0").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "points")
    links = scratch.keep(_shard_links(points.select("id", "w0"), shard_keys(points.count(), radius, shard), radius, scratch, block), "shards")
    joined = components(links, scratch)
    named = points.join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", "first", "n", F.coalesce("root", "id").alias("root"))
    named = scratch.keep(named, "named")
    classes = named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("size")).where("size > 1")
    found = named.select("id", "root").join(scratch.keep(classes, "classes"), "root").select("id", "component_id")
    found = scratch.keep(found, "roots")
    out = marks.join(found.withColumn("found", F.lit(True)), "id", "left")
    return out.select("doc_id", "w0", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def simhash_classes(docs: DataFrame) -> DataFrame:
    """The digest columns."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of 256 bits of the distinct five-word shingles. Documents of Jaccard similarity 0.8 have a cosine of 0.89 and differ in
#: 39 bits on average, with a deviation of under 6, so the radius is three of these wider. With twelve bands of four two such
#: documents share a shard with probability 0.998.
WIDE = {"shingle": 5, "radius": 56, "bands": 12, "rows": 4}
SIMILARITY = 0.8
_WORDS = 4


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    flat, out = shingles(w.hash, size), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(flat[a : b - size + 1]))
        else:
            out.append(range_hashes(w.hash[a:b], np.array([0]), np.array([b - a])) if b > a else np.empty(0, np.uint64))
    return out


def set_fingerprint(hashes: np.ndarray, words: int = _WORDS) -> np.ndarray:
    """The fingerprint of a set of shingles as uint64 words: each shingle counts once, as in the Jaccard similarity."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    count = np.zeros((words, 64), np.int64)
    for k in range(0, len(hashes), _BATCH):
        for w in range(words):
            x = hashes[k : k + _BATCH] + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)  # splitmix64
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            count[w] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(hashes), axis=1).view(np.uint64).ravel()


def _doc_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    return rows.select("doc_id", "text_hash", F.xxhash64("doc_id", "text_hash").alias("doc"), "text")


def set_marks(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, doc, id, short, key): the set's 128-bit id and its bands."""
    kind = T.StructType.fromDDL("doc_id long, text_hash long, doc long, id binary, short long, key array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        arrow = to_arrow_schema(kind)
        for batch in by_bytes(batches):
            sets = shingle_sets(Words(binaries(batch.column("text"))), shingle)
            ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            some = [s for s in sets if len(s)]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            key = signatures(np.concatenate([np.empty(0, np.uint64), *some]), (np.cumsum(size) - size)[size > 0], bands, rows).view(np.int64)
            ends = np.concatenate(([0], np.cumsum((size > 0) * bands)))
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key.ravel(), pa.int64()))
            short = pa.array(np.frombuffer(b"".join(ids), "<i8")[::2], pa.int64())
            columns = [*(batch.column(c) for c in ("doc_id", "text_hash", "doc")), pa.array(ids, pa.binary()), short, made]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return _doc_rows(docs).mapInArrow(run, kind)


def link_sets(sets: list[np.ndarray], label: np.ndarray, marks: list[bytes], radius: int, least: float) -> list[tuple[int, int]]:
    """Links that join labels: pairs that the shard's BK-tree finds within the radius and whose sets have Jaccard similarity ``least``.
    Pairs of one label are not compared."""
    x = np.frombuffer(b"".join(marks), np.uint64).reshape(len(marks), -1)
    forest, label, found = BKForest(x, np.zeros(len(x), np.int64)), label.copy(), []
    for k in range(0, len(x), 256):
        q = np.arange(k, min(k + 256, len(x)))
        a, b = forest.search(q, np.zeros(len(q), np.int64), radius)
        new = (a < b) & (label[a] != label[b])
        a, b = a[new], b[new]
        for i in np.argsort(BKForest.distance(x[a], x[b]), kind="stable").tolist():  # the nearest first: they settle the others
            i, j = int(a[i]), int(b[i])
            if label[i] != label[j] and similar(sets[i], sets[j], least):
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def deduplicate(
    docs: DataFrame, shingle: int = WIDE["shingle"], radius: int = WIDE["radius"], bands: int = WIDE["bands"], rows: int = WIDE["rows"],
    least: float = SIMILARITY, block: int = 1024,
) -> DataFrame:
    """``docs`` without near copies: of each component the row of the smallest doc_id stays. Links are pairs whose sets of shingles
    have Jaccard similarity ``least``; bands and fingerprints only choose the pairs.

    Rows are named by doc_id and text: rows that share both stay together, and so do rows of null doc_id, which nothing can name. Of two
    rows with one doc_id and unlike texts each is judged by its own text.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    marks = scratch.keep(set_marks(docs, shingle, bands, rows), "marks")
    # nulls come last, so that a row with a doc_id is the one that stays
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "doc")).alias("first")
    points = scratch.keep(marks.groupBy("id", "short").agg(first, F.count("*").alias("n")), "points")

    def fetch(some: DataFrame) -> DataFrame:
        wanted = possible(points, F.col("short"), some, scratch).join(some, "short", "left_semi").select("id", F.col("first.doc").alias("doc"))
        wanted = scratch.keep(wanted.groupBy("doc").agg(F.collect_set("id").alias("ids")), "wanted")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                made = []
                for s, ids in zip(shingle_sets(Words([x or b"" for x in frame["text"]]), shingle), frame["ids"], strict=True):
                    own = xxhash.xxh3_128_digest(s.tobytes())
                    if own in set(ids):
                        made.append((int(np.frombuffer(own, "<i8")[0]), own, s.tobytes(), set_fingerprint(s).tobytes()))
                yield pd.DataFrame(made, columns=["short", "id", "shingles", "mark"])

        rows = possible(_doc_rows(docs), F.col("doc"), wanted, scratch).join(wanted, "doc").dropDuplicates(["doc", "text"])
        # an id is wanted of one document only, so that rows that are alike are all that repeats
        return map_slices(rows.select(F.col("text").cast("binary").alias("text"), "ids"), run, "short long, id binary, shingles binary, mark binary", text="text")

    def pair(x: np.ndarray, m: bytes, y: np.ndarray, n: bytes) -> bool:
        near = int(BKForest.distance(np.frombuffer(m, np.uint64), np.frombuffer(n, np.uint64))) <= radius
        return near and similar(x, y, least)

    keys = marks.select("short", F.explode("key").alias("key"))
    links = similar_links(keys, fetch, pair, lambda sets, label, of: link_sets(sets, label, of, radius, least), block, scratch)
    joined = scratch.keep(components(links, scratch).withColumnRenamed("node", "id"), "joined")
    # a point of one row that nothing links is no group
    some = tested(points, F.col("id"), joined, scratch).where("_possible OR n > 1").drop("_possible")
    named = some.join(joined, "id", "left").select("id", "first", "n", F.coalesce("root", "id").alias("root"))
    named = scratch.keep(named, "named")
    groups = scratch.keep(named.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("size")).where("size > 1"), "groups")
    of_point = scratch.keep(named.select("id", "root").join(groups, "root").select("id", "kept"), "of_point")
    gone = possible(marks.select("id", "doc_id", "text_hash"), F.col("id"), of_point, scratch).join(of_point, "id").where(F.col("doc_id").isNotNull() & ((F.col("doc_id") != F.col("kept.doc_id")) | ~F.col("text_hash").eqNullSafe(F.col("kept.text_hash"))))
    gone = scratch.keep(gone.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_hash")).distinct(), "gone")
    names = scratch.keep(gone.select(F.xxhash64("_gone", "_gone_hash")), "names")
    doc_id, text_hash = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    some, others = split(docs, F.xxhash64(doc_id, text_hash), names, scratch)
    return some.join(gone, (doc_id == F.col("_gone")) & (text_hash == F.col("_gone_hash")), "left_anti").union(others)
