"""Substring dedup: near copies of paragraphs (MinHash banding, exact verification, components), then verbatim runs of words.

Words are runs of anything but white space, A-Z lowered. A paragraph is a line of at least ``min_words`` words; shorter lines that
follow each other are laid together, up to a line whose hash says so, so that equal lines make equal paragraphs whatever
stands around them. Equal paragraphs are one point from the start. Points whose MinHash signatures of five-word shingles
agree in a whole band collide; with ten bands of three a pair of Jaccard similarity 0.8 collides with probability 0.999.
Colliding points are verified by exact Jaccard similarity of their shingle sets, links become components, and of each
component the occurrence in the smallest (doc_id, place) stays; the others are removals.

In what is left (no word of a removed paragraph) each window of 50 words that stands at a smaller place too is removed, word by
word and wherever lines break: of a run of 50 words and more one occurrence stays. Of all grams of 13 words each window chooses
the one of smallest hash. Only windows whose chosen gram repeats are compared at all, by 128 bits of hash.

Scale: one pass reads the texts; what leaves it are ids, band keys and chosen grams (about one in 20 words). ``sets`` says how bands
are dealt; shingle sets are fetched once for what collides. All joins are between written tables or aggregates, which AQE can split.

Cases: a null text has no paragraphs, nor has one of white space. Repeated rows are equal occurrences: of two rows of one doc_id with
equal texts neither is removed for the other's sake. Null doc_ids come first. A very long line is one paragraph, a very long
text is read whole. An empty table gives an empty result. Other columns are kept by ``remove_passages`` and not read otherwise;
working columns of it begin with ``_passages_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.llm.bloom import possible, split, tested
from textloom.llm.common import Scratch, append_columns, lean, map_slices
from textloom.llm.components import components
from textloom.llm.sets import link, ranges, signatures, similar, similar_links
from textloom.llm.words import Words, binaries, by_bytes, mix, range_hashes, shingles

MIN_WORDS, SHINGLE, SIMILARITY = 30, 5, 0.8
BANDS, ROWS = 10, 3
BLOCK = 4096
#: Each window of ``RUN`` words chooses a gram of ``GRAM`` words.
RUN, GRAM = 50, 13
#: One short line in so many ends a paragraph of short lines.
_ENDS = 4


def paragraph_words(w: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the paragraphs of some texts start and end, in words."""
    n = len(w.hash)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.concatenate(([0], np.flatnonzero(np.diff(w.line)) + 1))
    end = np.append(start[1:], n)
    long = end - start >= least
    last = range_hashes(w.hash, start, end) % np.uint64(_ENDS) == 0
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(w.text[start]) > 0) | long[1:] | long[:-1] | last[:-1]
    start = start[new]
    end = np.append(start[1:], n)
    keep = end - start >= least
    return start[keep], end[keep]


def shingle_set(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a run of word hashes."""
    return np.unique(shingles(hashes, min(size, len(hashes))))


def window_choices(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, chosen, gram): where the windows of ``RUN`` words start that lie in one text, where the gram that each chooses starts,
    and the hashes of all grams."""
    n, width = len(w.hash), RUN - GRAM + 1
    if n < RUN:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    gram = range_hashes(w.hash, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    value, at, have = gram, np.arange(len(gram)), 1
    while have < width:
        step = min(have, width - have)
        left, right = value[:-step], value[step:]
        at = np.where(left <= right, at[:-step], at[step:])
        value, have = np.minimum(left, right), have + step
    fits = w.text[: len(at)] == w.text[RUN - 1 : RUN - 1 + len(at)]
    windows = np.flatnonzero(fits)
    return windows, at[windows], gram


def _lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _digests(w: Words, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(w.hash[a:b].tobytes()) for a, b in zip(start.tolist(), end.tolist(), strict=True)]


UNITS = (
    "doc_id long, text_hash long, doc long, id array<binary>, short array<long>, line array<int>, start array<int>, words array<int>, band array<array<long>>, gram array<long>, at array<int>"
)


def _doc_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, doc, text): ``doc`` names a document in joins, where a collision only makes more candidates."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    return rows.select("doc_id", "text_hash", F.xxhash64("doc_id", "text_hash").alias("doc"), "text")


def units(docs: DataFrame, min_words: int, bands: int, rows: int) -> DataFrame:
    """What the first pass gives of each document: its paragraphs and its chosen grams."""
    if min_words < SHINGLE:
        raise ValueError(f"a paragraph has at least {SHINGLE} words")
    kind = T.StructType.fromDDL(UNITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        arrow = to_arrow_schema(kind)
        for batch in by_bytes(batches):
            w = Words(binaries(batch.column("text")))
            start, end = paragraph_words(w, min_words)
            count = end - start - SHINGLE + 1
            flat = shingles(w.hash, SHINGLE)[ranges(start, count)]
            made = signatures(flat, np.cumsum(count) - count, bands, rows)
            ids = _digests(w, start, end)
            text = w.text[start]
            _, chosen, gram = window_choices(w)
            chosen = chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]
            n = batch.num_rows
            of_para, of_gram = np.searchsorted(text, np.arange(n + 1)), np.searchsorted(w.text[chosen], np.arange(n + 1))
            first = w.first[:-1]
            columns = [
                _lists(pa.array(ids, pa.binary()), of_para),
                _lists(pa.array(np.frombuffer(b"".join(ids), "<i8")[::2], pa.int64()), of_para),
                _lists(pa.array(w.line[start] - w.first_line[text], pa.int32()), of_para),
                _lists(pa.array(start - first[text], pa.int32()), of_para),
                _lists(pa.array(end - start, pa.int32()), of_para),
                _lists(_lists(pa.array(made.view(np.int64).ravel(), pa.int64()), np.arange(len(ids) + 1) * bands), of_para),
                _lists(pa.array(gram[chosen].view(np.int64), pa.int64()), of_gram),
                _lists(pa.array(chosen - first[w.text[chosen]], pa.int32()), of_gram),
            ]
            columns = [batch.column("doc_id"), batch.column("text_hash"), batch.column("doc"), *columns]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return _doc_rows(docs).mapInArrow(run, kind)


def _fetched(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(short, id, shingles) of the paragraphs that ``wanted`` (doc, places: array of (start, words, id)) names, each id of one place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            w = Words(list(frame["text"]))
            ids, sets = [], []
            for first, end, places in zip(w.first[:-1].tolist(), w.first[1:].tolist(), frame["places"], strict=True):
                for p in places:
                    a = first + p["start"]
                    own = w.hash[a : a + p["words"]]
                    if a + p["words"] <= end and xxhash.xxh3_128_digest(own.tobytes()) == p["id"]:
                        ids.append(p["id"])
                        sets.append(shingle_set(own).tobytes())
            yield pd.DataFrame({"short": np.frombuffer(b"".join(ids), "<i8")[::2], "id": ids, "shingles": sets})

    joined = possible(_doc_rows(docs), F.col("doc"), wanted, scratch).join(wanted, "doc").dropDuplicates(["doc", "text"])
    return map_slices(joined.select(F.col("text").cast("binary").alias("text"), "places"), run, "short long, id binary, shingles binary", text="text")


def _links(docs: DataFrame, unit: DataFrame, points: DataFrame, similarity: float, block: int, scratch: Scratch) -> DataFrame:
    """(a, b): links of similar paragraphs (ids) that span the components of similarity."""

    def fetch(some: DataFrame) -> DataFrame:
        wanted = possible(points, F.col("short"), some, scratch).join(some, "short", "left_semi")
        wanted = wanted.groupBy("first.doc").agg(F.collect_list(F.struct("first.start", "first.words", "id")).alias("places"))
        return _fetched(docs, scratch.keep(wanted, "wanted"), scratch).withColumn("mark", F.lit(None).cast("binary"))

    keys = unit.select(F.explode(F.arrays_zip("short", "band")).alias("p")).select("p.short", F.explode("p.band").alias("key"))
    return similar_links(keys, fetch, lambda x, _, y, __: similar(x, y, similarity), lambda sets, label, _: link(sets, label, similarity), block, scratch)


def _classes(docs: DataFrame, unit: DataFrame, similarity: float, block: int, scratch: Scratch) -> DataFrame:
    """One row for each paragraph that has a copy or near copy elsewhere: doc_id, text_hash, doc, para, start, n_words, class_doc,
    class_para (the occurrence that stays), removed."""
    places = unit.select("doc_id", "text_hash", "doc", F.explode(F.arrays_zip("id", "short", "line", "start", "words")).alias("p")).select("doc_id", "text_hash", "doc", "p.*")
    first = F.min(F.struct("doc_id", "start", "text_hash", "doc", "line", "words")).alias("first")
    points = scratch.keep(places.groupBy("id", "short").agg(first, F.count("*").alias("n")), "points")
    joined = components(_links(docs, unit, points, similarity, block, scratch), scratch)
    joined = scratch.keep(joined.withColumnRenamed("node", "id"), "joined")
    # a point of one place that nothing links is no class
    some = tested(points, F.col("id"), joined, scratch).where("_possible OR n > 1").drop("_possible")
    named = some.join(joined, "id", "left").select("id", "first", "n", F.coalesce("root", "id").alias("root"))
    named = scratch.keep(named, "named")
    groups = scratch.keep(named.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("size")).where("size > 1"), "groups")
    of_point = scratch.keep(named.select("id", "root").join(groups, "root").select("id", "kept"), "of_point")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("start") == F.col("kept.start")) & (F.col("text_hash") == F.col("kept.text_hash"))
    return possible(places, F.col("id"), of_point, scratch).join(of_point, "id").select(
        "doc_id", "text_hash", "doc", F.col("line").alias("para"), "start", F.col("words").cast("long").alias("n_words"),
        F.col("kept.doc_id").alias("class_doc"), F.col("kept.line").alias("class_para"), (~stays).alias("removed"),
    )


def merged(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last numbers of the ranges (in order of ``at``) that overlapping ranges make."""
    stop = np.maximum.accumulate(at + size)
    new = np.flatnonzero(np.concatenate(([True], at[1:] > stop[:-1])))
    return new, np.append(new[1:], len(at)) - 1


def _runs(docs: DataFrame, unit: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The repeated spans of what is left: doc_id, text_hash, para, n_words, class_doc, class_para, start, removed."""
    gone = found.where("removed").groupBy("doc").agg(F.collect_set(F.struct("start", "n_words")).alias("gone"))
    gone = scratch.keep(gone, "gone")

    def leave(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Only the grams that touch no removed paragraph."""
        for frame in frames:
            grams, places = [], []
            for gram, at, taken in zip(frame["gram"], frame["at"], frame["gone"], strict=True):
                free = np.ones(len(at), bool)
                for g in taken if taken is not None else ():
                    free[np.searchsorted(at, g["start"] - GRAM, "right") : np.searchsorted(at, g["start"] + g["n_words"])] = False
                grams.append(gram[free])
                places.append(at[free])
            yield pd.DataFrame({"doc": frame["doc"], "gram": grams, "at": places})

    cut_short, whole = split(unit.select("doc", "gram", "at").where(F.size("at") > 0), F.col("doc"), gone, scratch)
    left = cut_short.join(gone, "doc", "left").unionByName(whole, allowMissingColumns=True)
    left = scratch.keep(map_slices(left, leave, "doc long, gram array<long>, at array<int>", 256).where(F.size("at") > 0), "left")
    grams = left.select("doc", F.explode(F.arrays_zip("gram", "at")).alias("g")).select("doc", "g.gram", "g.at")
    often = scratch.keep(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "often")
    some = possible(grams, F.col("gram"), often, scratch).join(often, "gram").groupBy("doc").agg(F.collect_set("at").alias("at"))
    some = scratch.keep(some.join(gone, "doc", "left"), "repeat")

    def show(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            w = Words(list(frame["text"]))
            windows, chosen, _ = window_choices(w)
            often, free = np.zeros(len(w.hash) + 1, bool), np.ones(len(w.hash) + 1, bool)
            for first, end, at, taken in zip(w.first[:-1].tolist(), w.first[1:].tolist(), frame["at"], frame["gone"], strict=True):
                at = first + np.asarray(at, np.int64)
                often[at[at < end]] = True
                for g in taken if taken is not None else ():
                    free[first + g["start"] : first + g["start"] + g["n_words"]] = False
            whole = np.concatenate(([0], np.cumsum(~free)))
            windows = windows[often[chosen] & (whole[windows] == whole[windows + RUN])]
            text = w.text[windows]
            parts = np.searchsorted(text, np.arange(len(frame) + 1))
            # two hashes of each window: as it stands, and of other values of its words
            two = [range_hashes(x, windows, windows + RUN).view(np.int64) for x in (w.hash, mix(w.hash))]
            at, line = windows - w.first[text], w.line[windows] - w.first_line[text]
            cut = lambda x: [x[a:b] for a, b in zip(parts[:-1], parts[1:], strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text_hash": frame["text_hash"], "h": cut(two[0]), "i": cut(two[1]), "at": cut(at), "line": cut(line)})

    rows = possible(_doc_rows(docs), F.col("doc"), some, scratch).join(some, "doc").select("doc_id", "text_hash", F.col("text").cast("binary").alias("text"), "at", "gone")
    shown = map_slices(rows, show, "doc_id long, text_hash long, h array<long>, i array<long>, at array<int>, line array<int>", text="text")
    shown = scratch.keep(shown.where(F.size("at") > 0), "windows")
    windows = shown.select("doc_id", "text_hash", F.explode(F.arrays_zip("h", "i", "at", "line")).alias("w")).select("doc_id", "text_hash", "w.*")
    place = F.struct("doc_id", "text_hash", "at", "line")
    firsts = windows.groupBy("h", "i").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "i", "first")
    firsts = scratch.keep(firsts, "firsts")
    both = scratch.keep(possible(windows, F.col("h"), firsts, scratch).join(firsts, ["h", "i"]), "both")
    later = both.where(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "at", "line", F.col("first.doc_id").alias("class_doc"), F.col("first.line").alias("class_para"), F.lit(True).alias("removed"))
    kept = both.select("first.*").distinct().select("doc_id", "text_hash", "at", "line", F.col("doc_id").alias("class_doc"), F.col("line").alias("class_para"), F.lit(False).alias("removed"))
    spans = later.union(kept).groupBy("doc_id", "text_hash", "removed").agg(F.array_sort(F.collect_set(F.struct("at", "line", "class_doc", "class_para"))).alias("places"))

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for doc_id, text_hash, removed, places in zip(frame["doc_id"], frame["text_hash"], frame["removed"], frame["places"], strict=True):
                at = np.fromiter((p["at"] for p in places), np.int64, len(places))
                for a, b in zip(*merged(at, np.full(len(at), RUN)), strict=True):
                    p = places[a]
                    made.append((doc_id, text_hash, p["line"], at[b] + RUN - at[a], p["class_doc"], p["class_para"], at[a], removed))
            yield pd.DataFrame(made, columns=["doc_id", "text_hash", "para", "n_words", "class_doc", "class_para", "start", "removed"]).astype({"doc_id": "Int64", "class_doc": "Int64"})

    runs = scratch.keep(map_slices(spans, join, "doc_id long, text_hash long, para int, n_words long, class_doc long, class_para int, start int, removed boolean", 256), "runs")
    for table in (left, often, some, shown, both):
        scratch.drop(table)
    return runs


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without spans of words; a line of which nothing is left goes."""
    raw = text.encode("utf-8", "surrogatepass")
    w = Words([raw])
    out, at = [], 0
    start, size = np.array(sorted((a, b - a) for a, b in spans), np.int64).T
    for x, y in zip(*merged(start, size), strict=True):
        last = int((start[x : y + 1] + size[x : y + 1]).max())
        a, b = int(w.start[start[x]]), int(w.end[last - 1])
        while b < len(raw) and raw[b] != 10 and raw[b] in b" \t\x0b\x0c\r":
            b += 1
        if a == 0 or raw[a - 1] == 10:  # whole lines: one of the breaks around them goes as well
            a, b = (a, b + 1) if b < len(raw) and raw[b] == 10 else (max(a - 1, at), b) if b == len(raw) else (a, b)
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _found(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    unit = scratch.keep(units(docs, min_words, bands, rows), "units")
    found = scratch.keep(_classes(docs, unit, similarity, block, scratch), "classes")
    return found, _runs(docs, unit, found, scratch)


def classes(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """The paragraphs that have a copy or near copy elsewhere, as ``_classes`` gives them."""
    scratch = Scratch(docs.sparkSession, "passages")
    unit = scratch.keep(units(docs, min_words, bands, rows), "units")
    return _classes(docs, unit, similarity, block, scratch)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """The paragraphs with copies, and the runs that repeat in what is left, for the query; the occurrences that stay are
    among them. ``para`` is the line in which a paragraph or run begins."""
    found, spans = _found(docs, Scratch(docs.sparkSession, "repeated"))
    columns = ["doc_id", F.col("para").cast("long").alias("para"), "n_words", "class_doc", F.col("class_para").cast("long").alias("class_para"), "removed"]
    return found.select(*columns).union(spans.select(*columns))


def remove_passages(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the removals; a document of which nothing but white space is left goes.

    ``n_chars``, where there is such a column, follows the new text.
    """
    scratch = Scratch(docs.sparkSession, "removal")
    found, runs = _found(docs, scratch, **options)
    gone = found.where("removed").select("doc_id", "text_hash", "start", "n_words").union(runs.where("removed").select("doc_id", "text_hash", "start", "n_words"))
    gone = gone.groupBy(F.col("doc_id").alias("_passages_doc"), F.col("text_hash").alias("_passages_hash")).agg(F.collect_set(F.struct("start", "n_words")).alias("_passages_gone"))
    gone = scratch.keep(gone, "gone")
    text = F.col("text").cast("string")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_passages_doc")) & (F.xxhash64(text) == F.col("_passages_hash"))

    def start():
        def left(batch: pa.RecordBatch) -> list[list]:
            rows = zip(binaries(batch.column("text")), batch.column("_passages_gone").to_pylist(), strict=True)
            return [[None if x is None else cut(t.decode("utf-8", "surrogatepass"), [(y["start"], y["start"] + y["n_words"]) for y in x]) for t, x in rows]]

        return left

    names = scratch.keep(gone.select(F.xxhash64("_passages_doc", "_passages_hash")), "names")
    some, others = split(docs, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text)), names, scratch)
    joined = some.join(gone, on, "left").withColumn("text", text)
    touched = F.col("_passages_gone").isNotNull()
    joined = append_columns(joined, [T.StructField("_passages_left", T.StringType())], start)
    joined = joined.where(~touched | F.col("_passages_left").rlike(r"\S"))
    now = {"text": F.when(touched, F.col("_passages_left")).otherwise(text), "n_chars": F.when(touched, F.char_length("_passages_left")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return joined.select(*((now[c].cast(docs.schema[c].dataType) if c in now else F.col(c)).alias(c) for c in docs.columns)).union(others)
